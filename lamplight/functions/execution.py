"""Programs, compiled and run one by one in the tasks of a job. This is no sandbox: give a container's command as prefix."""

from __future__ import annotations

import os
import resource
import shutil
import signal
import subprocess
import sys
import tempfile
import time
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamplight.functions.signatures import java_class

KEPT, WRITTEN = 1 << 16, 1 << 28  # bytes kept of what a program says, and of a file that it may write
JAVA = ["java", "-Xmx512m", "-XX:+UseSerialGC", "-XX:ActiveProcessorCount=1"]
FILES = {"python": "program.py", "cpp": "program.cpp", "rust": "program.rs"}
COMPILERS = {"cpp": ["g++", "-O2", "-std=c++20", "program.cpp", "-o", "program"], "rust": ["rustc", "-O", "--edition", "2021", "-A", "warnings", "program.rs", "-o", "program"]}
NEEDED = {"python": sys.executable, "cpp": "g++", "java": "javac", "rust": "rustc", "go": "go"}


def available(lang: str) -> bool:
    return shutil.which(NEEDED[lang]) is not None


def said(cmd: list[str], at: str, timeout: float, env: dict | None = None) -> tuple[int | None, str, str, float]:
    """(return code or None when the time was up, output, errors, milliseconds). The program has a session of its own, of
    which all is killed at the end, and writes to files, so that nothing it leaves behind can hold the task."""

    def limit():
        resource.setrlimit(resource.RLIMIT_FSIZE, (WRITTEN, WRITTEN))

    with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        began = time.perf_counter()
        p = subprocess.Popen(cmd, cwd=at, stdin=subprocess.DEVNULL, stdout=out, stderr=err, start_new_session=True, env=env, preexec_fn=limit)
        try:
            code = p.wait(timeout)
        except subprocess.TimeoutExpired:
            code = None
        took = 1000 * (time.perf_counter() - began)
        try:
            os.killpg(p.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        p.wait()
        text = []
        for f in (out, err):
            f.seek(0)
            text.append(f.read(KEPT).decode(errors="replace"))
        return code, *text, took


def compiled(source: str, lang: str, at: str, prefix: list[str], main: str | None, seconds: float) -> tuple[list[str] | None, str]:
    """The command that runs the program, or None and the compiler's complaint."""
    name = FILES.get(lang) or f"{java_class(source)}.java"
    Path(at, name).write_text(source)
    if lang == "python":
        return [*prefix, sys.executable, name], ""
    libraries = os.environ.get("CLASSPATH", "")
    code, out, err, _ = said([*prefix, *(COMPILERS.get(lang) or ["javac", "-cp", f".:{libraries}", "-d", ".", name])], at, seconds)
    if code is None:
        return None, "Compilation timed out"
    if code:
        return None, err or out
    return [*prefix, *([*JAVA, "-ea", "-cp", f".:{libraries}", main or java_class(source)] if lang == "java" else ["./program"])], ""


def run(source: str, lang: str = "python", timeout: float = 10.0, prefix: list[str] | None = None, compile_seconds: float = 60.0) -> dict:
    """A program in a folder of its own; its lines OK and FAIL are its results. Any return code but 0 and 1
    counts as not compiled, as does running out of time."""
    fail = lambda why: {"compiled": False, "passed": [], "diagnostics": why, "runtime_ms": None}
    if lang not in ("python", "cpp", "java"):
        raise ValueError(f"no driver runs {lang!r}")
    with tempfile.TemporaryDirectory() as at:
        command, why = compiled(source, lang, at, prefix or [], "Main", compile_seconds)
        if command is None:
            return fail(why)
        code, out, err, took = said(command, at, timeout)
    if code is None:
        return fail("Execution timed out")
    if code not in (0, 1):
        return fail(err or f"exit code {code}")
    lines = [x.strip() for x in out.splitlines()]
    return {"compiled": True, "passed": [x == "OK" for x in lines if x == "OK" or x.startswith("FAIL")], "diagnostics": err, "runtime_ms": took}


def check(source: str, lang: str, timeout: float = 15.0, prefix: list[str] | None = None, compile_seconds: float = 60.0) -> dict:
    """A program that checks itself passes if it returns 0. Java's assertions are on; Go's are tests."""
    result = lambda ok, passed, code, why, took=None: {"compiled": ok, "passed": passed, "returncode": code, "diagnostics": why, "runtime_ms": took}
    if lang not in NEEDED:
        raise ValueError(f"nothing runs {lang!r}")
    with tempfile.TemporaryDirectory() as at:
        if lang == "go":
            env = go_environment(at)
            warm_go(prefix or [])
            Path(at, "go.mod").write_text("module program\n\ngo 1.19\n")
            Path(at, "program_test.go").write_text(source)
            code, out, err, took = said([*(prefix or []), "go", "test", "./..."], at, timeout, env)
            ok = code is None or not any(x in out + err for x in ("build failed]", "setup failed]"))
        else:
            command, why = compiled(source, lang, at, prefix or [], None, compile_seconds)
            if command is None:
                return result(False, False, -1, why)
            code, out, err, took = said(command, at, timeout)
            ok = True
    if code is None:
        return result(True, False, -1, "Execution timed out")
    return result(ok, code == 0, code, out + err if lang == "go" else err or out, took)


_warm: list[bool] = []


def go_environment(at: str) -> dict:
    return os.environ | {"GOCACHE": str(Path(tempfile.gettempdir(), "lamplight-go")), "GOPATH": f"{at}/path", "HOME": at, "GOPROXY": "off", "GOFLAGS": "-mod=mod"}


def warm_go(prefix: list[str]) -> None:
    """What all tests import is compiled once a worker, so that no row's time is spent on it."""
    if _warm:
        return
    with tempfile.TemporaryDirectory() as at:
        Path(at, "go.mod").write_text("module warm\n\ngo 1.19\n")
        Path(at, "warm_test.go").write_text('package warm\n\nimport (\n\t"fmt"\n\t"testing"\n)\n\nfunc TestWarm(t *testing.T) { _ = fmt.Sprint(t.Name()) }\n')
        said([*prefix, "go", "test", "./..."], at, 300, go_environment(at))
    _warm.append(True)


RAN = "compiled boolean, passed array<boolean>, diagnostics string, runtime_ms double"
CHECKED = "compiled boolean, passed boolean, returncode int, diagnostics string, runtime_ms double"


def _each(df: DataFrame, key: str, source: str, lang, one, schema: str, tasks: int | None) -> DataFrame:
    lang = F.lit(lang) if isinstance(lang, str) and lang in NEEDED else lang
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(source).alias("source"), (F.col(lang) if isinstance(lang, str) else lang).alias("lang"))

    def work(batches):
        for b in batches:
            for k, s, la in zip(b["id"], b["source"], b["lang"]):
                x = one(s or "", la)
                yield pd.DataFrame({"id": pd.Series([k], dtype=b["id"].dtype)} | {n: [v] for n, v in x.items()})

    return (rows.repartition(tasks) if tasks else rows).mapInPandas(work, f"id {kind}, {schema}").withColumnRenamed("id", key)


def execute(df: DataFrame, key: str, source: str, lang: str = "python", timeout: float = 10.0, prefix: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Runs every row's program; lang is a language or the column that has it. Tasks, not threads, run side
    by side: as many as tasks says, else as many as the rows' partitions. Keys may be of any type."""
    return _each(df, key, source, lang, lambda s, la: run(s, la, timeout, prefix), RAN, tasks)


def self_check(df: DataFrame, key: str, source: str, lang: str, timeout: float = 15.0, prefix: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """X2, X5, X7 for programs that check themselves."""
    return _each(df, key, source, lang, lambda s, la: check(s, la, timeout, prefix), CHECKED, tasks)


def first_failure(df: DataFrame, key: str, source: str, lang: str = "python", timeout: float = 10.0) -> dict | None:
    """Runs the rows in the order of their keys, one after another, up to the first that doesn't pass."""
    for r in df.orderBy(key).toLocalIterator():
        x = run(r[source] or "", r[lang] if lang in df.columns else lang, timeout)
        if not x["compiled"] or not x["passed"] or not all(x["passed"]):
            return {key: r[key]} | x
    return None
