"""Command lines: python -m lamplight COMMAND. The session's settings are those of spark-submit or spark-defaults."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamplight.functions import codegen, execution
from lamplight.operators import evaluation, relational, summaries
from lamplight.plans import catalogue
from lamplight.sources import files, sinks


def base(spark: SparkSession, root: str, out: str) -> DataFrame:
    """A tree of solution folders as a table of parallels."""
    df = files.solution_tree(spark, files.required(spark, root, "give the folder that has the solutions' folders"))
    sinks.parquet(df, out)
    return summaries.present_counts(spark.read.parquet(out), list(files.EXTENSIONS.values()))


def instruct(spark: SparkSession, parallels: str, out: str, fraction: float, seed: int) -> DataFrame:
    """Instruction rows of all directed pairs, split by parallel into train and test."""
    p = spark.read.parquet(files.required(spark, parallels, "make it with the command base"))
    rows = relational.directed_pairs(relational.eligible(p, evaluation.LANGS), "parallel_id", evaluation.LANGS)
    rows = rows.withColumn("instruction", relational.instruction(F.col("parallel_id"), F.col("source_language"), F.col("target_language"), seed))
    held = relational.split_keys(rows, "parallel_id", fraction, seed)
    for name, how in (("test", "left_semi"), ("train", "left_anti")):
        sinks.parquet(relational.without(rows.join(held, "parallel_id", how), *([] if name == "test" else ["parallel_id"])), f"{out}/{name}")
    return summaries.value_counts(spark.read.parquet(f"{out}/test"), "target_language")


def build(spark: SparkSession, parallels: str, out: str, exclusions: str | None) -> DataFrame:
    """The executable translations of parallels that have tests, and the report of what is usable."""
    seen = evaluation.examined(spark.read.parquet(files.required(spark, parallels, "it needs test, python, cpp, java and entry_point")))
    left_out = files.exclusions(spark, exclusions) if exclusions else spark.createDataFrame([], "parallel_id long, target_language string")
    sinks.parquet(evaluation.translations(seen, left_out), out)
    return evaluation.usability(seen, left_out)


def score(spark: SparkSession, translations: str, out: str, column: str, tasks: int) -> DataFrame:
    """Runs a column of translations against their drivers, and summarises the samples by pair of languages."""
    t = spark.read.parquet(files.required(spark, translations, "make it with the command evaluation"))
    t = t.withColumn("sample", F.concat_ws(":", "parallel_id", "source_language", "target_language")).withColumn("program", codegen.wire(column, "execution_engine", "target_language"))
    ran = execution.execute(t, "sample", "program", "target_language", tasks=tasks)
    expected = t.select("sample", "parallel_id", "source_language", "target_language", F.size(F.from_json("expected_input_output_pairs", "array<string>")).alias("expected"))
    sinks.parquet(evaluation.scored(ran.join(expected, "sample"), F.col("expected")), out)
    return summaries.cells(spark.read.parquet(out), ["source_language", "target_language", "difficulty"])


def query(spark: SparkSession, name: str, tables: str, out: str) -> DataFrame:
    """One query of the catalogue over a folder of tables."""
    sinks.parquet(catalogue.QUERIES[name](spark, tables), out)
    return spark.read.parquet(out).limit(20)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m lamplight", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for f, names in ((base, ["root", "out"]), (instruct, ["parallels", "out"]), (build, ["parallels", "out"]), (score, ["translations", "out"]), (query, ["name", "tables", "out"])):
        p = commands.add_parser("evaluation" if f is build else f.__name__, help=f.__doc__)
        p.set_defaults(f=f)
        for n in names:
            p.add_argument(n, choices=sorted(catalogue.QUERIES) if n == "name" else None)
        if f is instruct:
            p.add_argument("--fraction", type=float, default=0.3)
            p.add_argument("--seed", type=int, default=0)
        if f is build:
            p.add_argument("--exclusions")
        if f is score:
            p.add_argument("--column", default="expected_code_snippet_translation")
            p.add_argument("--tasks", type=int, default=8)
    given = vars(parser.parse_args(args))
    given.pop("command")
    f = given.pop("f")
    print(sinks.markdown(f(SparkSession.builder.getOrCreate(), **given)))


if __name__ == "__main__":
    main()
