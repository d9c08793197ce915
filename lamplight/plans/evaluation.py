"""Queries over the driver's tables that build, run and report evaluations, and read and write their files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from lamplight.functions import codegen as G, execution as X, signatures as S, text as T
from lamplight.functions.codegen import benchmark_program, go_imports as specs_of, java_typed, literal, merged_imports, nullable
from lamplight.operators import evaluation as E, relational as R, summaries as A
from lamplight.plans.queries import query, scratch, table
from lamplight.sources import files, sinks

# -- parallels whose usability SQL can tell --------------------------------------

ADD = "class Solution:\n    def solve(self, a: int) -> int:\n        return a + 1\n"
WALK = "class Solution:\n    def solve(self, head: Optional[ListNode]) -> int:\n        return 0\n"
TESTS = ["''", "'x = 1'", "'assert solve(a = 1) == 2'", "'assert solve({1: 2}) == 3'", "'assert solve(1) == 2\\nassert solve(None) == 1'", "NULL", "'assert solve(list_node([1, 2])) == 0'", "concat('assert solve(', doc_id, ') == ', doc_id + 1)"]
STATUS_SQL = "CASE WHEN doc_id % 8 IN (0, 5) THEN 'skipped_no_test' WHEN doc_id % 8 = 1 THEN 'skipped_no_test_cases' WHEN doc_id % 8 = 2 THEN 'skipped_no_python_reference' WHEN doc_id % 8 = 3 THEN 'skipped_no_convertible_input_output_pairs' ELSE 'kept' END"
KEPT_SQL = f"k AS (SELECT doc_id AS parallel_id, 1 + (doc_id % 3 = 1)::INT + (doc_id % 5 <> 0)::INT AS present, (doc_id % 5 <> 0 AND doc_id % 16 = 7)::INT AS excluded, (doc_id % 8 = 6) AS nodes, doc_id % 3 = 1 AS cpp, doc_id % 5 <> 0 AS java FROM documents WHERE {STATUS_SQL} = 'kept')"
TARGETS_SQL = KEPT_SQL + ", t AS (SELECT parallel_id, present, 'python' AS target_language FROM k UNION ALL SELECT parallel_id, present, 'cpp' FROM k WHERE cpp UNION ALL SELECT parallel_id, present, 'java' FROM k WHERE java AND excluded = 0)"


def _parallels(spark, sf_dir):
    code = lambda x: F.lit(x)
    test = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(TESTS)) + " END"
    python = F.when(F.expr("doc_id % 8 = 6"), WALK).when(F.expr("doc_id % 8 <> 2"), ADD)
    cpp = F.when(F.expr("doc_id % 3 = 0"), "").when(F.expr("doc_id % 3 = 1"), code("class Solution { public: int solve(int a) { return a + 1; } };"))
    java = F.when(F.expr("doc_id % 5 <> 0"), code("class Solution { public int solve(int a) { return a + 1; } }"))
    x = table(spark, sf_dir, "documents")
    return x.select(F.col("doc_id").alias("parallel_id"), F.expr(test).alias("test"), python.alias("python"), cpp.alias("cpp"), java.alias("java"), F.lit("Solution().solve").alias("entry_point"), F.col("lang").alias("difficulty"))


def _excluded(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 16 = 7").select(F.col("doc_id").alias("parallel_id"), F.lit("java").alias("target_language"))


@query(f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM documents GROUP BY 1")
def skip_reasons(spark, sf_dir):
    """PF9: the first reason to skip a row."""
    return A.value_counts(E.examined(_parallels(spark, sf_dir)).select(F.coalesce("reason", F.lit("kept")).alias("status")), "status")


@query("SELECT doc_id AS parallel_id, concat_ws(',', CASE WHEN doc_id % 3 = 1 THEN 'cpp' END, CASE WHEN doc_id % 5 <> 0 THEN 'java' END, CASE WHEN doc_id % 8 <> 2 THEN 'python' END) AS present FROM documents")
def present_languages(spark, sf_dir):
    """PF6: an empty text is none."""
    x = _parallels(spark, sf_dir)
    return x.select("parallel_id", F.concat_ws(",", R.present(x, E.LANGS)).alias("present"))


@query("WITH " + KEPT_SQL + f", s AS (SELECT {STATUS_SQL} AS status, doc_id FROM documents) SELECT "
       + ", ".join(f"(SELECT count(*) FROM s WHERE status = '{r}') AS {r}" for r in E.REASONS)
       + ", (SELECT count(*) FROM k) AS kept_input_output_pair_count, (SELECT count(*) FROM s WHERE doc_id % 8 IN (3, 4)) AS unconvertible_input_output_pair_count"
       ", CAST(sum(excluded) AS BIGINT) AS excluded_by_quality_audit, CAST(sum((present - excluded) * (present - 1)) AS BIGINT) AS kept, CAST(coalesce(sum((present - excluded) * (present - 1)) FILTER (nodes), 0) AS BIGINT) AS kept_with_node_types"
       ", count(*) FILTER ((present - excluded) * (present - 1) > 0) AS kept_parallels, round(count(*) / count(*) FILTER ((present - excluded) * (present - 1) > 0), 6) AS pairs_per_parallel FROM k")
def usability_report(spark, sf_dir):
    """A6, SO3."""
    return E.usability(E.examined(_parallels(spark, sf_dir)), _excluded(spark, sf_dir))


@query("WITH " + TARGETS_SQL + " SELECT target_language, CAST(sum(present - 1) AS BIGINT) AS payloads, count(DISTINCT parallel_id) AS parallels FROM t WHERE present > 1 GROUP BY 1")
def usable_by_target(spark, sf_dir):
    """By target language."""
    return E.usable_by_target(E.examined(_parallels(spark, sf_dir)), _excluded(spark, sf_dir))


@query("WITH " + TARGETS_SQL + ", l AS (SELECT parallel_id, 'python' AS source_language FROM k UNION ALL SELECT parallel_id, 'cpp' FROM k WHERE cpp UNION ALL SELECT parallel_id, 'java' FROM k WHERE java) SELECT parallel_id, source_language, target_language, source_language = 'python' AS from_python, true AS has_engine, CAST(1 AS INTEGER) AS pairs FROM t JOIN l USING (parallel_id) WHERE source_language <> target_language")
def executable_translations(spark, sf_dir):
    """Each target's driver, for every other language there is."""
    x = E.translations(E.examined(_parallels(spark, sf_dir)), _excluded(spark, sf_dir))
    return x.select("parallel_id", "source_language", "target_language", F.col("code_snippet_to_translate").contains("def solve").alias("from_python"), F.col("execution_engine").contains("solve").alias("has_engine"), F.size(F.from_json("expected_input_output_pairs", "array<string>")).alias("pairs"))


# -- outcomes --------------------------------------------------------------------

RESULT_SQL = "CASE WHEN event_type <> 'view' THEN 'compile_error' WHEN user_id % 3 <> 2 THEN 'count_mismatch' WHEN value > 20 THEN 'passed' ELSE 'failed_cases' END"


def _validated(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    passed = F.transform(F.sequence(F.lit(1), F.when(F.expr("user_id % 3 = 0"), 1).otherwise((F.col("user_id") % 3).cast("int"))), lambda i: (i < 2) | (F.col("value") > 20))
    return e.select("event_id", "user_id", "event_type", E.validation_outcome(F.col("event_type") == "view", passed, F.lit(2)).alias("outcome"))


@query(f"SELECT event_id, {RESULT_SQL} AS outcome FROM events")
def validation_outcomes(spark, sf_dir):
    """F18, A18."""
    return _validated(spark, sf_dir).select("event_id", "outcome")


@query(f"SELECT {RESULT_SQL} AS outcome, count(*) AS n FROM events GROUP BY 1 HAVING outcome <> 'passed'")
def failures_by_outcome(spark, sf_dir):
    """A9."""
    return A.failures(_validated(spark, sf_dir))


@query(f"SELECT event_type, user_id % 2 AS kind, count(*) AS n, round(avg(CASE WHEN {RESULT_SQL} = 'passed' THEN 1.0 ELSE 0.0 END), 9) AS rate FROM events GROUP BY 1, 2")
def pass_rate_by_kind(spark, sf_dir):
    """A8."""
    return A.rates_by(_validated(spark, sf_dir).withColumn("kind", F.col("user_id") % 2), ["event_type", "kind"], F.col("outcome") == "passed")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AND l.quality = 1 AS there, CASE WHEN d.n_chars % 2 = 0 THEN 'passed' ELSE 'failed_cases' END AS first, CASE WHEN l.quality = 1 THEN CASE WHEN d.n_chars % 3 = 0 THEN 'passed' ELSE 'failed_cases' END ELSE 'no_completion' END AS second, CASE WHEN l.quality = 1 THEN (d.n_chars % 2 = 0) = (d.n_chars % 3 = 0) ELSE false END AS agree FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en'")
def audit_join(spark, sf_dir):
    """J5, PF3, F20: another source under another key, and what an audit says of both."""
    other = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("problem_id"), F.when(F.col("quality") == 1, "text").otherwise("").alias("completion"))
    x = R.audited(R.equal(table(spark, sf_dir, "documents"), lang="en").select("doc_id", "n_chars"), other, "doc_id", "problem_id", "completion")
    said = lambda k: F.when(F.col("n_chars") % k == 0, "passed").otherwise("failed_cases")
    x = E.audit(x.withColumn("first", said(2)).withColumn("second", said(3)), "first", "second", "completion")
    return x.select("doc_id", (F.coalesce(F.length("completion"), F.lit(0)) > 0).alias("there"), "first", "second", "agree")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def unmatched_both(spark, sf_dir):
    """Both ways."""
    return R.unmatched(table(spark, sf_dir, "documents").where("doc_id % 3 <> 0"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT 'labels' AS side, count(DISTINCT doc_id) AS keys FROM labels UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM labels UNION SELECT doc_id + 5 FROM documents)")
def distinct_keys(spark, sf_dir):
    """A5, SO3."""
    labels, docs = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    return A.distinct_keys("doc_id", labels=labels, documents=docs, both=R.union_of_keys("doc_id", labels, docs.select((F.col("doc_id") + 5).alias("doc_id"))))


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer WHERE c_custkey < 50 UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def concatenated(spark, sf_dir):
    """SO2: the rows of both; a column that one lacks is null."""
    c = table(spark, sf_dir, "customer").where("c_custkey < 50").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.union_all(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 7")
def first_published(spark, sf_dir):
    """PF2, PF3, PF10: rows of one value, the first of them, without a column."""
    return R.without(R.first_rows(R.equal(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), lang="fr"), ["doc_id"], 7), "source")


@query("SELECT event_type AS metric, round(avg(value) FILTER (user_id % 2 = 0), 6) AS base, round(avg(value) FILTER (user_id % 2 = 1), 6) AS ft, round((avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0)) * CASE WHEN event_type = 'click' THEN -1 ELSE 1 END, 6) AS delta FROM events GROUP BY 1")
def metric_deltas(spark, sf_dir):
    """For one metric lower is better."""
    return A.deltas(table(spark, sf_dir, "events").withColumnRenamed("event_type", "metric"), ["metric"], F.col("value"), F.col("user_id") % 2, 0, 1, F.col("metric") == "click")


@query("WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 64.0::DOUBLE END AS base, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 64 / 64.0::DOUBLE END AS ft FROM part), y AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN base - ft ELSE ft - base END AS d FROM x) SELECT p_partkey, CASE WHEN base IS NULL THEN '—' ELSE printf('%.2f', base) END AS base, CASE WHEN ft IS NULL THEN '—' ELSE printf('%.2f', ft) END AS ft, CASE WHEN d IS NULL THEN '—' ELSE CASE WHEN d >= 0 THEN '+' ELSE '' END || printf('%.2f', d) END AS delta FROM y")
def formatted_report(spark, sf_dir):
    """F13, A17."""
    x = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") / 64.0).alias("base"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 64 / 64.0).alias("ft"))
    return x.select("p_partkey", T.formatted("base").alias("base"), T.formatted("ft").alias("ft"), T.signed(F.col("base"), F.col("ft"), lower_is_better=F.col("p_partkey") % 2 == 0).alias("delta"))


@query("SELECT event_id, CAST(user_id AS DOUBLE) AS acc, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) END AS pass_at_1, CAST(NULL AS DOUBLE) AS missing FROM events")
def nested_metrics(spark, sf_dir):
    """F22, F23, SRC11: names with commas, signs and dashes; a task that isn't there is null."""
    doc = F.concat(F.lit('{"results": {"mmlu": {"acc,none": '), "user_id", F.lit(', "alias": "m"}, "other": {"x": {"y": 1}}}, "n": [1], "summary": {'), F.when(F.expr("event_id % 2 = 0"), F.concat(F.lit('"humaneval-py": {"pass@1": '), "event_id", F.lit("}"))).otherwise(F.lit("")), F.lit("}}"))
    x = table(spark, sf_dir, "events").select("event_id", doc.alias("d"))
    d = F.col("d")
    return x.select("event_id", T.nested(d, "results", "mmlu", "acc,none").alias("acc"), T.nested(d, "summary", "humaneval-py", "pass@1").alias("pass_at_1"), T.nested(d, "results", "gsm8k", "acc,none").alias("missing"))


# -- scalar functions --------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS parallel_id, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS title FROM part")
def folder_names(spark, sf_dir):
    """F2."""
    x = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "-").otherwise(". "), "p_name").alias("name")).withColumn("f", T.folder("name"))
    return x.select("p_partkey", F.col("f.parallel_id").cast("string").alias("parallel_id"), "f.title")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'solve' WHEN 1 THEN 'solve' WHEN 2 THEN 'add' ELSE 'addTwo' END AS entry_point FROM documents")
def entry_points(spark, sf_dir):
    """PF11."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN '' WHEN 2 THEN 'Solution().add' WHEN 3 THEN 'addTwo' END").alias("e"))
    return x.select("doc_id", T.entry_point("e").alias("entry_point"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Go on:' || chr(10) || chr(10) || text ELSE 'Go on:' END AS prompt, '<user>' || text || '</user>' AS chat, text AS raw FROM benchmark")
def prompts(spark, sf_dir):
    """F8, F9."""
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.prompt(F.lit("Go on:"), F.when(F.col("item_id") % 2 == 0, t).otherwise("")).alias("prompt"), T.chat(t, "<user>", "</user>").alias("chat"), T.chat(t).alias("raw"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS model FROM documents")
def model_names(spark, sf_dir):
    """the name in the first document that has one, without its owner."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.model_name(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("owner/"), "source")).otherwise(""), F.col("lang")).alias("model"))


@query("SELECT doc_id, left(text, 2000) AS diagnostics, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS compiled, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS pass_at_1, CASE WHEN contains(text, 'th') THEN 'tree_node' WHEN contains(text, 'e') THEN 'list_node' ELSE 'plain' END AS node_kind FROM documents")
def sample_fields(spark, sf_dir):
    """F10, F11, F14, F16."""
    d = table(spark, sf_dir, "documents").withColumn("ok", F.col("doc_id") % 2 == 0).withColumn("rate", 1 - (F.col("doc_id") % 5) / 10)
    engine = F.replace(F.replace("text", F.lit("th"), F.lit("TreeNode")), F.lit("e"), F.lit("ListNode"))
    return d.select("doc_id", T.truncated("text").alias("diagnostics"), T.one_or_zero("ok").alias("compiled"), T.all_or_nothing("rate").alias("pass_at_1"), T.node_kind(F.when(F.contains("text", F.lit("th")), F.replace("text", F.lit("th"), F.lit("TreeNode"))).otherwise(engine)).alias("node_kind"))


HINTS = ["int", "List[int]", "Optional[ListNode]", "list[list[str]]", "'TreeNode | None'", "float", "List[Optional[TreeNode]]", "Dict[str, int]"]
CPP = ["int", "std::vector<int>", "ListNode*", "std::vector<std::vector<std::string>>", "TreeNode*", "double", "std::vector<TreeNode*>", "int"]
KINDS = ["plain", "plain", "list_node", "plain", "tree_node", "plain", "tree_node", "plain"]


@query("SELECT doc_id, " + ", ".join(f"CASE doc_id % 8 {' '.join(f'WHEN {k} THEN ' + chr(39) + x + chr(39) for k, x in enumerate(xs))} END AS {n}" for n, xs in (("cpp", CPP), ("kind", KINDS))) + ", CASE WHEN doc_id % 8 = 0 THEN 'long long' WHEN doc_id % 8 = 1 THEN 'std::vector<long long>' ELSE 'same' END AS wide FROM documents")
def typed_hints(spark, sf_dir):
    """What the annotations of a signature say, of whatever columns and defaults."""

    @F.pandas_udf("cpp string, kind string, wide string")
    def typed(source: pd.Series) -> pd.DataFrame:
        out = []
        for s in source:
            (_, hint), _ = S.hints(s, "Solution().solve")
            cpp, wide = S.cpp_type(hint), S.cpp_type(hint, far=True)
            out.append((cpp, S.kind_of(hint), wide if wide != cpp else "same"))
        return pd.DataFrame(out, columns=["cpp", "kind", "wide"])

    hint = F.element_at(F.array(*map(F.lit, HINTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    source = F.concat(F.lit("class Solution:\n    def solve(self, n: Dict[str, Tuple[int, int]] = {}, x: "), hint, F.lit(" = None) -> List[int]:\n        return []\n"))
    return table(spark, sf_dir, "documents").select("doc_id", typed(source).alias("t")).select("doc_id", "t.*")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'List<Integer>;int' WHEN 1 THEN 'int[];Map<String,List<Integer>>' WHEN 2 THEN 'int[][];char' ELSE 'long' END AS types, CASE doc_id % 4 WHEN 0 THEN 'List<Long>;long' WHEN 1 THEN 'long[];Map<String,List<Integer>>' WHEN 2 THEN 'long[][];char' ELSE 'long' END AS wide, CASE WHEN doc_id % 4 = 3 THEN 'Main' WHEN doc_id % 2 = 0 THEN 'Shown' ELSE 'Solution' END AS class_name FROM documents")
def java_signatures(spark, sf_dir):
    """C5, C11."""
    sources = ["class Solution { public List<Integer> f(final List<Integer> a, int k) { return a; } } public final class Shown {}", "class Solution { int[] f(int[] a, Map<String, List<Integer>> m) { return a; } }", "class Solution { int f(int[]... a, char c) { return 0; } } public class Shown {}", "interface I { long f(long n); }"]

    @F.pandas_udf("types string, wide string, class_name string")
    def typed(source: pd.Series) -> pd.DataFrame:
        own = [S.java_parameters(s, "f") or [] for s in source]
        return pd.DataFrame({"types": [";".join(t) for t in own], "wide": [";".join(map(S.widened, t)) for t in own], "class_name": [S.java_class(s) for s in source]})

    return table(spark, sf_dir, "documents").select("doc_id", typed(F.element_at(F.array(*map(F.lit, sources)), (F.col("doc_id") % 4 + 1).cast("int"))).alias("t")).select("doc_id", "t.*")


@query("SELECT doc_id, '{' || doc_id || ', ' || n_chars || '}' AS cpp, 'new int[]{' || doc_id || ', ' || n_chars || '}' AS java, '[' || doc_id || ', ' || n_chars || ']' AS python, 'new ArrayList<>(Arrays.<Long>asList(' || doc_id || 'L, ' || n_chars || 'L))' AS typed, 'std::vector<std::optional<int>>{' || doc_id || ', std::nullopt, 7}' AS holes FROM documents")
def literals(spark, sf_dir):
    """C6."""

    @F.pandas_udf("cpp string, java string, python string, typed string, holes string")
    def written(value: pd.Series) -> pd.DataFrame:
        xs = [json.loads(v) for v in value]
        return pd.DataFrame({**{lang: [literal(x, lang) for x in xs] for lang in ("cpp", "java", "python")}, "typed": [java_typed(x, "List<Long>") for x in xs], "holes": [nullable([x[0], None, 7, None], "cpp") for x in xs]})

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", written(F.to_json(F.array("doc_id", "n_chars"))).alias("t")).select("doc_id", "t.*")


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '"fmt";"testing";m "math"' ELSE '"testing";"fmt"' END AS imports FROM benchmark""")
def go_imports(spark, sf_dir):
    """SO4."""

    @F.pandas_udf("string")
    def merged(prompt: pd.Series, answer: pd.Series) -> pd.Series:
        return pd.Series([";".join(merged_imports(specs_of(p)[0], specs_of(a)[0])) for p, a in zip(prompt, answer)])

    even = F.col("item_id") % 2 == 0
    prompt = F.when(even, 'package main\nimport (\n\t"fmt"\n\t"testing" // both\n)\n').otherwise('package main\nimport "testing"\n')
    return table(spark, sf_dir, "benchmark").select("item_id", merged(prompt, F.when(even, 'package main\nimport m "math"\nimport "fmt"\n').otherwise('import ("fmt"; "testing")\n')).alias("imports"))


@query("SELECT CAST(item_id AS VARCHAR) AS name, 'python' AS language, 'Python' AS display, text AS prompt, 'def check(f): pass' || chr(10) || chr(10) || 'check(solve)' || chr(10) AS tests FROM benchmark UNION ALL SELECT 'r' || item_id, 'rust', 'Rust', text, '}' FROM benchmark WHERE item_id < 5")
def benchmark_tasks(spark, sf_dir):
    """SRC14."""
    b = table(spark, sf_dir, "benchmark")
    python = b.select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("prompt"), F.lit("def check(f): pass").alias("test"), F.lit("solve").alias("entry_point"))
    rust = b.select(F.concat(F.lit("r"), "item_id").alias("name"), F.col("text").alias("prompt"), F.lit("}").alias("tests"), "item_id")
    return R.union_all(files.benchmark_rows(python, "set-py"), files.benchmark_rows(rust, "set-rs", 5, "item_id"))


@query("SELECT doc_id AS parallel_id, quality, toxic FROM labels")
def secondary_projection(spark, sf_dir):
    """SRC6."""
    return files.projected(table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


NL = "' || chr(10) || '"
PARTS = {"cpp": ("int f() {", "int g() { return %d; }", "}\nint main() {}"), "java": ("import java.util.*;\nclass Task {", "class A { int g() { return %d; } }", "}\nvoid main() {}\n}"), "go": ('package p\nimport "testing"', 'package q\nimport "fmt"\nfunc g() int { return %d }', "func TestG() {}")}
WHOLE = {"cpp": "int f() {\n return %d; \n}\nint main() {}", "java": "import java.util.*;\nclass Task {\nint g() { return %d; }\nvoid main() {}\n}\n", "go": 'package p\n\nimport (\n\t"testing"\n\t"fmt"\n)\n\nfunc g() int { return %d }\nfunc TestG() {}\n'}


@query("SELECT item_id, CASE item_id % 3 " + " ".join(f"WHEN {k} THEN replace('" + x.replace("\n", NL).replace("\t", "' || chr(9) || '") + "', '%d', CAST(item_id AS VARCHAR))" for k, x in enumerate(WHOLE.values())) + " END AS program FROM benchmark")
def benchmark_programs(spark, sf_dir):
    """Prompt, whole answer and tests made one program."""

    @F.pandas_udf("string")
    def assembled(lang: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([benchmark_program(PARTS[la][0], PARTS[la][1] % k, PARTS[la][2], la) for la, k in zip(lang, n)])

    lang = F.element_at(F.array(*map(F.lit, PARTS)), (F.col("item_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", assembled(lang, "item_id").alias("program"))


# -- programs ----------------------------------------------------------------------

SOLVED = {
    "python": "class Solution:\n    def solve(self, a):\n        return [x % 3 for x in a]\n",
    "java": "class Solution { public int[] solve(int[] a) { for (int i = 0; i < a.length; i++) a[i] %= 3; return a; } }",
}


@query("SELECT item_id, item_id % 7 <> 5 AS compiled, CASE WHEN item_id % 7 = 5 THEN 'compile_error' WHEN item_id % 2 = 1 THEN 'passed' ELSE 'wrong_output' END AS outcome, CASE WHEN item_id % 7 = 5 THEN 0.0 WHEN item_id % 2 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS rate FROM benchmark")
def compiled_runs(spark, sf_dir):
    """Programs in two languages (C++ needs a compiler, so it is left to a test), built,
    compiled, run and scored. Of two pairs one holds for every item, the other for odd ones; some sources are broken."""
    lang = F.when(F.col("item_id") % 3 == 0, "java").otherwise("python")
    items = table(spark, sf_dir, "benchmark").select("item_id", lang.alias("lang"), F.format_string('[{"input": [[4, 5]], "expected": [1, 2]}, {"input": [[%d, 9]], "expected": [%d, 0]}]', "item_id", (F.col("item_id") + F.when(F.col("item_id") % 2 == 1, 0).otherwise(1)) % 3).alias("pairs"))
    code = F.when(F.col("lang") == "python", SOLVED["python"]).otherwise(SOLVED["java"])
    code = F.when(F.col("item_id") % 7 == 5, F.concat(code, F.when(F.col("lang") == "python", "import os; os._exit(3)\n").otherwise("}"))).otherwise(code)
    engine = G.build_driver("lang", "pairs", F.lit("class Solution:\n    def solve(self, a: List[int]) -> List[int]: ..."), F.lit("solve"), F.when(F.col("lang") == "java", F.lit(SOLVED["java"])))
    programs = items.withColumn("code", code).withColumn("engine", engine).withColumn("program", G.wire("code", "engine", "lang"))
    ran = E.scored(X.execute(programs, "item_id", "program", "lang", timeout=60.0, tasks=8), F.lit(2))
    return ran.select("item_id", (F.col("compiled") == 1).alias("compiled"), "outcome", F.col("test_pass_rate").alias("rate"))


CHECKS = {
    "python": "def f(a):\n    return a % 5\nassert f(%d) != 2\n",
    "java": "public class Problem { static int f(int a) { return a % 5; } public static void main(String[] x) { assert f(%d) != 2; } }\n",
}


@query("SELECT item_id, item_id % 11 <> 7 OR item_id % 3 <> 0 AS compiled, item_id % 5 <> 2 AND item_id % 11 <> 7 AS passed FROM benchmark")
def self_checked_runs(spark, sf_dir):
    """Programs that check themselves; some don't compile, or, in Python, fail when they are read."""
    lang = F.when(F.col("item_id") % 3 == 0, "java").otherwise("python")
    form = F.when(F.col("item_id") % 3 == 0, CHECKS["java"]).otherwise(CHECKS["python"])
    items = table(spark, sf_dir, "benchmark").select("item_id", lang.alias("lang"), F.concat(F.replace(form, F.lit("%d"), F.col("item_id").cast("string")), F.when(F.col("item_id") % 11 == 7, "}{").otherwise("")).alias("program"))
    return X.self_check(items, "item_id", "program", "lang", timeout=60.0, tasks=8).select("item_id", "compiled", "passed")


# -- files -------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def json_roundtrip(spark, sf_dir):
    """SNK2, SRC9: an array of records, nulls included, written and read."""
    at = scratch(spark)
    x = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).alias("n_regionkey"))
    sinks.text(sinks.json_text(x, ["n_nationkey"]), x, at)
    return files.records(spark, at, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema))


@query("SELECT n_nationkey AS parallel_id, CASE WHEN n_nationkey % 2 = 0 THEN 'java' ELSE 'cpp' END AS target_language, CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'new' END AS outcome FROM nation WHERE n_nationkey < 20")
def exclusions_merged(spark, sf_dir):
    """SRC10, SNK5, SO5: no file is no exclusions; those that are there come first."""
    at = scratch(spark)
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("parallel_id"), F.when(F.col("n_nationkey") % 2 == 0, "java").otherwise("cpp").alias("target_language"))
    old = sinks.merged(files.exclusions(spark, f"{at}-none"), n.where("parallel_id % 2 = 0").withColumn("outcome", F.lit("old")), ["parallel_id", "target_language"])
    sinks.json_lines(old, at)
    return sinks.merged(spark.read.schema(old.schema).json(at), R.union_all(n, n).withColumn("outcome", F.lit("new")), ["parallel_id", "target_language"])


@query("SELECT n_regionkey AS region, CAST(count(*) AS DOUBLE) AS n, (SELECT min_by(n_name, n_nationkey) FROM nation) AS first FROM nation GROUP BY 1")
def summary_document(spark, sf_dir):
    """SNK3, F23: summary and samples in one document, looked into again."""
    n = table(spark, sf_dir, "nation")
    doc = sinks.with_summary(n.select("n_nationkey", "n_name"), n.groupBy(F.col("n_regionkey").cast("string").alias("r")).agg(F.count("*").alias("n")), "r")
    keys = n.select("n_regionkey").distinct()
    at = F.from_json(F.from_json("document", "map<string,string>")["summary"], "map<string,string>")[F.col("n_regionkey").cast("string")]
    return keys.crossJoin(doc).select(F.col("n_regionkey").alias("region"), T.nested(at, "n").alias("n"), F.get_json_object("document", "$.samples[0].n_name").alias("first"))


@query("SELECT n_nationkey, n_name, 2 AS splits FROM nation")
def cached_splits(spark, sf_dir):
    """SNK1, SRC5, SRC7: splits are joined and cached once."""
    at, n = scratch(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for k in (0, 1):
        sinks.parquet(n.where(F.col("n_nationkey") % 2 == k), f"{at}/split{k}", 1)
    files.cached(spark, f"{at}/cache", [f"{at}/split0", f"{at}/split1"])
    return files.cached(spark, f"{at}/cache", []).withColumn("splits", F.lit(2))


@query("SELECT * FROM (VALUES (1, 'Two Sum', 'a' || chr(10), NULL, 'b' || chr(10), NULL, NULL), (12, 'Empty', NULL, NULL, NULL, NULL, NULL)) x(parallel_id, title, cpp, java, python, sql, typescript)")
def folder_tree(spark, sf_dir):
    """SRC2-SRC4: a folder without files stays, one of another name doesn't, nor a file of another."""
    at = scratch(spark)
    fs, hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    system = fs.Path(at).getFileSystem(hadoop)
    for folder, named in (("1. Two Sum", {"1.cpp": "a\r\n", "1.py": "b\n", "01.java": "c", "1.txt": "d", "2.sql": "e"}), ("12. Empty", {}), ("notes", {"3.py": "f"})):
        system.mkdirs(fs.Path(f"{at}/{folder}"))
        for name, text in named.items():
            out = system.create(fs.Path(f"{at}/{folder}/{name}"))
            out.write(bytearray(text.encode()))
            out.close()
    assert [r.name for r in files.folders(spark, at).where("skipped").collect()] == ["notes"]
    x = files.solution_tree(spark, at)
    return x.withColumn("parallel_id", F.col("parallel_id").cast("int"))


@query("SELECT * FROM (VALUES ('a', 'owner/x', 0), ('b', 'y=z', 1)) x(name, source, ordinal)")
def listed_sources(spark, sf_dir):
    """SRC8, SRC12: a list of sources and the answers in the same order, joined by position."""
    at = scratch(spark)
    one = spark.range(1)
    sinks.text("# names\n\na = owner/x\nb=y=z", one, f"{at}/list")
    sinks.text('[["first"], ["second", "more"]]', one, f"{at}/answers")
    g = files.generations(spark, f"{at}/answers")
    names = files.source_list(spark, f"{at}/list")
    return names.join(g, F.when(g.generation == "first", "a").otherwise("b") == names.name).select("name", "source", "ordinal")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT n_name FROM nation")
def text_columns(spark, sf_dir):
    """SRC13, SRC15: one column of some tables that have to be there."""
    at = files.required(spark, f"{sf_dir}/nation.parquet", "make the tables first")
    return files.texts(spark, [at, at], "n_name").withColumnRenamed("n_name", "name")


@query("SELECT 'part.parquet' AS newest")
def newest_table(spark, sf_dir):
    """T7."""
    return spark.createDataFrame([(files.newest(spark, f"{sf_dir}/p*.parquet").rsplit("/", 1)[-1],)], "newest string")


@query("SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def markdown_report(spark, sf_dir):
    """SNK4."""
    return spark.createDataFrame([(sinks.markdown(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")),)], "report string")
