"""Queries over the driver's tables, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import code as C, codegen as G, execution as X, text as T
from lamplight.operators import evaluation as E, relational as R, summaries as A
from lamplight.plans.queries import ORACLES, QUERIES, query, table  # noqa: F401

@query("SELECT event_type AS source_language, CAST(user_id % 3 AS BIGINT) AS difficulty, count(*) AS n, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS compile_rate, round(avg(value), 6) AS mean_rate FROM events GROUP BY 1, 2")
def eval_summary(spark, sf_dir):
    """A1: rates of each cell; a rate that the samples lack is left out."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_language"), (F.col("user_id") % 3).alias("difficulty"), (F.col("value") > 20).alias("compiled"), F.col("value").alias("test_pass_rate"))
    return A.cells(e, ["source_language", "target_language", "difficulty"])


LANGS = ["de", "en", "es", "fr"]
WIDE_SQL = "SELECT doc_id // 4 AS parallel_id, " + ", ".join(f"min_by(text, doc_id) FILTER (WHERE lang = '{x}') AS {x}" for x in LANGS) + " FROM documents GROUP BY 1"
N_PRESENT = " + ".join(f"({x} IS NOT NULL)::INT" for x in LANGS)
PAIRS_SQL = "WITH w AS (" + WIDE_SQL + "), l AS (" + " UNION ALL ".join(f"SELECT parallel_id, '{x}' AS lang, {x} AS text FROM w WHERE {x} IS NOT NULL" for x in LANGS) + ") SELECT a.parallel_id, a.lang AS source_language, b.lang AS target_language, a.text AS input, b.text AS output FROM l a JOIN l b ON a.parallel_id = b.parallel_id AND a.lang <> b.lang"
HELD_SQL = "SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY md5('0:' || o_custkey), o_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE r <= greatest(1, round_even(n * 0.3e0, 0))"


def _wide(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id DIV 4").alias("parallel_id"), "doc_id", "lang", "text")
    return R.wide(docs, "parallel_id", "lang", "text", "doc_id", LANGS)


@query(WIDE_SQL)
def base_wide(spark, sf_dir):
    return _wide(spark, sf_dir)


@query("SELECT d.doc_id, d.lang, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_left(spark, sf_dir):
    """J1."""
    return R.enrich(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")


@query("SELECT CAST(l.quality AS VARCHAR) AS quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def difficulty_counts(spark, sf_dir):
    """A3."""
    return A.value_counts(enrich_left(spark, sf_dir), "quality")


@query("SELECT count(l.quality) AS covered, count(*) AS total, count(l.quality) / count(*) AS ratio FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(spark, sf_dir):
    """A4."""
    return A.coverage(enrich_left(spark, sf_dir), "quality")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS matched, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_base")
def overlap_stats(spark, sf_dir):
    """J3, J4."""
    a, b = table(spark, sf_dir, "documents").select("doc_id").distinct(), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(1))
    return a.join(b, "doc_id", "left").agg(F.count("there").alias("matched"), F.count(F.when(F.col("there").isNull(), 1)).alias("only_base"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 10")
def only_primary(spark, sf_dir):
    """J3, T2."""
    return R.only_left(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").orderBy("doc_id").limit(10)


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark, sf_dir):
    """F1."""
    return table(spark, sf_dir, "part").select("p_partkey", T.slug("p_name").alias("slug"))


@query("SELECT a.p_partkey FROM part a WHERE a.p_partkey % 3 = 0")
def title_mismatch(spark, sf_dir):
    """Titles whose slug isn't the other source's task; a third of these are changed on one side."""
    a = table(spark, sf_dir, "part").select("p_partkey", T.slug("p_name").alias("slug"))
    b = table(spark, sf_dir, "part").select("p_partkey", F.concat(T.slug("p_name"), F.when(F.col("p_partkey") % 3 == 0, "-ii").otherwise("")).alias("task_id"))
    return a.join(b, "p_partkey").where(~F.col("slug").eqNullSafe(F.col("task_id"))).select("p_partkey")


@query("WITH w AS (" + WIDE_SQL + ") " + " UNION ALL ".join(f"SELECT '{x}' AS lang, count({x}) AS n FROM w" for x in LANGS))
def lang_counts(spark, sf_dir):
    """A2."""
    return A.present_counts(_wide(spark, sf_dir), LANGS)


@query("SELECT parallel_id FROM (" + WIDE_SQL + ") WHERE " + N_PRESENT + " >= 2")
def eligible(spark, sf_dir):
    """PF5."""
    return R.eligible(_wide(spark, sf_dir), LANGS).select("parallel_id")


@query(PAIRS_SQL)
def directed_pairs(spark, sf_dir):
    """J9, PF7."""
    return R.directed_pairs(_wide(spark, sf_dir), "parallel_id", LANGS)


@query("SELECT source_language, target_language, count(*) AS n, count(DISTINCT parallel_id) AS parallels FROM (" + PAIRS_SQL + ") GROUP BY 1, 2")
def pair_counts(spark, sf_dir):
    """A6."""
    return A.pair_counts(directed_pairs(spark, sf_dir), ["source_language", "target_language"], "parallel_id")


TEMPLATE_SQL = "list_extract([" + ", ".join(f"'{t}'" for t in R.TEMPLATES) + "], k + 1)"


def _code(x):
    return f"CASE {x} WHEN 'de' THEN 'cpp' WHEN 'en' THEN 'java' WHEN 'es' THEN 'python' ELSE {x} END"


def _named(x):
    return f"CASE {x} WHEN 'de' THEN 'C++' WHEN 'en' THEN 'Java' WHEN 'es' THEN 'Python' ELSE {x} END"


@query(f"SELECT parallel_id, source_language, target_language, replace(replace({TEMPLATE_SQL}, '{{source}}', {_named('source_language')}), '{{target}}', {_named('target_language')}) AS instruction FROM (SELECT *, CAST(('0x' || substr(md5('0:' || parallel_id || ':' || {_code('source_language')} || ':' || {_code('target_language')}), 1, 8)) AS BIGINT) % 10 AS k FROM (" + PAIRS_SQL + "))")
def instruction_rows(spark, sf_dir):
    """Templates chosen by hash, with the languages' names; a language without one keeps its code."""
    p = directed_pairs(spark, sf_dir)
    code = F.create_map(*[F.lit(x) for pair in (("de", "cpp"), ("en", "java"), ("es", "python"), ("fr", "fr")) for x in pair])
    return p.select("parallel_id", "source_language", "target_language", R.instruction(F.col("parallel_id"), code[F.col("source_language")], code[F.col("target_language")]).alias("instruction"))


def _held(spark, sf_dir):
    return R.split_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (" + HELD_SQL + ")")
def split_test(spark, sf_dir):
    """T3, J6."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_held(spark, sf_dir), "o_custkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (" + HELD_SQL + ")")
def split_train(spark, sf_dir):
    """T3, J7."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(_held(spark, sf_dir), "o_custkey", "left_anti")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    """W1."""
    return R.first_of(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 100")
def random_sample(spark, sf_dir):
    """T5."""
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.lit("0:"), F.col("doc_id").cast("string"))), "doc_id").limit(100).select("doc_id")


@query("WITH r AS (SELECT doc_id, lang, source, md5('0:' || doc_id) AS h, row_number() OVER (PARTITION BY lang, source ORDER BY md5('0:' || doc_id), doc_id) AS n, (SELECT greatest(1, 200 // count(*)) FROM (SELECT DISTINCT lang, source FROM documents)) AS b FROM documents) SELECT doc_id, lang, source FROM r WHERE n <= b UNION ALL SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS k FROM r WHERE n > b) WHERE k <= 200 - (SELECT count(*) FROM r WHERE n <= b)")
def stratified_sample(spark, sf_dir):
    """T4."""
    return R.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 200)


@query(r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS code FROM documents")
def fence_extract(spark, sf_dir):
    """the texts, put into a fence."""
    return table(spark, sf_dir, "documents").select("doc_id", T.fenced(F.concat(F.lit("Here:\n```python\n"), "text", F.lit("\n```\ndone"))).alias("code"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS loc, length(text) AS char_count FROM documents")
def code_length(spark, sf_dir):
    """F7."""
    return table(spark, sf_dir, "documents").select("doc_id", T.lines_of_code(F.col("text")).alias("loc"), F.length("text").cast("long").alias("char_count"))


@query(r"SELECT lang, CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def fertility_counts(spark, sf_dir):
    """A13, F5, F6."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.words(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


OUTCOME_SQL = "CASE WHEN event_type = 'view' AND value > 20 THEN 'passed' WHEN event_type = 'view' THEN 'wrong_output' WHEN user_id % 3 = 0 THEN 'redefinition' WHEN user_id % 3 = 1 THEN 'timeout' ELSE 'compile_error' END"


@query("SELECT " + OUTCOME_SQL + " AS outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def outcome_share(spark, sf_dir):
    """All five outcomes."""
    said = F.when(F.col("user_id") % 3 == 0, "error: Redefinition of 'struct ListNode'").when(F.col("user_id") % 3 == 1, "Execution timed out").otherwise("error: expected ';'")
    e = table(spark, sf_dir, "events").select(T.outcome(F.col("event_type") == "view", F.when(F.col("value") > 20, 1.0).otherwise(0.0), said).alias("outcome"))
    return A.shares(e, "outcome")


@query("SELECT event_type, round(avg(value) FILTER (WHERE user_id % 2 = 1) - avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS delta FROM events GROUP BY 1")
def run_delta(spark, sf_dir):
    """A17."""
    return A.deltas(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), F.col("user_id") % 2, 0, 1).select("event_type", "delta")


@query("SELECT event_type AS outcome, count(*) FILTER (WHERE user_id % 2 = 0) AS base, count(*) FILTER (WHERE user_id % 2 = 1) AS ft, round(count(*) FILTER (WHERE user_id % 2 = 0) / sum(count(*) FILTER (WHERE user_id % 2 = 0)) OVER (), 6) AS base_share, round(count(*) FILTER (WHERE user_id % 2 = 1) / sum(count(*) FILTER (WHERE user_id % 2 = 1)) OVER (), 6) AS ft_share FROM events GROUP BY 1")
def cross_run_summary(spark, sf_dir):
    """A16."""
    return A.by_run(table(spark, sf_dir, "events").withColumnRenamed("event_type", "outcome"), "outcome", F.col("user_id") % 2, [("base", 0), ("ft", 1)])


@query("SELECT round(exp(sum(value * 0.001 * l) / sum(l)), 9) AS perplexity FROM (SELECT value, 1 + user_id % 7 AS l FROM events)")
def perplexity(spark, sf_dir):
    """Weighted by tokens."""
    return A.perplexity(table(spark, sf_dir, "events"), F.col("value") * 0.001, 1 + F.col("user_id") % 7)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_metric(spark, sf_dir):
    """F22."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT doc_id, '{"input": [' || doc_id || ', ' || n_chars || '], "expected": [' || n_chars || ']}' AS pair FROM documents UNION ALL SELECT doc_id, '{"input": [[1, null]], "expected": -Infinity}' FROM documents WHERE doc_id % 2 = 0""")
def parse_asserts(spark, sf_dir):
    """Asserts of three shapes over document ids and lengths; what is no such assert is left out."""
    more = F.when(F.col("doc_id") % 2 == 0, "    assert is_same(candidate(tree_node([1, None])), -inf)\n    assert True\n    assert f(x) == 1\n").otherwise("")
    src = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.format_string("def check(candidate):\n    assert candidate(%d, n = %d) == [%d]\n", "doc_id", "n_chars", "n_chars"), more).alias("src"))
    return src.select("doc_id", F.explode(C.parse_asserts("src")).alias("pair"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0 AND d.lang = 'en')")
def exclusions_anti(spark, sf_dir):
    """By a key of two columns."""
    out = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("en").alias("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(out, ["doc_id", "lang"], "left_anti")


@query("SELECT d.lang, d.source, count(*) AS n, round(avg(CASE WHEN l.quality = 1 - l.toxic THEN 1.0 ELSE 0.0 END), 9) AS agree FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2")
def audit_agreement(spark, sf_dir):
    """A10, F20."""
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return A.rates_by(x, ["lang", "source"], F.col("quality").eqNullSafe(1 - F.col("toxic")), "agree")


@query("SELECT 'quality' AS side, CAST(quality AS VARCHAR) AS outcome, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY 2")
def audit_hist(spark, sf_dir):
    """A11."""
    x = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return A.marginals(x, ["quality", "toxic"])


@query("SELECT event_type AS config, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 9) AS pass_at_1, count(*) AS n FROM events GROUP BY 1")
def code_bench_pass1(spark, sf_dir):
    """A12."""
    return A.rates_by(table(spark, sf_dir, "events").withColumnRenamed("event_type", "config"), ["config"], F.col("value") > 20, "pass_at_1")


@query("SELECT round(sum(n * rate) / sum(n), 6) AS overall, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n, avg(value) AS rate FROM events GROUP BY 1)")
def overall_weighted(spark, sf_dir):
    """Cells weighted by their rows."""
    cells = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("rate"))
    return A.overall(cells, "rate")


@query("SELECT d.doc_id, CASE WHEN d.n_chars % 5 = 0 THEN 0.0 ELSE least(d.doc_id % 7, 1 + d.n_chars % 3) / (1.0 + d.n_chars % 3) END AS rate FROM documents d")
def pass_rate(spark, sf_dir):
    """passed among the first expected ones, by the number expected; 0 where either is empty."""
    got = F.when(F.col("n_chars") % 5 == 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: i <= F.col("doc_id") % 7))
    d = table(spark, sf_dir, "documents").select("doc_id", got.alias("got"), (1 + F.col("n_chars") % 3).cast("int").alias("want"))
    return d.select("doc_id", T.correctness("got", F.col("want")).alias("rate"))


@query("SELECT m.metric, round(avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS base, round(avg(value) FILTER (WHERE user_id % 2 = 1), 6) AS ft FROM (VALUES ('click'), ('view'), ('purchase'), ('none')) m(metric) LEFT JOIN events ON event_type = m.metric GROUP BY 1")
def metric_long(spark, sf_dir):
    """A fixed list of metrics keeps those without a value."""
    run = F.col("user_id") % 2
    got = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg(F.when(run == 0, F.col("value"))), 6).alias("base"), F.round(F.avg(F.when(run == 1, F.col("value"))), 6).alias("ft"))
    return A.on_list(got, "metric", ["click", "view", "purchase", "none"])


@query("SELECT a.doc_id, a.n_chars, b.turn FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents) a JOIN (SELECT turn, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations) b USING (i)")
def positional_zip(spark, sf_dir):
    """Rows paired by explicit ordinals, as many as the shorter side has."""
    return R.numbered(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"]).join(R.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"]), "ordinal").select("doc_id", "n_chars", "turn")


@query(r"SELECT tokenizer, round(CAST(sum(tokens) AS DOUBLE) / sum(words), 9) AS tokens_per_word, round(CAST(sum(chars) AS DOUBLE) / sum(tokens), 9) AS chars_per_token, round(CAST(sum(bytes) AS DOUBLE) / sum(tokens), 9) AS bytes_per_token FROM (SELECT unnest(['word', 'space', 'char']) AS tokenizer, unnest([len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), len(regexp_extract_all(text, '\S+')), length(text)]) AS tokens, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words, length(text) AS chars, strlen(text) AS bytes FROM documents) GROUP BY 1")
def fertility(spark, sf_dir):
    """Ratios of sums for each tokenizer; every text is read once."""
    t = F.col("text")
    x = table(spark, sf_dir, "documents").select(T.words(t).alias("word"), F.regexp_count(t, F.lit(r"\S+")).alias("space"), F.length(t).alias("char"), T.words(t).alias("words"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"))
    return A.fertility(x, ["word", "space", "char"])


@query("SELECT item_id, true AS compiled, CAST(1 AS INTEGER) AS results, CASE WHEN item_id % 3 = 1 THEN 'passed' ELSE 'wrong_output' END AS outcome FROM benchmark")
def exec_score(spark, sf_dir):
    """A program for every benchmark item, run and classified."""
    code = "class Solution:\n    def solve(self, a: int) -> int:\n        return a % 3\n"
    items = table(spark, sf_dir, "benchmark").select("item_id", F.format_string('[{"input": [%d], "expected": 1}]', "item_id").alias("pairs"))
    engine = G.build_driver(F.lit("python"), "pairs", F.lit(code), F.lit("solve"), F.lit(None).cast("string"))
    src = items.select("item_id", engine.alias("engine")).select("item_id", G.wire(F.lit(code), "engine", F.lit("python")).alias("program"))
    ran = E.scored(X.execute(src, "item_id", "program", timeout=60.0, tasks=8), F.lit(1))
    return ran.select("item_id", (F.col("compiled") == 1).alias("compiled"), F.size("passed").alias("results"), "outcome")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS ordinal, 'x' AS drawn FROM orders WHERE o_orderkey < 200")
def drawn_templates(spark, sf_dir):
    """Templates that a seeded generator draws one after another; here there is one to draw from."""
    o = table(spark, sf_dir, "orders").where("o_orderkey < 200").select("o_orderkey", "o_custkey", F.lit("cpp").alias("source_language"), F.lit("java").alias("target_language"))
    x = R.instructed(o, ["o_orderkey"], templates=("x",))
    return R.numbered(x, ["o_orderkey"]).select("o_orderkey", "o_custkey", F.col("ordinal"), F.col("instruction").alias("drawn"))


from lamplight.plans import evaluation  # noqa: E402, F401  registers its queries
