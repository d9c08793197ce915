"""From parallel solutions to translations that can be executed, and what becomes of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from lamplight.functions import codegen, text
from lamplight.functions.code import assertions
from lamplight.functions.codegen import convertible
from lamplight.functions.signatures import hints, kind_of
from lamplight.operators import relational

#: The languages that a translation can be executed in.
LANGS = ["cpp", "java", "python"]
REASONS = ["skipped_no_test", "skipped_no_test_cases", "skipped_no_python_reference", "skipped_no_convertible_input_output_pairs", "skipped_no_expected_output"]
SEEN = StructType().add("parsed", "integer").add("usable", "integer").add("unusable", "integer").add("nodes", "boolean").add("silent", "boolean").add("pairs", "string")


@F.pandas_udf(SEEN)
def looked_at(test: pd.Series, python: pd.Series, entry_point: pd.Series) -> pd.DataFrame:
    """What a row's test and reference hold: pairs, those that convert, whether nodes go in or out."""

    def one(t, p, e):
        pairs = assertions(t)
        parameters, result = hints(p, e)
        kinds, back = [kind_of(h) for h in parameters], kind_of(result)
        own = [x for x in pairs if convertible(x, kinds, back)]
        silent = back == "plain" and all(x["expected"] is None for x in own)
        return len(pairs), len(own), len(pairs) - len(own), {back, *kinds} != {"plain"}, silent, json.dumps(own)

    return pd.DataFrame([one(*x) for x in zip(test, python, entry_point)], columns=["parsed", "usable", "unusable", "nodes", "silent", "pairs"])


def examined(parallels: DataFrame, langs: list[str] = LANGS) -> DataFrame:
    """PF6, PF9: every row with what looked_at says of it, its present languages, and the first reason to skip it (null
    if it is kept)."""
    there = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    x = parallels.withColumn("seen", looked_at("test", "python", "entry_point")).select("*", "seen.*").drop("seen")
    reason = F.when(~there("test"), REASONS[0]).when(F.col("parsed") == 0, REASONS[1]).when(~there("python"), REASONS[2]).when(F.col("usable") == 0, REASONS[3]).when(F.col("silent"), REASONS[4])
    return x.withColumn("present", relational.present(parallels, langs)).withColumn("reason", reason)


def targets(examined_: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The kept rows by target language, and whether the quality audit excludes it there."""
    out = exclusions.select("parallel_id", "target_language").distinct().withColumn("excluded", F.lit(True))
    x = examined_.where("reason IS NULL").withColumn("target_language", F.explode("present"))
    return x.join(out, ["parallel_id", "target_language"], "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def translations(examined_: DataFrame, exclusions: DataFrame, langs: list[str] = LANGS, seed: int = 0) -> DataFrame:
    """The executable translations: every other present language to each target that isn't excluded, with the driver that
    runs it, which is built once a target."""
    x = targets(examined_, exclusions).where("NOT excluded")
    text_of = lambda side: F.coalesce(*[F.when(F.col(side) == c, F.col(c)) for c in langs])
    java = F.when(F.col("target_language") == "java", F.col("java"))
    x = x.withColumn("execution_engine", codegen.build_driver("target_language", "pairs", "python", "entry_point", java))
    x = x.withColumn("source_language", F.explode("present")).where("source_language <> target_language")
    return x.select("parallel_id", "source_language", "target_language", relational.instruction(F.col("parallel_id"), F.col("source_language"), F.col("target_language"), seed).alias("instruction"), text_of("source_language").alias("code_snippet_to_translate"), text_of("target_language").alias("expected_code_snippet_translation"), "execution_engine", F.col("pairs").alias("expected_input_output_pairs"), *([c for c in ["difficulty"] if c in x.columns]))


def usability(examined_: DataFrame, exclusions: DataFrame) -> DataFrame:
    """A6, SO3: one row: how many rows each reason skips, how many targets the audit excludes, and of what is kept the
    payloads, those with nodes, the pairs, the parallels (ids of any target, each once) and the pairs of a parallel."""
    per_id = targets(examined_, exclusions).groupBy("parallel_id").agg(
        F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded")).alias("open"), F.first(F.size("present")).alias("present"), F.first("nodes").alias("nodes"))
    payloads = F.col("open") * (F.col("present") - 1)
    kept = per_id.agg(
        F.coalesce(F.sum("excluded"), F.lit(0)).alias("excluded_by_quality_audit"), F.coalesce(F.sum(payloads), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("nodes"), payloads)), F.lit(0)).alias("kept_with_node_types"), F.count_if(payloads > 0).alias("kept_parallels"))
    reached = F.col("reason").isNull() | F.col("reason").isin(REASONS[3:])
    rows = examined_.agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS], F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("usable"))), F.lit(0)).alias("kept_input_output_pair_count"),
        F.coalesce(F.sum(F.when(reached, F.col("unusable"))), F.lit(0)).alias("unconvertible_input_output_pair_count"))
    return rows.crossJoin(kept).withColumn("pairs_per_parallel", F.round(F.coalesce(F.try_divide("kept_input_output_pair_count", "kept_parallels"), F.lit(0.0)), 6))


def usable_by_target(examined_: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Payloads and distinct parallels of each target language."""
    x = targets(examined_, exclusions).where("NOT excluded AND size(present) > 1")
    return x.groupBy("target_language").agg(F.sum(F.size("present") - 1).alias("payloads"), F.countDistinct("parallel_id").alias("parallels"))


def validation_outcome(compiled: Column, passed: Column, expected: Column) -> Column:
    """Of a run's results and the number of pairs it should tell of."""
    return F.when(~compiled, "compile_error").when(F.size(passed) != expected, "count_mismatch").when(F.forall(passed, lambda x: x), "passed").otherwise("failed_cases")


def audit(rows: DataFrame, first: str, second: str, completion: str) -> DataFrame:
    """the second source's outcome, 'no_completion' where it has no text, and whether both agree."""
    other = F.when(F.coalesce(F.length(completion), F.lit(0)) == 0, "no_completion").otherwise(F.col(second))
    return rows.withColumn(second, other).withColumn("agree", F.col(first).eqNullSafe(F.col(second)))


def scored(ran: DataFrame, expected: Column) -> DataFrame:
    """A run's compiled (1 or 0), share of its pairs that passed, pass@1, outcome and short diagnostics."""
    rate = text.correctness("passed", expected)
    return ran.withColumn("test_pass_rate", F.when(F.col("compiled"), rate).otherwise(0.0)).withColumn("outcome", text.outcome(F.col("compiled"), F.col("test_pass_rate"), F.col("diagnostics"))).withColumns({"pass_at_1": text.all_or_nothing("test_pass_rate"), "compiled": text.one_or_zero("compiled"), "diagnostics": text.truncated("diagnostics")})
