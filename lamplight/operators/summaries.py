"""Aggregations of scored samples, audits and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RATES = {"compile_rate": "compiled", "mean_rate": "test_pass_rate", "pass_at_1": "pass_at_1"}


def cells(samples: DataFrame, by: list[str], rates: dict[str, str] = RATES, places: int = 6) -> DataFrame:
    """A1: n and the means of the rates of each cell; of by and rates, those that the samples have."""
    by = [c for c in by if c in samples.columns]
    return samples.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), places).alias(name) for name, c in rates.items() if c in samples.columns])


def present_counts(wide: DataFrame, columns: list[str]) -> DataFrame:
    """A2: how many rows have each column; one pass."""
    return wide.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "lang", "n")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A3: rows of each value, null being one."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """A4: rows that have the column, all rows, and the ratio."""
    return df.agg(F.count(column).alias("covered"), F.count("*").alias("total"), F.try_divide(F.count(column), F.count("*")).alias("ratio"))


def distinct_keys(key: str, **sides: DataFrame) -> DataFrame:
    """A5: distinct keys of each side."""
    rows = None
    for name, df in sides.items():
        x = df.select(F.lit(name).alias("side"), key)
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy("side").agg(F.countDistinct(key).alias("keys"))


def pair_counts(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    """Pairs and distinct keys of each direction."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(key).alias("parallels"))


def shares(df: DataFrame, column: str, places: int = 9) -> DataFrame:
    """Rows of each outcome and their share of all; only the counts meet in one task."""
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.expr("sum(n) OVER ()"), places))


def rates_by(df: DataFrame, by: list[str], hit: Column, name: str = "rate", places: int = 9) -> DataFrame:
    """Rows of each group, and the share of them for which hit holds (null doesn't)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), places).alias(name))


def failures(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Rows of each outcome but 'passed'."""
    return df.where(F.col(outcome) != "passed").groupBy(outcome).agg(F.count("*").alias("n"))


def marginals(df: DataFrame, columns: list[str]) -> DataFrame:
    """The counts of each column's own values."""
    return df.select(*columns).unpivot([], columns, "side", "outcome").groupBy("side", "outcome").agg(F.count("*").alias("n"))


def perplexity(df: DataFrame, loss: Column, tokens: Column, places: int = 9) -> DataFrame:
    """Of the mean loss of a token, so weighted by tokens; null without tokens."""
    return df.agg(F.round(F.exp(F.try_divide(F.sum(loss * tokens), F.sum(tokens))), places).alias("perplexity"))


def overall(cells_: DataFrame, rate: str, places: int = 6) -> DataFrame:
    """The mean of cells, weighted by their rows."""
    return cells_.agg(F.round(F.try_divide(F.sum(F.col("n") * F.col(rate)), F.sum("n")), places).alias("overall"), F.sum("n").alias("n"))


def by_run(df: DataFrame, column: str, run: Column, runs: list, places: int = 6) -> DataFrame:
    """Rows of each outcome in each run, and their share of the run's rows."""
    x = df.groupBy(column).agg(*[F.count_if(run == value).alias(str(name)) for name, value in runs])
    return x.select(column, *[F.col(str(n)) for n, _ in runs], *[F.round(F.try_divide(F.col(str(n)), F.expr(f"sum(`{n}`) OVER ()")), places).alias(f"{n}_share") for n, _ in runs])


def deltas(df: DataFrame, by: list[str], value: Column, run: Column, base, tuned, lower_is_better: Column | None = None, places: int = 6) -> DataFrame:
    """The mean of each run and how much better the tuned one is: the difference, with its sign turned where lower
    is better; null where a run has no value."""
    mean = lambda x: F.avg(F.when(run == x, value))
    turn = F.when(F.max(lower_is_better), -1.0).otherwise(1.0) if lower_is_better is not None else F.lit(1.0)
    return df.groupBy(*by).agg(F.round(mean(base), places).alias("base"), F.round(mean(tuned), places).alias("ft"), F.round((mean(tuned) - mean(base)) * turn, places).alias("delta"))


def on_list(values: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The values of a fixed list of metrics, in which those without a value stay."""
    return values.sparkSession.createDataFrame([(x,) for x in names], f"{key} string").join(values, key, "left")


def fertility(counts: DataFrame, tokenizers: list[str], sizes: tuple[str, ...] = ("words", "chars", "bytes"), places: int = 9) -> DataFrame:
    """Ratios of sums, never means of ratios: tokens a word, characters and bytes a token, for each tokenizer
    (a column of token counts), from one pass over the rows; null where the divisor is 0."""
    sums = counts.agg(*[F.sum(c).alias(c) for c in dict.fromkeys([*tokenizers, *sizes])])
    x = sums.select(*[F.col(s).alias(f"__{s}") for s in sizes], *tokenizers).unpivot([f"__{s}" for s in sizes], tokenizers, "tokenizer", "tokens")
    ratio = {"words": ("tokens_per_word", F.try_divide("tokens", "__words")), "chars": ("chars_per_token", F.try_divide("__chars", "tokens")), "bytes": ("bytes_per_token", F.try_divide("__bytes", "tokens"))}
    return x.select("tokenizer", *[F.round(ratio[s][1], places).alias(ratio[s][0]) for s in sizes])
