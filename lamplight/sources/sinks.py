"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """SNK1: zstd Parquet; one file only where files=1 is asked for."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def json_text(df: DataFrame, order: list[str]) -> str:
    """SNK2: a report of few rows as an indented JSON array of records, nulls included."""
    rows = [r[0] for r in df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()]
    return "[" + ",".join(f"\n  {r}" for r in rows) + ("\n" if rows else "") + "]\n"


def json_lines(df: DataFrame, path: str) -> None:
    """SNK2, for tables of any size: a record a line."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def with_summary(samples: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """SNK3: one document with the summary by key and all samples; for reports, whose rows fit in one."""
    fields = [c for c in summary.columns if c != key]
    s = summary.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.struct(*fields).alias("v"))))).alias("summary"))
    return s.crossJoin(samples.agg(F.sort_array(F.collect_list(F.struct(*samples.columns))).alias("samples"))).select(F.to_json(F.struct("summary", "samples")).alias("document"))


def text(document: str, df: DataFrame, path: str) -> None:
    """One document as a file in the folder, through Spark's file systems."""
    df.sparkSession.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK5, SO5: the old rows, and the new ones whose keys they lack."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def markdown(df: DataFrame) -> str:
    """SNK4: a report of few rows as a table."""
    rows = [df.columns, ["---"] * len(df.columns), *[["—" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r] for r in df.toLocalIterator()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
