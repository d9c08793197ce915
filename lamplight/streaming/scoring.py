"""An extension: the summary of scored samples over files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def summary(samples: DataFrame, keys: list[str], every: str | None = None, late: str = "1 hour") -> DataFrame:
    """A1, over a stream or a table: rates of each cell, and of each window of ts where every is given."""
    by = list(keys)
    if every:
        samples, by = samples.withWatermark("ts", late), [F.window("ts", every), *keys]
    return samples.groupBy(*by).agg(F.count("*").alias("n"), F.avg("compiled").alias("compiled"), F.avg("test_pass_rate").alias("test_pass_rate"))


def to_parquet(result: DataFrame, path: str, checkpoint: str):
    """Runs over all that is there, then ends; a batch that is run again replaces itself."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
