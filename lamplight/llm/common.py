"""What the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 1_000_000  # of a few numbers each, in a table that is sent to every executor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine, as in tests, may go without the setting."""
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        at = tempfile.mkdtemp(prefix="lamplight-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    at = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.parquet(at)
    out.stored_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables; nothing may read them afterwards."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that no name clashes, has a dot or differs by case alone."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """The name in plain(df) of a column."""
    return f"c{df.columns.index(name)}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, whatever others there are."""
    return plain(df).select(*[F.col(at(df, n)).alias(n) for n in names])


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint, if it has so few rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def released(work):
    """work for mapInPandas, after which a task gives the memory that it no longer uses back to the machine; Python
    workers live on and would hold it."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
