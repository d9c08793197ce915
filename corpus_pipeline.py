"""The corpus pipeline: five stages, each working on all that the one before kept.

Every stage decides by row, so that null or repeated ids make no difference, returns the columns it is given (mixing adds
mix_epoch), and on an empty table returns an empty one. How nulls, empty and long texts, ties, repeated rows and clashing
names fare is told by the functions called here: quality.kept, simhash.kept, decontaminate.kept, secrets.kept and
mixing.mixed. SQL can't express the stages before mixing; tests compare them with brute-force versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lamplight.llm import decontaminate, mixing, quality, secrets, simhash
from lamplight.llm.common import remove, shared_dir, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, null and empty texts not among them."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.kept(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without credentials."""
    return secrets.kept(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, once for each epoch that takes them."""
    return mixing.mixed(docs)


STAGES = [("quality", good), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", without_secrets), ("mixing", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep. Each stage's rows are written to the shared folder and reread; those that the
    next stage has used are deleted."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(here), here
    return docs
