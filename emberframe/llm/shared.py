"""Intermediate tables in the folder that all executors share: the library's, under the names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberframe.operators.tables import discard
from emberframe.operators.tables import kept as materialize

__all__ = ["discard", "materialize", "shuffle_partitions", "small_batches"]

#: Most rows that a Python worker gets at once where rows hold whole texts: some MB of usual texts.
TEXT_ROWS = 1000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts are about to be sent to Python: the session's batches are brought down to ``TEXT_ROWS`` rows, so
    that a worker's memory follows a few MB of text and not ten thousand texts."""
    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    now = int(spark.conf.get(name))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)
    return df
