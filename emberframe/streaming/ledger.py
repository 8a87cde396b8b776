"""Results of batches that are done once: a ledger says which batch made what of which scenes, and readers follow it.

A batch writes its result to a folder of its own attempt. What makes it count is one file of the ledger, put in its place by a
rename: it names the batch, its scenes, the digest of its settings and the attempt. A batch that was killed before has left an
attempt that nobody reads, and is done again; one that was killed after is in the ledger and is not.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ENTRY = "batch long, digest string, attempt string, scenes array<string>"


def digest(settings: Any) -> str:
    """A digest of settings (a dataclass, or what JSON can say), whatever the order of their names."""
    given = asdict(settings) if is_dataclass(settings) else settings
    return hashlib.sha256(json.dumps(given, sort_keys=True, default=str).encode()).hexdigest()


def _files(spark: SparkSession, folder: str):
    """(path constructor, file system) of Hadoop for a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def entry_name(batch: int, settings: str) -> str:
    return f"{batch:019d}-{settings}.json"


def is_done(spark: SparkSession, target: str, batch: int, settings: str) -> bool:
    """Whether the ledger has the batch with these settings."""
    path, fs = _files(spark, target)
    return fs.exists(path(f"{target}/ledger/{entry_name(batch, settings)}"))


def commit(spark: SparkSession, target: str, batch: int, settings: str, attempt: str, scenes: list[str]) -> None:
    """Put a batch in the ledger. Of two that try, one succeeds; the other's attempt is read by nobody."""
    path, fs = _files(spark, target)
    final = path(f"{target}/ledger/{entry_name(batch, settings)}")
    fs.mkdirs(final.getParent())
    waiting = path(f"{target}/ledger/_{attempt}")
    out = fs.create(waiting, True)
    line = {"batch": batch, "digest": settings, "attempt": attempt, "scenes": sorted(scenes)}
    out.write(bytearray((json.dumps(line) + "\n").encode()))
    out.close()
    if not fs.rename(waiting, final):
        fs.delete(waiting, False)


def run_once(
    batch: DataFrame, number: int, process: Callable[[DataFrame], DataFrame], target: str, settings: Any = None
) -> bool:
    """Process a batch's scenes (scene_id) unless the ledger has it with these settings; whether it was done now."""
    spark, said = batch.sparkSession, digest(settings)
    if is_done(spark, target, number, said):
        return False
    scenes = [
        r["scene_id"] for r in batch.select(F.col("scene_id").cast("string").alias("scene_id")).distinct().collect()
    ]
    if not scenes:
        return False
    attempt = uuid.uuid4().hex
    out = process(batch)
    out.withColumn("scene_id", F.col("scene_id").cast("string")).write.parquet(f"{target}/data/attempt={attempt}")
    commit(spark, target, number, said, attempt, scenes)
    return True


def run_scenes(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, settings: Any = None
) -> StreamingQuery:
    """``run_once`` for each micro-batch of all that is there now."""
    writer = stream.writeStream.foreachBatch(lambda b, n: run_once(b, n, process, target, settings) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries(spark: SparkSession, target: str) -> DataFrame:
    """(batch, digest, attempt, scenes) of all batches that are done."""
    path, fs = _files(spark, target)
    if not fs.exists(path(f"{target}/ledger")):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{target}/ledger")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The rows of every scene as its last batch made them; scenes that it left empty have none."""
    named = entries(spark, target).select("batch", "attempt", F.explode("scenes").alias("scene_id"))
    last = Window.partitionBy("scene_id").orderBy(F.desc("batch"), F.desc("attempt"))
    named = named.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("attempt", "scene_id")
    data = spark.read.parquet(f"{target}/data")
    return data.withColumn("attempt", F.col("attempt").cast("string")).join(
        named, ["attempt", "scene_id"], "left_semi"
    ).drop("attempt")


def attempts_without_entry(spark: SparkSession, target: str) -> DataFrame:
    """(attempt): results of batches that were killed, which may be deleted while no batch runs."""
    path, fs = _files(spark, target)
    found = [
        (s.getPath().getName().partition("=")[2],) for s in fs.listStatus(path(f"{target}/data"))
    ] if fs.exists(path(f"{target}/data")) else []
    return spark.createDataFrame(found, "attempt string").join(entries(spark, target), "attempt", "left_anti")
