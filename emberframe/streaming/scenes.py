"""Scenes as a stream: micro-batches of pixels, slots, late data, rolling state, interval joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberframe.operators import temporal
from emberframe.sources.sinks import write_scene


def slot_counts(
    stream: DataFrame, minutes: int = 10, late_minutes: int = 60, ts: str = "ts", by: tuple[str, ...] = ()
) -> DataFrame:
    """Events per tumbling slot; events later than the watermark are dropped and state older than it is freed."""
    return stream.withWatermark(ts, f"{late_minutes} minutes").groupBy(F.window(ts, f"{minutes} minutes"), *by).agg(
        F.count("*").alias("n"), F.max("value").alias("max_value")
    ).select(F.col("window.start").alias("slot"), *by, "n", "max_value")


def distinct_events(stream: DataFrame, keys: list[str], late_minutes: int = 60, ts: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, f"{late_minutes} minutes").dropDuplicatesWithinWatermark(keys)


def interval_join(fires: DataFrame, references: DataFrame, hours: int = 3, late_minutes: int = 60) -> DataFrame:
    """Fires with the official detections of their cell (cell, acq_ts; r_cell, r_ts) within ``hours``, as streams on both
    sides; the watermarks and the interval bound the state."""
    f = fires.withWatermark("acq_ts", f"{late_minutes} minutes")
    r = references.withWatermark("r_ts", f"{late_minutes} minutes")
    near = F.expr(f"r_ts >= acq_ts - interval {hours} hours AND r_ts <= acq_ts + interval {hours} hours")
    return f.join(r, (F.col("cell") == F.col("r_cell")) & near)


def run_scenes(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, fail_open: bool = True,
    available_now: bool = True
) -> StreamingQuery:
    """Process each micro-batch's scenes as a table and replace their partitions, so a batch that is replayed changes
    nothing. With ``fail_open`` a failing batch leaves the last good partitions in place and the stream goes on."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            scenes = [
                r["scene_id"] for r in batch.select(
                    F.col("scene_id").cast("string").alias("scene_id")
                ).distinct().collect()
            ]
            if scenes:
                write_scene(process(batch), target, scenes)
        except Exception as error:  # noqa: BLE001  the policy of the caller
            if not fail_open:
                raise
            print(f"batch {number} failed, its scenes keep their last result: {error}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 minutes")).start()


def roll_state(
    stream: DataFrame, target: str, checkpoint: str, degrees: float = 0.05, keep: int = 400
) -> StreamingQuery:
    """Keep the grid state of the latest slots as a table per batch; a slot that comes again is replaced."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        new = temporal.grid_state(batch, degrees)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(target)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        versions = sorted(
            int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder)
        ) if fs.exists(folder) else []
        before = [v for v in versions if v < number]
        state = new if not before else temporal.merge_state(spark.read.parquet(f"{target}/batch={before[-1]}"), new)
        temporal.latest_slots(state, keep).write.mode("overwrite").parquet(f"{target}/batch={number}")
        for v in before[:-1]:  # the one before stays for readers
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{target}/batch={v}"), True)

    return stream.writeStream.foreachBatch(step).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def latest_state(spark, target: str) -> DataFrame:
    """The newest table that ``roll_state`` wrote."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(target)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder))
    return spark.read.parquet(f"{target}/batch={last}")
