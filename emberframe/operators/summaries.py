"""Summaries of runs and of interference sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators.pixels import stage_counts
from emberframe.operators.ranking import confidence_counts


def run_summary(
    judged: DataFrame, fires: DataFrame, areas: DataFrame | None = None, ranges: DataFrame | None = None
) -> DataFrame:
    """A row per scene with a seed: stages, pixels and areas of fire, those that official detections confirm, confidences;
    with ``ranges`` (official detections with ``matched``) also how many there are and how many a fire matched, over all
    scenes. A scene without fires has zeros."""
    pixels = fires.groupBy("scene_id").agg(
        F.count("*").alias("fire_pixel_count"),
        F.count_if(F.coalesce("official_confirmed", F.lit(False))).alias("official_confirmed_pixel_count")
    )
    parts = [pixels, confidence_counts(fires)]
    if areas is not None:
        parts.append(areas.groupBy("scene_id").agg(F.count("*").alias("fire_cluster_count")))
    out = stage_counts(judged)
    for part in parts:
        out = out.join(part, "scene_id", "left")
    out = out.fillna(0)
    if ranges is None:
        return out
    official = ranges.agg(
        F.count("*").alias("official_reference_count"), F.count_if("matched").alias("official_matched_count")
    )
    return out.crossJoin(F.broadcast(official))  # one row


def interference_summary(plants: DataFrame, hits: DataFrame, persistent: DataFrame, static: DataFrame) -> DataFrame:
    """One row: plants and their capacity, thermal hits and the dates that they span, persistent places among them, static
    sources, and how many sources are rejected without a look (static ones and plants)."""
    one = plants.agg(
        F.count("*").alias("plant_count"),
        F.round(F.coalesce(F.sum("capacity_mw"), F.lit(0.0)), 2).alias("total_capacity_mw")
    )
    spans = hits.agg(
        F.count("*").alias("hit_count"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date")
    )
    counts = [persistent.agg(F.count("*").alias("persistent_count")), static.agg(F.count("*").alias("static_count"))]
    for part in (spans, *counts):
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one.withColumn("automatic_count", F.col("static_count") + F.col("plant_count"))
