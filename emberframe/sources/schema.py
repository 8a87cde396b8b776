"""Schemas of the relations that the operators exchange. A missing value is null, never NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns by relation.
DDL = {
    "pixel": "scene_id string, acq_ts timestamp, slot_ord int, row int, col int, lon float, lat float, b07 float, b13 float, b14 float, rvis float, roi boolean, non_vegetation boolean, altitude float, zenith float",
    "fire": "fire_id string, scene_id string, source_sat string, acq_ts timestamp, row int, col int, lon double, lat double, daynight string, fire_status string, confidence string, score double, bt_tir double, bt_dif double, tier string, official_confirmed boolean, model_prob double",
    "reference": "id string, sensor string, lon double, lat double, acq_ts timestamp, confidence string, frp double, scan_km double, track_km double, fire_type string, ingest_order long",
    "thermal_point": "lon double, lat double, radius_km double",
    "polygon": "polygon_id long, rings array<array<struct<x:double,y:double>>>, min_x double, max_x double, min_y double, max_y double",
    "grid_state": "glon int, glat int, slot_ord int, max_bt07_k double, max_t713_k double, n_cand long, max_area double",
    "segment_file": "path string, scene_id string, satellite string, band string, segment int, content binary",
    "weather_point": "lat double, lon double, ts array<long>, series map<string,array<double>>, units map<string,string>",
    "raw_scene": "scene_id long, source_sat string, acq_time timestamp, band string, scene_path string, file_size long, checksum string, download_time timestamp, download_status string, ingest_status string, roi_code string",
    "manifest_file": "path string, size long, sha256 string",
}


def schema(relation: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[relation])


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], schema(relation))


def conformed(df: DataFrame, relation: str) -> DataFrame:
    """``df`` with the relation's columns: cast, missing ones as null, others kept behind them."""
    from pyspark.sql import functions as F

    own = schema(relation)
    known = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in own]
    return df.select(*known, *[c for c in df.columns if c not in own.names])
