"""Writers: GeoJSON, scene partitions, summaries, manifests, grids for other tools."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def point_geometry(lon="lon", lat="lat") -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))


def polygon_geometry(ring: str) -> Column:
    return F.struct(
        F.lit("Polygon").alias("type"),
        F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")
    )


def multipolygon_geometry(rings: str) -> Column:
    return F.struct(
        F.lit("MultiPolygon").alias("type"),
        F.transform(rings, lambda r: F.array(F.transform(r, lambda p: F.array(p["x"], p["y"])))).alias("coordinates")
    )


def feature_rows(df: DataFrame, geometry: Column, properties: list[str] | None = None) -> DataFrame:
    """(feature): one GeoJSON feature per row; nested structs among the properties are spread out, nulls kept."""
    names = properties or df.columns
    spread: list[Column] = []
    for n in names:
        kind = df.schema[n].dataType
        spread += [F.col(f"{n}.{f}").alias(f) for f in kind.names] if kind.typeName() == "struct" else [F.col(n)]
    return df.select(
        F.to_json(
            F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*spread).alias("properties")),
            {"ignoreNullFields": "false"}
        ).alias("feature")
    )


def write_features(df: DataFrame, geometry: Column, path: str, properties: list[str] | None = None) -> None:
    """Features as lines of JSON, written by all tasks."""
    feature_rows(df, geometry, properties).write.mode("overwrite").text(path)


def feature_collection(
    df: DataFrame, geometry: Column, properties: list[str] | None = None, order: list[Column] | None = None
) -> DataFrame:
    """One row: a whole FeatureCollection. For results of a scene, which are small; large tables have ``write_features``."""
    rows = feature_rows(df if order is None else df.orderBy(*order), geometry, properties)
    parts = rows.agg(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['),
            F.coalesce(F.array_join(F.collect_list("feature"), ","), F.lit("")), F.lit("]}")
        ).alias("json")
    )
    return parts


def with_detail(df: DataFrame, columns: list[str], name: str = "detail") -> DataFrame:
    """``df`` with ``columns`` packed as one JSON text, nulls kept, in place of them."""
    packed = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name)
    return df.select(*[c for c in df.columns if c not in columns], packed)


def write_scene(df: DataFrame, path: str, scenes: list[str] | None = None) -> None:
    """Replace the scenes' partitions. A scene without rows any more loses its partition too, so a replay is idempotent."""
    spark, seen = df.sparkSession, Observation()
    # the scenes that have rows are told by the write itself; there are as many as partitions
    told = df.observe(seen, F.collect_set(F.col("scene_id").cast("string")).alias("scenes"))
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(path)
    if scenes:
        have = set(seen.get["scenes"])
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for s in set(scenes) - have:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/scene_id={s}")
            folder.getFileSystem(conf).delete(folder, True)


def write_summary(df: DataFrame, path: str) -> None:
    """A table of a few rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def grid_file(
    pixels: DataFrame, fires: DataFrame, height: int, width: int, line_start: int, col_start: int, acquisition_time: str
) -> bytes:
    """A compressed numpy archive of one scene (fire_mask, fire_score, observation_valid, cloud_mask, offsets): an export
    of a grid whose size is known, made on the driver."""
    out = {
        "fire_mask": np.zeros((height, width), np.uint8), "fire_score": np.zeros((height, width), np.float16),
        "observation_valid": np.zeros((height, width), np.uint8), "cloud_mask": np.zeros((height, width), np.uint8)
    }
    p = pixels.filter("clear or cloud").select("row", "col", "clear", "cloud").toPandas()
    out["observation_valid"][p["row"], p["col"]], out["cloud_mask"][p["row"], p["col"]] = p["clear"], p["cloud"]
    f = fires.select("row", "col", "score").toPandas()
    out["fire_mask"][f["row"], f["col"]], out["fire_score"][f["row"], f["col"]] = 1, f["score"]
    data = io.BytesIO()
    np.savez_compressed(
        data, **out, line_start=np.int32(line_start), col_start=np.int32(col_start),
        acquisition_time=np.array(acquisition_time)
    )
    return data.getvalue()


def publish(df: DataFrame, path: str, tries: int = 3) -> None:
    """Write beside the target, then put in its place: readers see the old table or the new one. Where renaming fails
    ``tries`` times the files are copied."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, staging, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staging", f"{path}.old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.staging")
    for _ in range(tries):
        fs.delete(old, True)
        if (not fs.exists(target) or fs.rename(target, old)) and fs.rename(staging, target):
            fs.delete(old, True)
            return
    # stores that do not rename: copied, which readers may see half done
    if fs.exists(target):
        fs.delete(target, True)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(
        fs, staging, fs, target, True, spark.sparkContext._jsc.hadoopConfiguration()
    ):
        raise RuntimeError(f"{path} could not be replaced")
    fs.delete(old, True)
