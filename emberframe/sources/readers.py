"""Readers of points, polygons and rasters: GeoJSON, CSV, raw float grids, numpy files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.geo import in_box, ring_box
from emberframe.functions.names import report_time, sensor_of

FEATURE = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(kind, coordinates as JSON, properties) of all features of the GeoJSON files at ``path``."""
    raw = spark.read.option("multiLine", "true").option("primitivesAsString", "true").schema(FEATURE).json(path)
    return raw.select(F.explode("features").alias("f")).select(
        F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"),
        F.col("f.properties").alias("properties")
    )


def _rings(json: Column) -> Column:
    points = F.from_json(json, "array<array<array<double>>>")
    rings = F.transform(
        points,
        lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    )
    return F.filter(rings, lambda r: F.size(r) >= 3)


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(polygon_id, rings, min_x, min_y, max_x, max_y, properties): every polygon, and every part of a multi-polygon.
    Rings of fewer than three points are dropped, polygons without a ring too."""
    f = features(spark, path)
    one = f.filter("kind = 'Polygon'").select("coordinates", "properties")
    many = f.filter("kind = 'MultiPolygon'").select(
        F.explode(F.from_json("coordinates", "array<string>")).alias("coordinates"), "properties"
    )
    p = one.unionByName(many).select(
        _rings(F.col("coordinates")).alias("rings"), "properties"
    ).filter(F.size("rings") > 0)
    x0, y0, x1, y1 = ring_box(F.col("rings"))
    return p.select(
        F.xxhash64(F.to_json("rings")).alias("polygon_id"), "rings", x0.alias("min_x"), y0.alias("min_y"),
        x1.alias("max_x"), y1.alias("max_y"), "properties"
    )


def points(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, properties) of points and multi-points."""
    f = features(spark, path)
    one = f.filter("kind = 'Point'").select(F.from_json("coordinates", "array<double>").alias("c"), "properties")
    many = f.filter("kind = 'MultiPoint'").select(
        F.explode(F.from_json("coordinates", "array<array<double>>")).alias("c"), "properties"
    )
    return one.unionByName(many).select(
        F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"), "properties"
    ).filter("lon is not null and lat is not null")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate points with a time: (lon, lat, acq_ts, properties)."""
    p = points(spark, path).withColumn("acq_ts", F.try_to_timestamp(F.col("properties")["acqTimeUtc"]))
    return p.filter("acq_ts is not null").select("lon", "lat", "acq_ts", "properties")


def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; a byte-order mark is dropped."""
    raw = spark.read.option("header", "true").option(
        "recursiveFileLookup", "true"
    ).option("multiLine", "false").csv(path)
    return raw.withColumnsRenamed({c: c.replace("﻿", "").strip() for c in raw.columns})


def number(*names: str, df: DataFrame) -> Column:
    """The first of the columns that exists, as a number; what is none is null."""
    have = [F.trim(F.col(n)).try_cast("double") for n in names if n in df.columns]
    value = F.coalesce(*have) if have else F.lit(None).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def active_fires(spark: SparkSession, path: str | list[str], sensor: str | None = None) -> DataFrame:
    """Official detections: id, sensor (by the file's name unless given), lon, lat, acq_ts, confidence, frp, scan_km,
    track_km, fire_type, daynight, acq_date, ingest_order. Rows without a place or time are skipped, a file read twice counts once."""
    raw = csv(spark, path)
    text = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    d = raw.select(
        (F.lit(sensor) if sensor else sensor_of(name)).alias("sensor"), number("longitude", df=raw).alias("lon"),
        number("latitude", df=raw).alias("lat"), report_time(text("acq_date"), text("acq_time")).alias("acq_ts"),
        text("confidence").alias("confidence"), number("frp", df=raw).alias("frp"),
        number("scan", df=raw).alias("scan_km"), number("track", df=raw).alias("track_km"),
        text("type").alias("fire_type"), text("daynight").alias("daynight"),
        text("acq_date").alias("acq_date"),
        F.struct(name.alias("file"), F.monotonically_increasing_id().alias("row")).alias("ingest_order"),
    ).filter("lon is not null and lat is not null and acq_ts is not null")
    return d.withColumn(
        "id",
        F.concat_ws(
            "-", "sensor", F.date_format("acq_ts", "yyyyMMddHHmm"), F.format_string("%.6f", "lon"),
            F.format_string("%.6f", "lat")
        )
    ).select("id", *d.columns)


def thermal_sources(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(points: lon, lat, radius_km; polygons) of static heat from GeoJSON and CSV files together."""
    point = polygon = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for path in paths:
        if path.lower().endswith((".json", ".geojson")):
            p = points(spark, path)
            radius = F.coalesce(F.col("properties")["radiusKm"], F.col("properties")["radius_km"]).try_cast("double")
            point, polygon = add(
                point, p.select("lon", "lat", radius.alias("radius_km"))
            ), add(polygon, polygons(spark, path))
        else:
            raw = csv(spark, path)
            point = add(
                point,
                raw.select(
                    number("longitude", "lon", "LON", df=raw).alias("lon"),
                    number("latitude", "lat", "LAT", df=raw).alias("lat"),
                    number("radiusKm", "radius_km", df=raw).alias("radius_km")
                ).filter("lon is not null and lat is not null")
            )
    if point is None:
        raise ValueError("no file of thermal sources")
    if polygon is None:
        polygon = spark.createDataFrame([], "polygon_id long, rings array<array<struct<x:double,y:double>>>")
    return point, polygon


def solar_plants(
    spark: SparkSession, path: str, country: str = "CHN",
    box: tuple[float, float, float, float] = (73.0, 18.0, 135.5, 54.0)
) -> DataFrame:
    """Solar plants of a country: name, gppd_idnr, lon, lat, capacity_mw, radius_km; by name and id."""
    from emberframe.functions.features import plant_radius_km

    raw = csv(spark, path)
    own = raw.filter((F.upper(F.trim("country")) == country) & (F.lower(F.trim("primary_fuel")) == "solar"))
    p = own.select(
        "name", "gppd_idnr", number("longitude", df=raw).alias("lon"), number("latitude", df=raw).alias("lat"),
        F.coalesce(number("capacity_mw", df=raw), F.lit(0.0)).alias("capacity_mw")
    )
    return p.filter(in_box("lon", "lat", *box)).withColumn(
        "radius_km", plant_radius_km("capacity_mw")
    ).orderBy("name", "gppd_idnr")


def float_raster(spark: SparkSession, path: str, width: int, height: int, scene_id: str, band: str) -> DataFrame:
    """(scene_id, band, row, col, value) of files of little-endian 32-bit floats; NaN becomes null, another size fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = np.frombuffer(content.as_buffer(), dtype="<f4")
                if len(data) != width * height:
                    raise ValueError(f"the raster has {len(data)} values, not {width} x {height}")
                yield _raster_rows(data.reshape(height, width))

    grid = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row int, col int, value float")
    return grid.select(
        F.lit(scene_id).alias("scene_id"), F.lit(band).alias("band"), "row", "col",
        F.when(~F.isnan("value"), F.col("value")).alias("value")
    )


def _raster_rows(x: np.ndarray) -> pa.RecordBatch:
    row, col = np.indices(x.shape, dtype=np.int32)
    return pa.record_batch(
        [pa.array(row.ravel()), pa.array(col.ravel()), pa.array(x.ravel().astype(np.float32))],
        names=["row", "col", "value"]
    )


def json_raster(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(row, col, value) of a JSON array of numbers in row order, without Python; another size gives no rows but an error."""
    cells = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<double>").alias("v"))
    checked = cells.select(
        F.when(F.size("v") == width * height, F.col("v")).otherwise(
            F.raise_error(F.lit("the raster has another size"))
        ).alias("v")
    )
    return checked.select(F.posexplode("v").alias("k", "value")).select(
        F.floor(F.col("k") / width).cast("int").alias("row"), F.pmod("k", F.lit(width)).alias("col"), "value"
    )


def numpy_raster(spark: SparkSession, path: str, shape: tuple[int, int] | None = None, key: str = "data") -> DataFrame:
    """(row, col, value) of .npy or .npz files (array ``key``); another shape fails. Pickled content is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                loaded = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                x = loaded[key] if hasattr(loaded, "files") else loaded
                if shape and x.shape != shape:
                    raise ValueError(f"the raster's shape is {x.shape}, not {shape}")
                yield _raster_rows(x)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row int, col int, value float")


def support_mask(
    spark: SparkSession, path: str, pixels: DataFrame, shape: tuple[int, int] | None = None,
    keys: tuple[str, ...] = ("scene_id", "row", "col")
) -> DataFrame:
    """``pixels`` (keys, lon, lat) with ``masked``, from a raster (.npy, .npz: any value but 0) or from polygons (.geojson,
    .json: the pixel's centre lies in one). Another suffix, and a file without polygons, is an error."""
    from emberframe.operators.spatial import rasterize

    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix in ("npy", "npz"):
        mask = numpy_raster(spark, path, shape).filter(F.col("value") != 0).select(
            "row", "col", F.lit(True).alias("masked")
        )
        return pixels.join(mask, ["row", "col"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    if suffix not in ("geojson", "json"):
        raise ValueError(f"unsupported kind of mask: {path}")
    found = polygons(spark, path)
    if not found.limit(1).count():
        raise ValueError(f"the mask {path} has no polygon")
    return rasterize(pixels, found, keys)


def forecast_points(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, ts, series, units) of saved answers of a point forecast service: JSON lines with lat, lon and payload."""
    return forecast_series(spark.read.schema("lat double, lon double, payload string").json(path))


def forecast_series(answers: DataFrame) -> DataFrame:
    """(lat, lon, ts, series, units) of answers (lat, lon, payload: JSON text). ``series`` has the variables of the surface
    by name; a payload that is no JSON, or has no times, gives no row."""
    # the arrays of one keep filters above what is parsed: pushed below, each would parse the payload again
    once = lambda c: F.explode(F.array(c))
    p = answers.select("lat", "lon", once(F.from_json("payload", "map<string,string>")).alias("p"))
    times = F.transform(F.from_json(F.col("p")["ts"], "array<double>"), lambda t: t.cast("long"))
    own = F.map_filter("p", lambda k, v: k.endswith("-surface") & v.startswith("["))
    series = F.transform_values(own, lambda k, v: F.from_json(v, "array<double>"))
    units = F.coalesce(
        F.from_json(F.col("p")["units"], "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    parts = F.struct(times.alias("ts"), series.alias("series"), units.alias("units"))
    return p.select("lat", "lon", once(parts).alias("v")).select("lat", "lon", "v.*").filter("size(ts) > 0")


def object_listing(spark: SparkSession, path: str) -> DataFrame:
    """(key, size, modified) of saved object-store listings in XML."""
    from emberframe.functions.names import listing_entries

    return spark.read.text(path, wholetext=True).select(
        F.explode(listing_entries(F.col("value"))).alias("e")
    ).select("e.*")


def published_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) below a folder, the newest first."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select("path", "length", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")
