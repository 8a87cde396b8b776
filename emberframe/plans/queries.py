"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can say it.

``events`` stands in for imagery: event_id numbers the pixels of scenes of 50 x 50, event_type and value shape the bands.
Floats are compared after ROUND(x + 1e-9, 4).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import features, geo, names, serving, weather
from emberframe.functions import radiometry as R
from emberframe.operators import catalog, clusters, evaluation, graphs, pixels, ranking, spatial, summaries, temporal
from emberframe.operators.tables import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r4(x: Column | str) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") + 1e-9, 4)


def big(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ stand-ins


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    k = F.col("event_id")
    scene, row, col = F.floor(k / 2500), F.floor(F.pmod(k, F.lit(2500)) / 50), F.pmod(k, F.lit(50))
    b13 = 285 + F.pmod(k * 7919, F.lit(101)) / 20.0
    return e.select(
        "event_id", "user_id", big(scene).alias("scene_id"), big(row).alias("row"), big(col).alias("col"),
        (104.5 + col * 0.02).alias("lon"), (30 + row * 0.02).alias("lat"),
        F.timestamp_seconds(1767240000 + scene * 22200).alias("acq_ts"), b13.alias("b13"),
        F.when(F.col("event_type") == "error", 260.0).otherwise(b13 - 5).alias("b14"),
        (b13 + 8 + F.col("value") / 10).alias("b07"),
        F.when(F.pmod(k, F.lit(17)) != 0, F.pmod(k * 31, F.lit(100)) / 500.0).alias("rvis"), F.lit(True).alias("roi"),
        (F.pmod(k, F.lit(7)) == 0).alias("non_vegetation"),
    )


PIX = """
pix AS (
  SELECT event_id, user_id, event_id // 2500 AS scene_id, (event_id % 2500) // 50 AS "row", event_id % 50 AS col,
    104.5 + (event_id % 50) * 0.02 AS lon, 30 + ((event_id % 2500) // 50) * 0.02 AS lat,
    TIMESTAMP '2026-01-01 04:00:00' + to_seconds(22200 * (event_id // 2500)) AS acq_ts,
    285 + ((event_id * 7919) % 101) / 20.0 AS b13,
    CASE WHEN event_type = 'error' THEN 260.0 ELSE 285 + ((event_id * 7919) % 101) / 20.0 - 5 END AS b14,
    285 + ((event_id * 7919) % 101) / 20.0 + 8 + value / 10 AS b07,
    CASE WHEN event_id % 17 <> 0 THEN ((event_id * 31) % 100) / 500.0 END AS rvis, event_id % 7 = 0 AS non_vegetation
  FROM events
), sun AS (
  SELECT *, b07 - b13 AS t713, degrees(asin(least(greatest(sin(radians(lat)) * sin(radians(23.45 * sin(radians(360.0 / 365.0 * (284 + dayofyear(acq_ts))))))
      + cos(radians(lat)) * cos(radians(23.45 * sin(radians(360.0 / 365.0 * (284 + dayofyear(acq_ts)))))) * cos(radians(15.0 * (hour(acq_ts) + minute(acq_ts) / 60.0 + second(acq_ts) / 3600.0 + lon / 15.0 - 12.0))), -1.0), 1.0))) AS altitude
  FROM pix
), masks AS (
  SELECT *, 90 - altitude AS zenith, 90 - altitude > 87 AS night, rvis IS NOT NULL AS visible, (90 - altitude > 87) OR rvis IS NOT NULL AS valid FROM sun
), obs AS (
  SELECT *, valid AND NOT cloud AS clear FROM (
    SELECT *, valid AND ((NOT night AND t713 < 4) OR (t713 > 20 AND (b07 < 275 OR b13 < 270)) OR coalesce(rvis > 0.28 AND zenith < 70, false) OR b14 < 265
      OR (b13 < 270 AND (b13 - b14 < 4 OR b13 - b14 > 60))) AS cloud FROM masks)
), seeds AS (
  SELECT * FROM (SELECT *, clear AND visible AND coalesce(t713 > 20 AND b07 > rvis * 100 + 20, false) AS day,
    clear AND night AND b07 > 320 AND (rvis IS NULL OR rvis < 0.7) AS night_hot FROM obs) WHERE day OR night_hot
)"""

CONTEXT = PIX + """
, near AS (
  SELECT s.scene_id, s."row", s.col, w."window", p.b07, p.b13, p.rvis, p.t713, p.cloud, p.clear, p.non_vegetation
  FROM seeds s JOIN obs p ON p.scene_id = s.scene_id AND abs(p."row" - s."row") <= 9 AND abs(p.col - s.col) <= 9
    AND (p."row" <> s."row" OR p.col <> s.col) AND p.valid
  JOIN (VALUES (7), (9), (11), (19)) w("window") ON greatest(abs(p."row" - s."row"), abs(p.col - s.col)) <= w."window" // 2
), high AS (
  SELECT *, quantile_cont(CASE WHEN clear THEN b07 END, 0.8) OVER (PARTITION BY scene_id, "row", col, "window") AS p80 FROM near
), used AS (
  SELECT *, clear AND NOT coalesce(b07 >= p80 AND b07 >= b13 + coalesce(rvis, 0) * 100 + 20, false) AS use FROM high
), stats AS (
  SELECT scene_id, "row", col, "window", count(*) AS n_valid, count(*) FILTER (clear) AS n_clear, count(*) FILTER (use) AS n_used,
    avg(b07) FILTER (use) AS t7_bg, avg(b13) FILTER (use) AS t13_bg, coalesce(avg(rvis) FILTER (use), 0) AS rvis_bg, count(rvis) FILTER (use) AS n_rvis, avg(t713) FILTER (use) AS t713_bg,
    greatest(stddev_pop(b07) FILTER (use), 0.5) AS std_t7, least(greatest(stddev_pop(t713) FILTER (use), 2.0), 4.0) AS std_t713,
    count(*) FILTER (non_vegetation) / count(*) AS pv, count(*) FILTER (cloud) / count(*) AS pc
  FROM used GROUP BY ALL
), context AS (
  SELECT * FROM stats WHERE n_clear >= greatest(ceil(n_valid * 0.2), 4) AND n_used >= greatest(ceil(n_valid * 0.2), 4)
  QUALIFY row_number() OVER (PARTITION BY scene_id, "row", col ORDER BY "window") = 1
)"""

#: Every supplier as a static source. Radii are below the distance of two pixels, or all pixels would be static; a radius of
#: 0 or none stands for the default.
HEAT = "SELECT 104.5 + (s_suppkey % 50) * 0.02 AS lon, 30 + (s_suppkey % 47) * 0.02 AS lat, (1 + s_suppkey % 3) * 0.4 AS radius_km FROM supplier"

CASCADE = CONTEXT + f"""
, heat AS (
  {HEAT}
), joined AS (
  SELECT s.*, c."window", c.t7_bg, c.t13_bg, c.rvis_bg, c.n_rvis, c.t713_bg, c.std_t7, c.std_t713, c.pv, c.pc,
    EXISTS (SELECT 1 FROM heat h WHERE 2 * 6371.0 * asin(sqrt(pow(sin(radians(h.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(h.lat)) * pow(sin(radians(h.lon - s.lon) / 2), 2)))
      <= CASE WHEN h.radius_km > 0 THEN h.radius_km ELSE 4 END) AS static,
    CASE WHEN altitude < 60 THEN (greatest(sin(radians(greatest(altitude, 0))), 0) + 1) * (1 + c.pv) * (1 + c.pc)
      ELSE (1.2 * greatest(sin(radians(greatest(altitude, 0))), 0) + 1) * (1 + c.pv) * pow(1 + c.pc, 2) END AS factor
  FROM seeds s LEFT JOIN context c USING (scene_id, "row", col)
), tested AS (
  SELECT *, coalesce(b07 > t7_bg + factor * std_t7 AND t713 > t713_bg + factor * std_t713, false) AS relative,
    coalesce(b07 > t7_bg + factor * 0.8 * std_t7 AND t713 > t713_bg + factor * 0.8 * std_t713, false) AS nearly FROM joined
), tiers AS (SELECT *, NOT night_hot AND NOT relative AND nearly AS rescued FROM tested
), judged AS (
  SELECT *, CASE WHEN "window" IS NULL THEN 'background' WHEN NOT night_hot AND NOT relative AND NOT rescued THEN 'dynamic'
      WHEN n_rvis > 0 AND rvis >= rvis_bg + 0.15 AND b13 <= t13_bg - 5 THEN 'cloud'
      WHEN b07 <= t7_bg + CASE WHEN rescued THEN 5 ELSE 8 END * std_t7 AND t713 <= t713_bg + CASE WHEN rescued THEN 5 ELSE 8 END * std_t713 THEN 'edge'
      WHEN static THEN 'static' END AS reject, CASE WHEN rescued THEN 'model-rescue' ELSE 'strict' END AS tier,
    (b07 - (t7_bg + factor * CASE WHEN rescued THEN 0.8 ELSE 1 END * std_t7)) / std_t7 AS e7, (t713 - (t713_bg + factor * CASE WHEN rescued THEN 0.8 ELSE 1 END * std_t713)) / std_t713 AS e713
  FROM tiers
), scored AS (
  SELECT *, round(least(greatest(greatest(least(e7, e713), 0) + 0.25 * greatest((e7 + e713) / 2, 0), CASE WHEN night_hot THEN 2 + greatest((b07 - 320) / 10, 0) ELSE 0 END), 10.0), 3) AS score FROM judged
), fires AS (
  SELECT *, CASE WHEN score >= 3.5 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM scored WHERE reject IS NULL
)"""


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    place = (104.5 + F.pmod(s, F.lit(50)) * 0.02).alias("lon"), (30 + F.pmod(s, F.lit(47)) * 0.02).alias("lat")
    return table(spark, sf_dir, "supplier").select(*place, ((1 + F.pmod(s, F.lit(3))) * 0.4).alias("radius_km"))


RESCUE = R.Rescue(enabled=True)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.judge(pix(spark, sf_dir), heat(spark, sf_dir), None, R.Thresholds(), RESCUE)


#: Fires for the operators after detection: a simple stand-in that needs no context.
SPOTS = PIX + """
, spots AS (
  SELECT event_id AS fire_id, user_id, scene_id, "row", col, lon, lat, acq_ts, round(b07 + 1e-7, 2) AS bt_tir, round(t713 + 1e-7, 2) AS bt_dif, ((event_id * 131) % 1009) / 100.0 AS score,
    event_id % 11 = 0 AS official_confirmed, CASE WHEN event_id % 3 = 0 THEN 'model-rescue' ELSE 'strict' END AS tier
  FROM sun WHERE b07 > 306
)"""


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    p = pix(spark, sf_dir).filter("b07 > 306")
    return p.select(
        k.alias("fire_id"), "user_id", "scene_id", "row", "col", "lon", "lat", "acq_ts",
        F.round(F.col("b07") + 1e-7, 2).alias("bt_tir"), F.round(F.col("b07") - F.col("b13") + 1e-7, 2).alias("bt_dif"),
        (F.pmod(k * 131, F.lit(1009)) / 100.0).alias("score"),
        (F.pmod(k, F.lit(11)) == 0).alias("official_confirmed"),
        F.when(F.pmod(k, F.lit(3)) == 0, "model-rescue").otherwise("strict").alias("tier"),
    )


REFS = """refs AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'MODIS' ELSE 'VIIRS_NOAA20' END AS sensor, 104.5 + (o_orderkey * 37 % 9973) / 9973.0 AS lon, 30 + (o_orderkey * 91 % 9967) / 9967.0 AS lat,
    TIMESTAMP '2026-01-01 04:00:00' + to_seconds(600 * (o_orderkey * 13 % 1500)) AS acq_ts, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 100 AS VARCHAR) ELSE 'nominal' END AS confidence,
    (o_orderkey % 50) / 2.0 AS frp
  FROM orders)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    modis = F.pmod(k, F.lit(4)) == 0
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(modis, "MODIS").otherwise("VIIRS_NOAA20").alias("sensor"),
        (104.5 + F.pmod(k * 37, F.lit(9973)) / 9973.0).alias("lon"),
        (30 + F.pmod(k * 91, F.lit(9967)) / 9967.0).alias("lat"),
        F.timestamp_seconds(1767240000 + 600 * F.pmod(k * 13, F.lit(1500))).alias("acq_ts"),
        F.when(modis, F.pmod(k, F.lit(100)).cast("string")).otherwise("nominal").alias("confidence"),
        (F.pmod(k, F.lit(50)) / 2.0).alias("frp"),
    )


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(pow(sin(radians(({d}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians(({c}) - ({a})) / 2), 2)))"


# ------------------------------------------------------------------ masks, geometry, calibration


@query(f'WITH {PIX} SELECT scene_id, "row", col, night, visible, valid, cloud, clear FROM obs')
def observation_masks(spark, sf_dir):
    return pixels.observe(pix(spark, sf_dir)).select(
        "scene_id", "row", "col", "night", "visible", "valid", "cloud", "clear"
    )


@query(
    f"WITH {PIX} SELECT scene_id, count(*) AS pixels, count(*) FILTER (valid) AS valid, count(*) FILTER (cloud) AS cloudy, count(*) FILTER (clear) AS clear FROM obs GROUP BY scene_id"
)
def cloud_stage_counts(spark, sf_dir):
    return pixels.observe(pix(spark, sf_dir)).groupBy("scene_id").agg(
        F.count("*").alias("pixels"), F.count_if("valid").alias("valid"), F.count_if("cloud").alias("cloudy"),
        F.count_if("clear").alias("clear")
    )


@query(
    f"WITH {PIX} SELECT event_id, round(altitude + 1e-9, 4) AS altitude, round(90 - altitude + 1e-9, 4) AS zenith FROM sun"
)
def solar_geometry(spark, sf_dir):
    p = pix(spark, sf_dir)
    return p.select(
        "event_id", r4(R.solar_altitude("acq_ts", "lon", "lat")).alias("altitude"),
        r4(R.solar_zenith("acq_ts", "lon", "lat")).alias("zenith")
    )


@query("""
WITH c AS (SELECT event_id, (event_id * 7) % 2050 AS n FROM events), r AS (SELECT *, CASE WHEN n NOT IN (2047, 2046) AND -0.0037 * n + 7.5 > 0 THEN -0.0037 * n + 7.5 END AS rad FROM c),
t AS (SELECT *, 14387.769 / (3.8853 * ln(1 + 119104297.2 / (rad * pow(3.8853, 5)))) AS te FROM r)
SELECT event_id, round(-0.4793907798 + 1.000766568 * te - 1.860569e-07 * te * te + 1e-9, 4) AS bt, round(CASE WHEN rad * 0.0019255 >= 0 THEN rad * 0.0019255 END + 1e-9, 4) AS reflectance FROM t""")
def planck_brightness_temp(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.pmod(F.col("event_id") * 7, F.lit(2050)).alias("n"))
    bt = R.brightness_temperature("n", -0.0037, 7.5, 3.8853, -0.4793907798, 1.000766568, -1.860569e-07, 2047, 2046)
    return e.select(
        "event_id", r4(bt).alias("bt"), r4(R.reflectance("n", -0.0037, 7.5, 0.0019255, 2047, 2046)).alias("reflectance")
    )


DISK = R.Projection(140.7, 20466275, 20466275, 2750.5, 2750.5)


@query("""
WITH p AS (SELECT event_id, 30 + (event_id % 977) * 0.25 AS lon, -55 + (event_id % 991) * 0.11 AS lat FROM events),
a AS (SELECT *, radians(lon - 140.7) AS dl, atan(pow(6356.7523 / 6378.137, 2) * tan(radians(lat))) AS phi FROM p),
b AS (SELECT *, 6356.7523 / sqrt(1 - (1 - pow(6356.7523 / 6378.137, 2)) * pow(cos(phi), 2)) AS re FROM a),
c AS (SELECT *, re * cos(phi) * cos(dl) AS x, re * cos(phi) * sin(dl) AS y, re * sin(phi) AS z FROM b),
-- on the near side: towards the satellite at (h, 0, 0), the tangent plane's point h x = y^2 + (a z / b)^2 is the limb
d AS (SELECT *, 42164.0 * x > y * y + pow(z * 6378.137 / 6356.7523, 2) AS visible,
  cos(radians(lat)) * cos(dl) > cos(radians(80)) AS well_inside FROM c)
SELECT event_id, round(2750.5 + degrees(atan2(y, 42164.0 - x)) * 20466275 / 65536 + 1e-9, 4) AS col,
  round(2750.5 + degrees(asin(-z / sqrt(pow(42164.0 - x, 2) + y * y + z * z))) * 20466275 / 65536 + 1e-9, 4) AS line, visible,
  CASE WHEN well_inside THEN round(lon, 3) END AS lon_back, CASE WHEN well_inside THEN round(lat, 3) END AS lat_back FROM d""")
def nav_lonlat_roundtrip(spark, sf_dir):
    """Places up to 133 degrees from the point below the satellite, and back again for those within 80 degrees."""
    k = F.col("event_id")
    p = table(spark, sf_dir, "events").select(
        k, (30 + F.pmod(k, F.lit(977)) * 0.25).alias("lon"), (-55 + F.pmod(k, F.lit(991)) * 0.11).alias("lat")
    )
    c, ln, v = R.to_column_line("lon", "lat", DISK)
    p = p.withColumns({"c": c, "l": ln, "visible": v})
    x, y = R.to_lon_lat("c", "l", DISK)
    inside = F.col("visible") & (
        F.cos(F.radians("lat")) * F.cos(F.radians(F.col("lon") - 140.7)) > F.cos(F.radians(F.lit(80.0)))
    )
    back = [F.when(inside, F.round(b, 3)).alias(n) for b, n in ((F.pmod(x, F.lit(360.0)), "lon_back"), (y, "lat_back"))]
    return p.select("event_id", r4("c").alias("col"), r4("l").alias("line"), "visible", *back)


# ------------------------------------------------------------------ detection


@query(f'WITH {PIX} SELECT scene_id, "row", col, day, night_hot FROM seeds')
def seed_pixels(spark, sf_dir):
    s = pixels.seed(pixels.observe(pix(spark, sf_dir)))
    return s.filter(F.col("day") | F.col("night_hot")).select("scene_id", "row", "col", "day", "night_hot")


@query(f"""WITH {PIX}, a AS (SELECT *, max(t713) OVER (PARTITION BY scene_id, "row" ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM sun),
b AS (SELECT *, max(m) OVER (PARTITION BY scene_id, col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM a)
SELECT scene_id, "row", col FROM b WHERE t713 >= top""")
def local_maximum(spark, sf_dir):
    p = pix(spark, sf_dir).withColumn("t713", F.col("b07") - F.col("b13"))
    return pixels.local_maximum(p, "t713", 5).filter("is_maximum").select("scene_id", "row", "col")


@query(
    f'WITH {PIX} SELECT scene_id, "row", col FROM obs WHERE clear AND ((NOT night AND visible AND t713 > 20 AND b07 > rvis * 100 + 20) OR (night AND t713 > 4))'
)
def permissive_candidates(spark, sf_dir):
    o = pixels.observe(pix(spark, sf_dir))
    return o.filter(
        R.permissive_candidate("b07", "b13", "rvis", F.col("clear"), F.col("night"), R.Thresholds())
    ).select("scene_id", "row", "col")


@query(f"""WITH {CONTEXT} SELECT scene_id, "row", col, CAST("window" AS BIGINT) AS "window", n_clear, n_used, round(t7_bg + 1e-9, 4) AS t7_bg, round(t713_bg + 1e-9, 4) AS t713_bg, round(rvis_bg + 1e-9, 4) AS rvis_bg,
  round(std_t7 + 1e-9, 4) AS std_t7, round(std_t713 + 1e-9, 4) AS std_t713, round(pv + 1e-9, 4) AS pv, round(pc + 1e-9, 4) AS pc FROM context""")
def background_context(spark, sf_dir):
    o = pixels.observe(pix(spark, sf_dir))
    s = pixels.seed(o).filter(F.col("day") | F.col("night_hot"))
    b = pixels.background(s, o)
    return b.select(
        "scene_id", "row", "col", big("window").alias("window"), "n_clear", "n_used",
        *[r4(c).alias(c) for c in ("t7_bg", "t713_bg", "rvis_bg", "std_t7", "std_t713", "pv", "pc")]
    )


@query(
    f'WITH {CASCADE} SELECT scene_id, "row", col, reject, tier, round(factor + 1e-9, 4) AS factor, round(score + 1e-9, 2) AS score FROM scored'
)
def detect_cascade(spark, sf_dir):
    return judged(spark, sf_dir).select(
        "scene_id", "row", "col", "reject", "tier", r4("factor").alias("factor"),
        F.round(F.col("score") + 1e-9, 2).alias("score")
    )


@query(f"""WITH {CASCADE} SELECT scene_id, count(*) AS seeds, count(*) FILTER (day) AS day_seeds, count(*) FILTER (night_hot) AS night_seeds, count(*) FILTER (reject = 'background') AS rejected_background,
  count(*) FILTER (reject = 'dynamic') AS rejected_dynamic, count(*) FILTER (reject = 'cloud') AS rejected_cloud, count(*) FILTER (reject = 'edge') AS rejected_edge, count(*) FILTER (reject = 'static') AS rejected_static,
  count(*) FILTER (reject IS NULL) AS accepted, count(*) FILTER (reject IS NULL AND tier = 'model-rescue') AS rescued FROM scored GROUP BY scene_id""")
def stage_counts(spark, sf_dir):
    return pixels.stage_counts(judged(spark, sf_dir))


@query(
    f"WITH {CASCADE} SELECT scene_id, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM fires GROUP BY scene_id"
)
def fire_confidence_hist(spark, sf_dir):
    return ranking.confidence_counts(judged(spark, sf_dir).filter(F.col("reject").isNull()))


@query(
    f"""WITH {SPOTS} SELECT fire_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, tier ORDER BY score DESC, "row", col) AS n FROM spots) WHERE tier <> 'model-rescue' OR n <= 10"""
)
def rescue_topn(spark, sf_dir):
    return pixels.limit_rescued(spots(spark, sf_dir), R.Rescue(enabled=True, most=10)).select("fire_id", "tier")


@query(f"""WITH {SPOTS}, o AS (SELECT scene_id, list([{{'id': fire_id, 'r': "row", 'c': col, 's': score}}] ORDER BY score DESC, "row", col, fire_id) AS l FROM spots GROUP BY scene_id),
-- one after the other: a spot joins the list unless one of the list is within two rows and columns
k AS (SELECT scene_id, list_reduce(l, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: abs(y.r - x[1].r) <= 2 AND abs(y.c - x[1].c) <= 2)) > 0 THEN kept ELSE list_concat(kept, x) END) AS l FROM o),
u AS (SELECT scene_id, unnest(l) AS q FROM k) SELECT q.id AS fire_id, scene_id, q.r AS "row", q.c AS col, q.s AS score FROM u""")
def nms_dedup(spark, sf_dir):
    return pixels.suppress(spots(spark, sf_dir), 2).select("fire_id", "scene_id", "row", "col", "score")


# ------------------------------------------------------------------ spatial

BOX = [(104.7037, 30.2031), (105.1037, 30.2031), (105.1037, 30.8029), (104.9033, 30.5039), (104.7037, 30.8029)]
HOLE = [(104.8041, 30.2543), (104.8541, 30.2543), (104.8541, 30.3039), (104.8041, 30.3039)]


def zone(spark: SparkSession) -> DataFrame:
    ring = lambda r: "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in r) + ")"
    return spark.sql(f"SELECT 1L AS polygon_id, array({ring(BOX)}, {ring(HOLE)}) AS rings")


def crossings(ring: list[tuple[float, float]], x: str = "lon", y: str = "lat") -> str:
    edges = zip(ring, [ring[-1], *ring[:-1]])
    return " + ".join(
        f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) AND {x} < ({bx} - {ax}) * ({y} - {ay}) / {(by - ay) or 1e-12} + {ax} THEN 1 ELSE 0 END" for (ax, ay),
        (bx, by) in edges
    )


INSIDE = f"(({crossings(BOX)}) % 2 = 1 AND NOT ({crossings(HOLE)}) % 2 = 1)"


@query(
    f"WITH {SPOTS}, heat AS ({HEAT}) SELECT fire_id FROM spots s WHERE NOT EXISTS (SELECT 1 FROM heat h WHERE {hav('s.lon', 's.lat', 'h.lon', 'h.lat')} <= h.radius_km)"
)
def static_source_anti(spark, sf_dir):
    """Spots that none of all suppliers' places covers."""
    return spatial.without_sources(spots(spark, sf_dir), heat(spark, sf_dir), "fire_id").select("fire_id")


@query(f"WITH {SPOTS} SELECT fire_id FROM spots WHERE {INSIDE}")
def point_in_polygon_semi(spark, sf_dir):
    return spatial.within_polygons(spots(spark, sf_dir), zone(spark), "fire_id", cell=0.25).select("fire_id").distinct()


@query(f"WITH {SPOTS} SELECT fire_id, {INSIDE} AS accepted FROM spots")
def boundary_clip(spark, sf_dir):
    return spatial.clip(spots(spark, sf_dir), zone(spark), "fire_id").select("fire_id", "accepted")


@query(f'WITH {PIX} SELECT scene_id, "row", col, {INSIDE} AS masked FROM pix')
def rasterize_mask(spark, sf_dir):
    return spatial.rasterize(pix(spark, sf_dir), zone(spark)).select("scene_id", "row", "col", "masked")


FUSED = f"""WITH {SPOTS}, {REFS}, near AS (
  SELECT f.fire_id, r.id, {hav('f.lon', 'f.lat', 'r.lon', 'r.lat')} AS d, abs(epoch_us(r.acq_ts) - epoch_us(f.acq_ts)) / 3.6e9 AS dt FROM spots f JOIN refs r ON abs(epoch_us(r.acq_ts) - epoch_us(f.acq_ts)) <= 3 * 3.6e9 AND r.lat BETWEEN f.lat - 0.1 AND f.lat + 0.1
), best AS (SELECT * FROM near WHERE d <= 4 QUALIFY row_number() OVER (PARTITION BY fire_id ORDER BY d, dt, id) = 1)"""


@query(
    f"{FUSED} SELECT f.fire_id, CAST(b.id AS VARCHAR) AS official_id, b.id IS NOT NULL AS official_confirmed, round(round(b.d, 3) + 1e-9, 2) AS km, round(round(b.dt * 60, 1) + 1e-9, 1) AS minutes FROM spots f LEFT JOIN best b USING (fire_id)"
)
def fuse_nearest_reference(spark, sf_dir):
    f = spatial.nearest_reference(spots(spark, sf_dir).drop("official_confirmed"), refs(spark, sf_dir))
    return f.select(
        "fire_id", F.col("official_id").cast("string").alias("official_id"), "official_confirmed",
        F.round(F.col("official_distance_km") + 1e-9, 2).alias("km"),
        F.round(F.col("official_minutes") + 1e-9, 1).alias("minutes")
    )


@query(
    f"{FUSED} SELECT id, id IN (SELECT id FROM best) AS matched, CASE WHEN id IN (SELECT id FROM best) THEN 'official-confirmed' ELSE 'official-only' END AS fusion_status FROM refs"
)
def official_only_refs(spark, sf_dir):
    f = spatial.nearest_reference(spots(spark, sf_dir).drop("official_confirmed"), refs(spark, sf_dir))
    r = refs(spark, sf_dir).withColumns({"scan_km": F.lit(0.4), "track_km": F.lit(None).cast("double")})
    return spatial.official_ranges(r, f).select("id", "matched", "fusion_status")


@query(
    f"WITH {SPOTS}, {REFS} SELECT id FROM refs r WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT acq_ts FROM spots) s WHERE abs(epoch_us(s.acq_ts) - epoch_us(r.acq_ts)) <= 3.6e9)"
)
def references_in_time(spark, sf_dir):
    return spatial.in_time_reach(refs(spark, sf_dir), spots(spark, sf_dir), 1.0).select("id")


@query(
    f"WITH {SPOTS}, {REFS} SELECT fire_id, round(min({hav('f.lon', 'f.lat', 'r.lon', 'r.lat')}) + 1e-9, 3) AS km FROM spots f, refs r GROUP BY fire_id"
)
def nearest_distance(spark, sf_dir):
    """The distance to the nearest of all references, which lie close: the first ring is small."""
    near = spatial.nearest_distance(spots(spark, sf_dir), refs(spark, sf_dir), "fire_id", start_km=1)
    return near.select("fire_id", F.round(F.col("distance_km") + 1e-9, 3).alias("km"))


@query(f"""WITH {SPOTS}, s AS (SELECT *, radians(1.0) * 6371.0 AS k FROM spots) SELECT fire_id, round(lon - 0.2 / (k * cos(radians(lat))) + 1e-9, 5) AS west, round(lat + 0.15 / k + 1e-9, 5) AS north,
 round(0.4 * 0.3 + 1e-9, 3) AS area FROM s""")
def metre_boxes(spark, sf_dir):
    s = spots(spark, sf_dir).withColumn("ring", geo.metre_box("lon", "lat", 400.0, 300.0))
    return s.select(
        "fire_id", F.round(F.col("ring")[0]["x"] + 1e-9, 5).alias("west"),
        F.round(F.col("ring")[0]["y"] + 1e-9, 5).alias("north"),
        F.round(geo.ring_area_km2(F.col("ring")) + 1e-9, 3).alias("area")
    )


@query(f"""WITH {SPOTS} SELECT fire_id, round(lon - 0.01 + 1e-9, 5) AS west, round(lat - 0.01 + 1e-9, 5) AS south,
 round({hav('lon - 0.01', 'lat', 'lon + 0.01', 'lat')} + 1e-9, 1) AS width FROM spots""")
def pixel_footprints(spark, sf_dir):
    f = clusters.footprints(spots(spark, sf_dir), pix(spark, sf_dir))
    p = lambda k, c: F.col("ring")[k][c]
    width = (
        geo.haversine_km(p(0, "x"), p(0, "y"), p(1, "x"), p(1, "y"))
        + geo.haversine_km(p(3, "x"), p(3, "y"), p(2, "x"), p(2, "y"))
    ) / 2
    return f.select(
        "fire_id", F.round(p(0, "x") + 1e-9, 5).alias("west"), F.round(p(0, "y") + 1e-9, 5).alias("south"),
        F.round(width + 1e-9, 1).alias("width")
    )


@query(f"""WITH RECURSIVE {SPOTS}, near AS (SELECT a.fire_id AS a, b.fire_id AS b FROM spots a JOIN spots b ON a.scene_id = b.scene_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), label AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT scene_id, min(fire_id) AS first_fire, count(*) AS pixel_count, round(round(sum(lon * (greatest(score, 0) + 1)) / sum(greatest(score, 0) + 1), 6) + 1e-9, 4) AS lon, round(max(score) + 1e-9, 4) AS max_score, bool_or(official_confirmed) AS official_confirmed
FROM spots JOIN label ON a = fire_id GROUP BY scene_id, component HAVING count(*) >= 2""")
def cluster_components(spark, sf_dir):
    s = spots(spark, sf_dir)
    c = clusters.fire_clusters(s)
    # a cluster is named by its first pixel, which is also its least fire
    first = F.split(F.col("cluster_id"), "-")
    fire = first[0].cast("long") * 2500 + first[1].cast("long") * 50 + first[2].cast("long")
    return c.select(
        "scene_id", fire.alias("first_fire"), "pixel_count", r4("centroid_lon").alias("lon"),
        r4("max_score").alias("max_score"), "official_confirmed"
    )


# ------------------------------------------------------------------ time and ranks

CAND = SPOTS + """
, cand AS (
  SELECT fire_id, scene_id, lon AS center_lon, lat AS center_lat, bt_tir AS max_bt07_k, bt_dif AS max_t713_k, CAST(1 + fire_id % 4 AS DOUBLE) AS cand_area, floor(lon / 0.05) AS glon, floor(lat / 0.05) AS glat, scene_id AS slot_ord FROM spots
), state AS (SELECT glon, glat, slot_ord, max(max_bt07_k) AS max_bt07_k, max(max_t713_k) AS max_t713_k, count(*) AS n_cand, max(cand_area) AS max_area FROM cand GROUP BY ALL)"""


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spots(spark, sf_dir)
    return s.select(
        "fire_id", "scene_id", F.col("lon").alias("center_lon"), F.col("lat").alias("center_lat"),
        F.col("bt_tir").alias("max_bt07_k"), F.col("bt_dif").alias("max_t713_k"),
        (1 + F.pmod("fire_id", F.lit(4))).cast("double").alias("cand_area"),
        F.col("scene_id").cast("int").alias("slot_ord")
    )


@query(
    f"WITH {CAND} SELECT CAST(glon AS BIGINT) AS glon, CAST(glat AS BIGINT) AS glat, CAST(slot_ord AS BIGINT) AS slot_ord, round(max_bt07_k + 1e-9, 4) AS max_bt07_k, n_cand, max_area FROM state"
)
def grid_temporal_state(spark, sf_dir):
    return temporal.grid_state(cand(spark, sf_dir)).select(
        big("glon").alias("glon"), big("glat").alias("glat"), big("slot_ord").alias("slot_ord"),
        r4("max_bt07_k").alias("max_bt07_k"), "n_cand", "max_area"
    )


@query(f"""WITH {CAND}, l AS (SELECT c.fire_id, c.max_bt07_k, {", ".join(f"coalesce(max(s.max_bt07_k) FILTER (s.slot_ord = c.slot_ord + ({k})), 0) AS b{k + 6}, count(*) FILTER (s.slot_ord = c.slot_ord + ({k}) AND s.n_cand > 0) AS h{k + 6}" for k in temporal.LAGS)}
FROM cand c LEFT JOIN state s ON s.glon = c.glon AND s.glat = c.glat AND s.slot_ord - c.slot_ord BETWEEN -6 AND 3 GROUP BY c.fire_id, c.max_bt07_k)
SELECT fire_id, {", ".join(f"round(b{k + 6} + 1e-9, 4) AS bt07_{'m' if k < 0 else 'p'}{abs(k)}" for k in temporal.LAGS)}, round(max_bt07_k - b5 + 1e-9, 4) AS delta_m1, h3 + h4 + h5 AS persist, {" + ".join(f"h{k + 6}" for k in temporal.LAGS)} AS persist_all, round(greatest(b0, b3, b4, b5) + 1e-9, 4) AS past_max FROM l""")
def lag_features(spark, sf_dir):
    """All seven lags of the operator."""
    c = cand(spark, sf_dir)
    f = temporal.lag_features(c, temporal.grid_state(c), "fire_id")
    lags = [f"{'m' if k < 0 else 'p'}{abs(k)}" for k in temporal.LAGS]
    return f.select(
        "fire_id", *[r4(f"temp_bt07_{k}").alias(f"bt07_{k}") for k in lags], r4("temp_bt07_delta_m1").alias("delta_m1"),
        big("temp_persist_3").alias("persist"), big("temp_persist_all").alias("persist_all"),
        r4("temp_bt07_past_max").alias("past_max")
    )


@query(
    f"""WITH {CAND} SELECT c.fire_id, round(coalesce(max(s.max_bt07_k), 0) + 1e-9, 4) AS nb_bt07, coalesce(max(s.n_cand), 0) AS nb_n FROM cand c LEFT JOIN state s ON s.slot_ord = c.slot_ord - 1 AND abs(s.glon - c.glon) <= 1 AND abs(s.glat - c.glat) <= 1 GROUP BY c.fire_id"""
)
def neighbor_prev_slot(spark, sf_dir):
    c = cand(spark, sf_dir)
    return temporal.neighbour_features(c, temporal.grid_state(c), "fire_id").select(
        "fire_id", r4("temp_nb_bt07_m1").alias("nb_bt07"), big("temp_nb_n_m1").alias("nb_n")
    )


@query(
    f"WITH {CAND} SELECT CAST(slot_ord AS BIGINT) AS slot_ord, count(*) AS cells FROM state WHERE slot_ord IN (SELECT DISTINCT slot_ord FROM state ORDER BY slot_ord DESC LIMIT 3) GROUP BY slot_ord"
)
def keep_latest_slots(spark, sf_dir):
    s = temporal.latest_slots(temporal.grid_state(cand(spark, sf_dir)), 3)
    return s.groupBy(big("slot_ord").alias("slot_ord")).agg(F.count("*").alias("cells"))


@query(
    f"WITH {CAND} SELECT CAST(slot_ord AS BIGINT) AS slot_ord, CAST(sum(n_cand) AS BIGINT) AS n, count(*) AS cells, round(sum(max_bt07_k) + 1e-9, 2) AS bt07, round(sum(max_t713_k) + 1e-9, 2) AS t713, sum(max_area) AS area FROM state GROUP BY slot_ord"
)
def merge_state(spark, sf_dir):
    s = kept(temporal.grid_state(cand(spark, sf_dir)), "state")
    again = temporal.merge_state(s, s.filter("slot_ord >= 1"))  # replayed slots change nothing
    return again.groupBy(big("slot_ord").alias("slot_ord")).agg(
        F.sum("n_cand").alias("n"), F.count("*").alias("cells"), F.round(F.sum("max_bt07_k") + 1e-9, 2).alias("bt07"),
        F.round(F.sum("max_t713_k") + 1e-9, 2).alias("t713"), F.sum("max_area").alias("area")
    )


@query(f"""WITH {CAND} SELECT fire_id, round(max_bt07_k / greatest(max(max_bt07_k) OVER s, 1e-3) + 1e-9, 4) AS to_max, round(max_bt07_k - avg(max_bt07_k) OVER s + 1e-9, 4) AS minus_mean,
 round((rank() OVER (PARTITION BY scene_id ORDER BY max_bt07_k) + (count(*) OVER (PARTITION BY scene_id, max_bt07_k) - 1) / 2.0) / count(*) OVER s + 1e-9, 4) AS rank_pct, round(ln(1 + count(*) OVER s) + 1e-9, 4) AS count_log
 FROM cand WINDOW s AS (PARTITION BY scene_id)""")
def scene_rank_features(spark, sf_dir):
    c = cand(spark, sf_dir).withColumns({"scene_slot": F.col("scene_id"), "day_phase": F.lit("day")})
    f = ranking.scene_rank_features(c)
    return f.select(
        "fire_id", r4("bt07_to_scene_max").alias("to_max"), r4("bt07_minus_scene_mean").alias("minus_mean"),
        r4("bt07_scene_rank_pct").alias("rank_pct"), r4("scene_candidate_count_log").alias("count_log")
    )


@query(
    f"WITH {SPOTS} SELECT fire_id, scene_id FROM spots QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY official_confirmed DESC, score DESC, fire_id) <= 20 OR official_confirmed"
)
def budget_topk_forced(spark, sf_dir):
    return ranking.top_budget(
        spots(spark, sf_dir).withColumn("forced", F.col("official_confirmed")), 20, ("scene_id",), ("fire_id",)
    ).select("fire_id", "scene_id")


@query(f"""WITH {SPOTS}, p AS (SELECT *, ((fire_id * 17) % 997) / 997.0 AS prob FROM spots), r AS (
  SELECT *, CASE WHEN lon < 105 THEN 'west' ELSE 'elsewhere' END AS region, CASE WHEN lon < 105 THEN round(prob * 10, 4) ELSE score END AS s, CASE WHEN lon < 105 THEN round(prob, 6) END AS q FROM p),
a AS (SELECT * FROM r WHERE NOT (tier = 'model-rescue' AND NOT official_confirmed AND coalesce(q, 0) < 0.35))
SELECT fire_id, region, round(s + 1e-9, 3) AS score FROM a QUALIFY region <> 'west' OR official_confirmed OR row_number() OVER (PARTITION BY scene_id, region ORDER BY official_confirmed DESC, s DESC, fire_id) <= 15""")
def regional_budget(spark, sf_dir):
    s = spots(spark, sf_dir).withColumns(
        {
            "center_lon": F.col("lon"), "west_prob": F.pmod(F.col("fire_id") * 17, F.lit(997)) / 997.0,
            "east_prob": F.lit(None).cast("double"), "confidence": F.lit("low")
        }
    )
    c = ranking.Scorer(west_budget=15)
    return ranking.within_budget(ranking.route(s, c), c).select(
        "fire_id", F.col("region_for_scorer").alias("region"), F.round(F.col("score") + 1e-9, 3).alias("score")
    )


@query(f"""WITH {SPOTS}, h AS (SELECT *, (hour(acq_ts) + minute(acq_ts) / 60.0 + lon / 15) % 24 AS hl FROM spots)
SELECT fire_id, round(sin(6.283185307179586 * month(acq_ts) / 12) + 1e-9, 4) AS month_sin, round(cos(6.283185307179586 * hl / 24) + 1e-9, 4) AS hour_cos, round(cos(6.283185307179586 * month(acq_ts) / 12) + 1e-9, 4) AS month_cos, round(sin(6.283185307179586 * hl / 24) + 1e-9, 4) AS hour_sin, round(6371.0088 * acos(least(greatest(cos(radians(lat)) * cos(radians(lon - 140.7)), -1), 1)) + 1e-9, 2) AS star_km,
 round(bt_tir * bt_tir + 1e-9, 3) AS bt07_sq, bt_tir AS level, greatest(bt_dif, 0) AS strength, round(bt_tir * bt_dif + 1e-9, 3) AS product, 1e0 AS area_sq, 0e0 AS lon_span, 0e0 AS lat_span, 0e0 AS aspect, 0e0 AS offset_km, 0e0 AS offset_ratio,
 CASE WHEN lon < 105 THEN 1e0 ELSE 0e0 END AS west, CASE WHEN lon >= 105 AND lon < 115 THEN 1e0 ELSE 0e0 END AS central, CASE WHEN lon >= 115 THEN 1e0 ELSE 0e0 END AS east,
 CASE WHEN hl >= 6 AND hl < 18 THEN 1e0 ELSE 0e0 END AS day, CASE WHEN (hl >= 5 AND hl < 6) OR (hl >= 18 AND hl < 19) THEN 1e0 ELSE 0e0 END AS twilight, CASE WHEN hl < 5 OR hl >= 19 THEN 1e0 ELSE 0e0 END AS night, CASE WHEN hl >= 6 AND hl < 18 THEN 'day' WHEN (hl >= 5 AND hl < 6) OR (hl >= 18 AND hl < 19) THEN 'twilight' ELSE 'night' END AS phase FROM h""")
def base_features(spark, sf_dir):
    f = features.base_features(features.candidate_frame(spots(spark, sf_dir)))
    same = {
        "level": "bt07_level", "strength": "t713_strength", "area_sq": "area_sq", "lon_span": "lon_span_deg",
        "lat_span": "lat_span_deg", "aspect": "aspect_ratio", "west": "region_west", "central": "region_central",
        "east": "region_east", "day": "dn_day", "twilight": "dn_twilight", "night": "dn_night"
    }
    rest = [F.col(c).cast("double").alias(n) for n, c in same.items()] + [
        F.round(c, 2).alias(n) for n, c in (("offset_km", "peak_offset_km"), ("offset_ratio", "peak_offset_ratio"))
    ]
    rest += [
        r4("month_cos").alias("month_cos"), r4("hour_sin").alias("hour_sin"),
        F.round(F.col("bt07_x_t713") + 1e-9, 3).alias("product")
    ]
    return f.select(
        "fire_id", *rest, r4("month_sin").alias("month_sin"), r4("hour_cos").alias("hour_cos"),
        F.round(F.col("distance_star_km") + 1e-9, 2).alias("star_km"),
        F.round(F.col("bt07_sq") + 1e-9, 3).alias("bt07_sq"), F.col("day_phase").alias("phase")
    )


FLAGS = " OR ".join(f"(x BETWEEN {a} AND {b} AND y BETWEEN {c} AND {d})" for a, b, c, d in features.URBAN_BOXES)
SANDS = " OR ".join(f"(x > {a} AND x < {b} AND y > {c} AND y < {d})" for a, b, c, d in features.DESERT_BOXES)


@query(
    f"WITH p AS (SELECT event_id, 73 + (event_id % 6007) / 100.0 AS x, 18 + (event_id % 3571) / 100.0 AS y FROM events) SELECT event_id, {FLAGS} AS urban, {SANDS} AS desert, CASE WHEN x < 105 THEN 'west' WHEN x < 115 THEN 'central' ELSE 'east' END AS region FROM p"
)
def region_flags(spark, sf_dir):
    k = F.col("event_id")
    p = table(spark, sf_dir, "events").select(
        k, (73 + F.pmod(k, F.lit(6007)) / 100.0).alias("x"), (18 + F.pmod(k, F.lit(3571)) / 100.0).alias("y")
    )
    return p.select(
        "event_id", features.urban("x", "y").alias("urban"), features.desert("x", "y").alias("desert"),
        features.region("x").alias("region")
    )


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'none' ELSE strftime(date_trunc('minute', ts), '%Y%m%d%H%M') END AS slot FROM events)
SELECT event_id, slot, CASE WHEN slot = 'none' THEN -1 ELSE CAST(floor((epoch(strptime(slot, '%Y%m%d%H%M')) - 946684800) / 600) AS BIGINT) END AS slot_ord FROM s""")
def slot_ordinals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.pmod("event_id", F.lit(29)) == 0, "none").otherwise(features.slot_text(F.col("ts"))).alias("slot")
    )
    return e.select("event_id", "slot", big(features.slot_ordinal("slot")).alias("slot_ord"))


# ------------------------------------------------------------------ validation and mining


@query()
def eval_match_metrics(spark, sf_dir):
    c = spots(spark, sf_dir).select(F.col("fire_id").alias("id"), "lon", "lat", "acq_ts")
    return evaluation.evaluate(c, refs(spark, sf_dir))


@query(
    f"WITH {SPOTS} SELECT count(*) AS candidate_count, CAST(0 AS BIGINT) AS reference_count, 'no_reference_detections' AS status, CAST(NULL AS DOUBLE) AS precision FROM spots"
)
def eval_no_reference(spark, sf_dir):
    c = spots(spark, sf_dir).select(F.col("fire_id").alias("id"), "lon", "lat", "acq_ts")
    none = refs(spark, sf_dir).filter(F.lit(False))
    m = evaluation.metrics(c, none, evaluation.match(c, none), 3, 5)
    return m.select("candidate_count", "reference_count", "status", "precision")


@query(f"""WITH {SPOTS}, {REFS} SELECT f.fire_id AS id, r.id AS r_id, round({hav('f.lon', 'f.lat', 'r.lon', 'r.lat')} + 1e-9, 3) AS km FROM spots f JOIN refs r ON abs(epoch_us(r.acq_ts) - epoch_us(f.acq_ts)) <= 3 * 3.6e9 AND r.lat BETWEEN f.lat - 0.1 AND f.lat + 0.1
WHERE {hav('f.lon', 'f.lat', 'r.lon', 'r.lat')} <= 5""")
def possible_matches(spark, sf_dir):
    c = spots(spark, sf_dir).select(F.col("fire_id").alias("id"), "lon", "lat", "acq_ts")
    return evaluation.possible_matches(c, refs(spark, sf_dir)).select(
        "id", "r_id", F.round(F.col("distance_km") + 1e-9, 3).alias("km")
    )


LINKS = f"""WITH RECURSIVE {REFS}, near AS (SELECT a.id AS a, b.id AS b FROM refs a JOIN refs b ON abs(epoch_us(a.acq_ts) - epoch_us(b.acq_ts)) <= 30 * 6e7 AND b.lat BETWEEN a.lat - 0.05 AND a.lat + 0.05 WHERE {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 2.5),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), label AS (SELECT a, min(b) AS component FROM reach GROUP BY a)"""


@query(
    f"{LINKS} SELECT component AS id, count(*) AS member_count, round(sum(frp) + 1e-9, 4) AS frp, round(sum(lon * (frp + 1)) / sum(frp + 1) + 1e-9, 4) AS lon, array_to_string(list_sort(list_distinct(list(sensor))), '+') AS sensor FROM refs JOIN label ON a = id GROUP BY component"
)
def reference_clusters(spark, sf_dir):
    return clusters.reference_clusters(refs(spark, sf_dir)).select(
        "id", "member_count", r4("frp").alias("frp"), r4("lon").alias("lon"), "sensor"
    )


HITS = """hits AS (SELECT event_id AS id, 104 + (user_id % 83) * 0.05 + (event_id % 3) * 0.002 AS lon, 30 + (user_id % 79) * 0.05 + (event_id % 5) * 0.002 AS lat, strftime(ts, '%Y-%m-%d') AS acq_date, value / 10 AS frp,
  CASE WHEN event_id % 2 = 0 THEN 'D' ELSE 'N' END AS daynight FROM events WHERE event_type = 'purchase')"""


@query(f"""WITH {HITS}, g AS (SELECT *, round(lon - (id % 3) * 0.002, 3) AS px, round(lat - (id % 5) * 0.002, 3) AS py FROM hits)
SELECT round(sum(lon * (frp + 1)) / sum(frp + 1) + 1e-9, 4) AS lon, round(sum(lat * (frp + 1)) / sum(frp + 1) + 1e-9, 4) AS lat, count(*) AS detection_count, count(DISTINCT acq_date) AS day_count, min(acq_date) AS first_date, max(acq_date) AS last_date, count(*) FILTER (daynight = 'D') AS by_day
FROM g GROUP BY px, py HAVING count(*) >= 4 AND count(DISTINCT acq_date) >= 4""")
def persistent_sources(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    p = e.select(
        k.alias("id"), (104 + F.pmod("user_id", F.lit(83)) * 0.05 + F.pmod(k, F.lit(3)) * 0.002).alias("lon"),
        (30 + F.pmod("user_id", F.lit(79)) * 0.05 + F.pmod(k, F.lit(5)) * 0.002).alias("lat"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), (F.col("value") / 10).alias("frp"),
        F.when(F.pmod(k, F.lit(2)) == 0, "D").otherwise("N").alias("daynight")
    )
    s = clusters.persistent_sources(p)
    return s.select(
        r4("lon").alias("lon"), r4("lat").alias("lat"), "detection_count", "day_count", "first_date", "last_date",
        "by_day"
    )


@query(
    "SELECT p_partkey, round(least(greatest(CASE WHEN p_retailprice - 1000 > 0 THEN sqrt((p_retailprice - 1000) / (35 * pi())) ELSE 0.25 END, 0.25), 2.5) + 1e-9, 2) AS radius FROM part"
)
def pv_radius(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(features.plant_radius_km(F.col("p_retailprice").cast("double") - 1000) + 1e-9, 2).alias("radius")
    )


# ------------------------------------------------------------------ weather


@query(
    """WITH h AS (SELECT user_id, list_sort(list_distinct(list(hour(ts)))) AS hours FROM events WHERE event_id % 3 <> 0 GROUP BY user_id),
f AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN list_concat([NULL], hours) ELSE hours END AS times FROM h), e AS (SELECT event_id, hour(ts) + 1 AS target, times FROM events LEFT JOIN f USING (user_id))
SELECT event_id, CASE WHEN times IS NULL THEN -1 ELSE least(len([t for t in times if coalesce(t < target, true)]), len(times) - 1) END AS at FROM e"""
)
def forecast_asof(spark, sf_dir):
    """For every event the place of the first forecast after its hour, among those of its user: hours of some events of theirs,
    with a missing time first for every second user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.hour("ts").alias("hour"))
    hours = e.filter(F.pmod("event_id", F.lit(3)) != 0).groupBy("user_id").agg(F.sort_array(F.collect_set("hour")).alias("h"))
    none = F.array(F.lit(None).cast("int"))
    times = F.when(F.pmod("user_id", F.lit(2)) == 0, F.concat(none, F.col("h"))).otherwise(F.col("h"))
    f = hours.select("user_id", times.alias("times"))
    at = F.when(F.col("times").isNull(), -1).otherwise(weather.forecast_index(F.col("times"), F.col("hour") + 1))
    return e.join(f, "user_id", "left").select("event_id", big(at).alias("at"))


@query("""WITH w AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN (event_id * 3) % 101 END AS rh, CASE WHEN event_id % 13 <> 0 THEN (event_id * 7) % 45 - 5 END AS t, CASE WHEN event_id % 17 <> 0 THEN (event_id * 5) % 25 END AS wind, (event_id % 8) / 2.0 AS rain, event_id % 3000 AS cape FROM events)
SELECT event_id, CAST(floor(least(greatest(0.38 * CASE WHEN rh IS NULL THEN 0.4 ELSE least(greatest((100 - rh) / 100.0, 0), 1) END + 0.32 * CASE WHEN t IS NULL THEN 0.3 ELSE least(greatest((t - 18) / 20.0, 0), 1) END + 0.22 * CASE WHEN wind IS NULL THEN 0.25 ELSE least(greatest(wind / 18.0, 0), 1) END
 + least(greatest(cape / 2500.0, 0), 1) * 0.2 - 0.35 * least(greatest(rain / 6, 0), 1), 0), 1) * 100 + 0.5) AS BIGINT) AS risk FROM w""")
def fire_risk_index(spark, sf_dir):
    k = F.col("event_id")
    some = lambda m, x: F.when(F.pmod(k, F.lit(m)) != 0, x.cast("double"))
    risk = weather.fire_risk(
        some(11, F.pmod(k * 3, F.lit(101))), some(13, F.pmod(k * 7, F.lit(45)) - 5), some(17, F.pmod(k * 5, F.lit(25))),
        F.pmod(k, F.lit(8)) / 2.0, None, F.pmod(k, F.lit(3000)).cast("double")
    )
    return table(spark, sf_dir, "events").select("event_id", big(risk).alias("risk"))


#: A weather grid per supplier: bounds are swapped for every third, beyond the poles for every fifth, absent for every seventh;
#: steps are too small for every fourth.
BOXES = """boxes AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_suppkey % 5 = 0 THEN 88.0 ELSE (s_suppkey % 60)::DOUBLE END END AS a,
  CASE WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_suppkey % 5 = 0 THEN 95.0 ELSE s_suppkey % 60 + 3.5 END END AS b, CASE WHEN s_suppkey % 7 <> 0 THEN 100.0 + s_suppkey % 50 END AS c,
  CASE WHEN s_suppkey % 7 <> 0 THEN 104.0 + s_suppkey % 50 END AS d, CASE WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_suppkey % 4 = 0 THEN 0.1 ELSE 0.75 END END AS step FROM supplier),
ends AS (SELECT k, greatest(least(coalesce(CASE WHEN k % 3 = 0 THEN b ELSE a END, 31.9), 90), -90) AS a, greatest(least(coalesce(CASE WHEN k % 3 = 0 THEN a ELSE b END, 47.9), 90), -90) AS b,
  coalesce(c, 108.39) AS c, coalesce(d, 124.39) AS d, greatest(coalesce(step, 2.0), 0.25) AS step FROM boxes),
axes AS (SELECT k, least(a, b) AS low, CAST(floor((greatest(a, b) - least(a, b) + 1e-4) / step) AS BIGINT) AS n, c, CAST(floor((d - c + 1e-4) / step) AS BIGINT) AS m, step FROM ends)"""


@query(
    f"WITH {BOXES}, lats AS (SELECT k, c, m, step, low, unnest(range(n + 1)) AS i FROM axes), both_ AS (SELECT *, unnest(range(m + 1)) AS j FROM lats) SELECT k, round(low + i * step, 4) AS lat, round(c + j * step, 4) AS lon FROM both_"
)
def weather_grid(spark, sf_dir):
    """The points of a weather grid for every supplier, some by the default bounds."""
    k = F.col("s_suppkey")
    some = lambda x: F.when(F.pmod(k, F.lit(7)) != 0, x.cast("double"))
    low = F.when(F.pmod(k, F.lit(5)) == 0, 88.0).otherwise(F.pmod(k, F.lit(60)))
    high = F.when(F.pmod(k, F.lit(5)) == 0, 95.0).otherwise(F.pmod(k, F.lit(60)) + 3.5)
    swapped, west = F.pmod(k, F.lit(3)) == 0, F.pmod(k, F.lit(50)) + 100
    step = some(F.when(F.pmod(k, F.lit(4)) == 0, 0.1).otherwise(0.75))
    boxes = table(spark, sf_dir, "supplier").select(
        k.alias("k"), some(F.when(swapped, high).otherwise(low)).alias("min_lat"),
        some(F.when(swapped, low).otherwise(high)).alias("max_lat"), some(west).alias("min_lon"),
        some(west + 4).alias("max_lon"), step.alias("step_lat"), step.alias("step_lon")
    )
    return weather.grids_of(boxes, "k")


@query("""SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN value + 250 - 273.15 ELSE value END + 1e-9, 4) AS c, round(CASE event_id % 3 WHEN 0 THEN value * 1000 / 100 WHEN 1 THEN value * 10 ELSE value END + 1e-9, 4) AS hpa,
 round(CASE WHEN event_id % 5 = 0 THEN value * 1000 ELSE value END + 1e-9, 4) AS mm FROM events""")
def unit_convert(spark, sf_dir):
    k, v = F.col("event_id"), F.col("value")
    unit3 = F.when(F.pmod(k, F.lit(3)) == 0, "Pa").when(F.pmod(k, F.lit(3)) == 1, "kPa").otherwise("hPa")
    return table(spark, sf_dir, "events").select(
        "event_id",
        r4(
            weather.celsius(
                F.when(F.pmod(k, F.lit(2)) == 0, v + 250).otherwise(v),
                F.when(F.pmod(k, F.lit(2)) == 0, "K").otherwise("C")
            )
        ).alias("c"),
        r4(weather.hectopascal(F.when(F.pmod(k, F.lit(3)) == 0, v * 1000).otherwise(v), unit3)).alias("hpa"),
        r4(weather.millimetres(v, F.when(F.pmod(k, F.lit(5)) == 0, "m").otherwise("mm"))).alias("mm"),
    )


# ------------------------------------------------------------------ catalog


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 1),
old AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1), new AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)
SELECT coalesce(new.k, old.k) AS k, coalesce(old.seq, new.seq) AS created, coalesce(new.seq, old.seq) AS updated FROM old FULL JOIN new ON old.k = new.k""")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("created"), F.col("o_orderkey").alias("updated")
    )
    old = catalog.first_rows(o.filter(F.pmod("created", F.lit(2)) == 0), ["k"], ["created"])
    return catalog.upsert(
        old, o.filter(F.pmod("created", F.lit(2)) == 1), "k", "updated", keep=("created",)
    ).select("k", "created", "updated")


@query("""WITH o AS (SELECT p_partkey AS path, p_size AS size, sha256(p_name) AS sha FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS path, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS size, sha256(CASE WHEN p_partkey % 13 = 0 THEN p_name || '!' ELSE p_name END) AS sha FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'new' WHEN o.size <> n.size OR o.sha <> n.sha THEN 'changed' WHEN n.path % 11 = 0 THEN 'missing' ELSE 'same' END AS change FROM o FULL JOIN n ON o.path = n.path""")
def manifest_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), F.sha2("p_name", 256).alias("sha256"), "p_name"
    )
    old, new = p.filter(F.pmod("path", F.lit(5)) != 0), p.filter(F.pmod("path", F.lit(7)) != 0).withColumn(
        "size", F.col("size") + F.when(F.pmod("path", F.lit(3)) == 0, 1).otherwise(0)
    ).withColumn(
        "sha256", F.when(F.pmod("path", F.lit(13)) == 0, F.sha2(F.concat("p_name", F.lit("!")), 256)).otherwise(F.col("sha256"))
    )
    return catalog.manifest_changes(old, new, p.filter(F.pmod("path", F.lit(11)) != 0))


@query("""WITH f AS (SELECT l_orderkey // 10 AS scene_id, CAST(l_linenumber AS VARCHAR) AS band, l_orderkey % 10 AS segment FROM lineitem), p AS (SELECT scene_id, band, count(DISTINCT segment) AS n, count(DISTINCT segment) FILTER (segment IN (1, 2, 3)) AS have FROM f WHERE band IN ('1', '2') GROUP BY ALL),
good AS (SELECT scene_id FROM p WHERE have = 3 AND n >= 3 GROUP BY scene_id HAVING count(*) = 2)
SELECT scene_id, count(*) AS n_files, md5(string_agg(path, ',' ORDER BY band, segment, path)) AS paths FROM (SELECT *, band || '/' || segment AS path FROM f WHERE band IN ('1', '2')) JOIN good USING (scene_id) GROUP BY scene_id""")
def scene_completeness(spark, sf_dir):
    k = F.col("l_orderkey")
    f = table(spark, sf_dir, "lineitem").select(
        big(F.floor(k / 10)).alias("scene_id"), F.col("l_linenumber").cast("string").alias("band"),
        F.pmod(k, F.lit(10)).alias("segment")
    ).withColumn("path", F.concat_ws("/", "band", F.col("segment").cast("string")))
    return catalog.complete_scenes(f, ["1", "2"], [1, 2, 3]).select(
        "scene_id", F.size("files").cast("long").alias("n_files"), F.md5(F.array_join("files.path", ",").cast("binary")).alias("paths")
    )


@query("""WITH p AS (SELECT CAST(p_retailprice AS DOUBLE) / 10 AS mw FROM part), h AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_type = 'purchase')
SELECT (SELECT count(*) FROM p) AS plant_count, round((SELECT sum(mw) FROM p) + 1e-9, 1) AS mw, count(*) AS hit_count, min(d) AS first_date, max(d) AS last_date,
  (SELECT count(*) FROM nation) AS persistent_count, (SELECT count(*) FROM supplier) AS static_count, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM p) AS automatic_count FROM h""")
def interference_summary(spark, sf_dir):
    plants = table(spark, sf_dir, "part").select((F.col("p_retailprice").cast("double") / 10).alias("capacity_mw"))
    hits = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date")
    )
    s = summaries.interference_summary(plants, hits, table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"))
    return s.select(
        "plant_count", F.round(F.col("total_capacity_mw") + 1e-9, 1).alias("mw"), "hit_count", "first_date",
        "last_date", "persistent_count", "static_count", "automatic_count"
    )


@query(f"""WITH {CASCADE}, {REFS}, beside AS (
  SELECT f.scene_id, f."row", f.col, r.id, {hav('f.lon', 'f.lat', 'r.lon', 'r.lat')} AS d, abs(epoch_us(r.acq_ts) - epoch_us(f.acq_ts)) AS dt FROM fires f JOIN refs r ON abs(epoch_us(r.acq_ts) - epoch_us(f.acq_ts)) <= 3 * 3.6e9 AND r.lat BETWEEN f.lat - 0.1 AND f.lat + 0.1
), closest AS (SELECT * FROM beside WHERE d <= 4 QUALIFY row_number() OVER (PARTITION BY scene_id, "row", col ORDER BY d, dt, id) = 1
), per AS (SELECT f.scene_id, count(*) AS n, count(b.id) AS confirmed, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'low') AS low FROM fires f LEFT JOIN closest b USING (scene_id, "row", col) GROUP BY f.scene_id)
SELECT s.scene_id, count(*) AS seeds, coalesce(any_value(n), 0) AS fire_pixel_count, coalesce(any_value(confirmed), 0) AS official_confirmed_pixel_count, coalesce(any_value(high), 0) AS high, coalesce(any_value(low), 0) AS low,
  (SELECT count(*) FROM refs) AS official_reference_count, (SELECT count(DISTINCT id) FROM closest) AS official_matched_count
FROM scored s LEFT JOIN per USING (scene_id) GROUP BY s.scene_id""")
def run_summary(spark, sf_dir):
    """Stages, fires and what official detections say of them, by scene."""
    from emberframe.plans import scene

    found = kept(judged(spark, sf_dir), "judged")
    fires = kept(spatial.nearest_reference(scene.fire_rows(found), refs(spark, sf_dir)), "fires")
    ranges = spatial.official_ranges(
        refs(spark, sf_dir).withColumns({"scan_km": F.lit(0.4), "track_km": F.lit(0.4)}), fires
    )
    return summaries.run_summary(found, fires, None, ranges).select(
        "scene_id", "seeds", "fire_pixel_count", "official_confirmed_pixel_count", "high", "low",
        "official_reference_count", "official_matched_count"
    )


@query("""SELECT event_id, CAST(1700000000000 + (event_id % 7) * 3600000 + CASE WHEN event_id % 5 <= 1 THEN 3600000 ELSE 10800000 END AS BIGINT) AS forecast_ms,
  round(CASE WHEN event_id % 5 <= 1 THEN event_id % 40 ELSE event_id % 40 + 2 END + 1e-9, 1) AS temp_c, round(CASE WHEN event_id % 5 <= 1 THEN 40 ELSE 60 END + 1e-9, 1) AS rh_pct FROM events WHERE event_id % 11 <> 0""")
def forecast_payloads(spark, sf_dir):
    """Answers of a forecast service as they come, one without times in eleven, at the first time from a target on."""
    from emberframe.sources import readers

    k = F.col("event_id")
    first = F.lit(1700000000000) + F.pmod(k, F.lit(7)) * 3600000
    warm = F.pmod(k, F.lit(40)) + 273.15
    payload = F.format_string(
        '{"ts":[%d,%d],"units":{"temp-surface":"K","rh-surface":"%%"},"temp-surface":[%f,%f],"rh-surface":[40,60],"warning":"x"}',
        first + 3600000, first + 10800000, warm, warm + 2
    )
    answers = table(spark, sf_dir, "events").select(
        k.cast("double").alias("lat"), (1 + F.pmod(k, F.lit(5))).cast("double").alias("lon"),
        F.when(F.pmod(k, F.lit(11)) != 0, payload).otherwise('{"ts":[]}').alias("payload")
    )
    at = F.lit(1700000000000) + F.pmod(
        F.col("lat").cast("long"), F.lit(7)
    ) * 3600000 + F.col("lon").cast("long") * 1800000
    cells = weather.forecast_cells(readers.forecast_series(answers), at, 2.0, 2.0)
    return cells.select(
        big("lat").alias("event_id"), F.unix_millis("forecast_ts").alias("forecast_ms"),
        F.round(F.col("temp_c") + 1e-9, 1).alias("temp_c"), F.round(F.col("rh_pct") + 1e-9, 1).alias("rh_pct")
    )


@query("""WITH o AS (SELECT c_custkey AS source_id, 'd/' || c_custkey AS local_path, CASE WHEN c_custkey % 2 = 0 THEN 'w' || c_custkey END AS web_path FROM customer), f AS (SELECT 'd/' || s_suppkey AS local_path, 's' || s_suppkey AS file_name, 'web/' || s_suppkey AS web_path FROM supplier)
SELECT source_id, coalesce(f.file_name, CAST(source_id AS VARCHAR)) AS file_name, coalesce(f.web_path, o.web_path) AS web_path FROM o LEFT JOIN f USING (local_path)""")
def overlay_files(spark, sf_dir):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    overlays = table(spark, sf_dir, "customer").select(
        c.alias("source_id"), F.lit("raster").alias("type"), F.concat(F.lit("d/"), c).alias("local_path"),
        F.when(c % 2 == 0, F.concat(F.lit("w"), c)).alias("web_path"), F.lit(None).cast("string").alias("description")
    )
    files = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("d/"), s).alias("local_path"), F.concat(F.lit("s"), s).alias("file_name"),
        F.concat(F.lit("web/"), s).alias("web_path"), F.lit(0).alias("place")
    )
    return catalog.resolved_overlays(overlays, files).select("source_id", "file_name", "web_path")


@query(
    "SELECT event_id, round(73 + (event_id % 2500 % 50) * 0.02e0, 6) AS lon, round(54 - (event_id % 2500 // 50) * 0.02e0, 6) AS lat FROM events"
)
def affine_grid(spark, sf_dir):
    p = pix(spark, sf_dir)
    lon, lat = R.affine_lon_lat("row", "col", 73.0, 54.0, 0.02, -0.02)
    return p.select("event_id", lon.alias("lon"), lat.alias("lat"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE")
def slot_retention(spark, sf_dir):
    return catalog.retained(
        table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "ts", 60
    ).select("event_id")


@query(
    f"WITH {REFS}, d AS (SELECT id // 2 AS id, sensor, strftime(acq_ts, '%Y-%m-%d') AS acq_date, round(lon, 1) AS lon, round(lat, 1) AS lat FROM refs) SELECT sensor, lon, lat, acq_date, min(id) AS id FROM d GROUP BY ALL"
)
def dedupe_first(spark, sf_dir):
    d = refs(spark, sf_dir).select(
        big(F.floor(F.col("id") / 2)).alias("id"), "sensor", F.round("lon", 1).alias("lon"),
        F.round("lat", 1).alias("lat"), F.date_trunc("day", "acq_ts").alias("acq_ts")
    )
    return catalog.distinct_references(d, "id").select("sensor", "lon", "lat", F.date_format("acq_ts", "yyyy-MM-dd").alias("acq_date"), "id")


@query(f"""WITH {REFS} SELECT id FROM refs WHERE lon BETWEEN 104.6 AND 105.2 AND lat BETWEEN 30.1 AND 30.9 AND abs(epoch_us(acq_ts) - epoch_us(TIMESTAMP '2026-01-04 00:00:00')) <= 48 * 3.6e9
 AND CASE WHEN sensor = 'MODIS' THEN TRY_CAST(confidence AS DOUBLE) >= 30 ELSE confidence IN ('nominal', 'high', 'n', 'h') END""")
def accepted_references(spark, sf_dir):
    r = refs(spark, sf_dir).withColumn("fire_type", F.lit("0"))
    return catalog.accepted_references(
        r, (104.6, 30.1, 105.2, 30.9), F.timestamp_seconds(F.lit(1767484800)), 48
    ).select("id")


@query(
    "SELECT event_id, round(epoch(TIMESTAMP '2024-02-01 00:00:00' - ts) / 60 + 1e-9, 1) AS age, epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts) > 20 * 6e7 AS stale FROM events"
)
def staleness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("acq_ts"))
    s = catalog.staleness(e, F.timestamp_seconds(F.lit(1706745600)))
    return s.select("event_id", F.col("age_minutes").alias("age"), "stale")


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderpriority AS band, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders),
l AS (SELECT *, n % least(4, c) AS lane FROM f) SELECT k, lane, CAST((row_number() OVER (PARTITION BY band, lane ORDER BY k) - 1) // 25 AS BIGINT) AS batch FROM l""")
def transfer_lanes(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("band"))
    return catalog.transfer_lanes(f, 4, 25, ("k",)).select("k", big("lane").alias("lane"), big("batch").alias("batch"))


@query(
    "SELECT o_orderkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"
)
def unmatched_keys(spark, sf_dir):
    parent = table(spark, sf_dir, "customer").filter(F.pmod("c_custkey", F.lit(3)) != 0)
    return catalog.unmatched_keys(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("ck")), parent,
        "ck", "c_custkey"
    ).select("k")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return catalog.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT s_suppkey, CASE WHEN y >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(CAST(floor(y) AS INT)) AS VARCHAR), 2, '0') || '_00_' || CASE WHEN x >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(CAST(floor(x) AS INT)) AS VARCHAR), 3, '0') || '_00' AS dem,
 'HS_H09_20260101_0' || (s_suppkey % 10) || '10_B' || CASE WHEN s_suppkey % 2 = 0 THEN '03_FLDK_R05' ELSE '07_FLDK_R20' END || '_S' || lpad(CAST(1 + s_suppkey % 10 AS VARCHAR), 2, '0') || '10.DAT.bz2' AS name, CAST(1 + s_suppkey % 10 AS BIGINT) AS segment
 FROM (SELECT s_suppkey, (s_suppkey % 357) - 178.5 AS x, (s_suppkey % 171) - 85.5 AS y FROM supplier)""")
def archive_names(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        k, (F.pmod(k, F.lit(357)) - 178.5).alias("x"), (F.pmod(k, F.lit(171)) - 85.5).alias("y"),
        F.when(F.pmod(k, F.lit(2)) == 0, "03").otherwise("07").alias("band")
    )
    s = s.withColumn(
        "name",
        names.expected_name(
            F.lit("H09"), F.concat(F.lit("202601010"), F.pmod(k, F.lit(10)).cast("string"), F.lit("10")), "band",
            1 + F.pmod(k, F.lit(10))
        )
    )
    return s.select(
        "s_suppkey", geo.elevation_tile("x", "y").alias("dem"), "name",
        big(names.segment_name("name")["segment"]).alias("segment")
    )


@query(
    "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS slot, count(*) AS n, round(max(value) + 1e-9, 4) AS max_value FROM events GROUP BY 1"
)
def stream_slot_counts(spark, sf_dir):
    """The events as a stream: tumbling slots under a watermark; each micro-batch tells the slots that it changed."""
    from emberframe.streaming import scenes

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    found = []
    slots = scenes.slot_counts(source, 10, 60)
    run = slots.writeStream.outputMode("update").foreachBatch(
        lambda batch, k: found.append(kept(batch.withColumn("batch", F.lit(k)), "slots"))
    ).trigger(availableNow=True).start()
    run.awaitTermination()
    told = found[0]
    for batch in found[1:]:
        told = told.unionByName(batch)
    return catalog.first_rows(told, ["slot"], [F.desc("batch")]).select(
        F.col("slot").cast("timestamp_ntz").alias("slot"), "n", r4("max_value").alias("max_value")
    )


@query(
    "SELECT n_nationkey AS id, n_regionkey AS component FROM (SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS n_regionkey FROM nation)"
)
def connected_components(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    first = n.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("b"))
    e = n.join(first, "n_regionkey").select(F.col("n_nationkey").alias("a"), "b")
    return graphs.connected_components(n.select(F.col("n_nationkey").alias("id")), e)


@query(
    f"""WITH {SPOTS} SELECT fire_id, round(CASE WHEN score <= 0.5 THEN 7 WHEN score <= 2 THEN 7 + (score - 0.5) / 1.5 * 3 WHEN score <= 4 THEN 10 + (score - 2) / 2 * 4 ELSE 14 END + 1e-9, 4) AS size FROM spots WHERE lon BETWEEN 104.6 AND 105.2 AND lat BETWEEN 30.1 AND 30.8"""
)
def symbols_in_extent(spark, sf_dir):
    return serving.in_extent(spots(spark, sf_dir), (104.6, 30.1, 105.2, 30.8)).select(
        "fire_id", r4(serving.symbol_size("score")).alias("size")
    )


@query(f"""WITH {SPOTS}, g AS (SELECT 104.5 + a.k * 0.25 AS gx, 30 + b.k * 0.25 AS gy, a.k * 10 + b.k AS t FROM range(6) a(k), range(6) b(k))
SELECT fire_id, arg_min(t, {hav('lon', 'lat', 'gx', 'gy')}) AS t FROM (SELECT fire_id, lon + 0.003 AS lon, lat + 0.007 AS lat FROM spots), g GROUP BY fire_id""")
def weather_at_fires(spark, sf_dir):
    p = spots(spark, sf_dir).select("fire_id", (F.col("lon") + 0.003).alias("lon"), (F.col("lat") + 0.007).alias("lat"))
    k = spark.range(36).select(F.floor(F.col("id") / 6).alias("a"), F.pmod("id", F.lit(6)).alias("b"))
    g = k.select(
        (104.5 + F.col("a") * 0.25).alias("lon"), (30 + F.col("b") * 0.25).alias("lat"),
        (F.col("a") * 10 + F.col("b")).alias("t")
    )
    return serving.value_at(p, g, 0.25, 0.25, "fire_id").select("fire_id", big("grid_t").alias("t"))


@query(
    "SELECT event_id, CASE WHEN event_id % 80 >= 72 THEN 0 ELSE event_id % 80 + 3 END AS next_hour, least(1704326400, greatest(1704110400, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + (event_id % 80) * 3600)) AS frame FROM events"
)
def forecast_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.pmod("event_id", F.lit(80)).alias("h")
    )
    return e.select(
        "event_id", big(serving.next_forecast_hour("h")).alias("next_hour"),
        serving.frame_time(F.col("ts"), "h", F.lit(1704110400), F.lit(1704326400)).alias("frame")
    )


@query(
    "WITH w AS (SELECT o_orderkey AS cycle, o_custkey AS name FROM orders) SELECT max(cycle) AS cycle FROM w WHERE name IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)"
)
def latest_available_cycle(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cycle"), F.col("o_custkey").alias("name"))
    have = table(spark, sf_dir, "customer").filter(
        F.pmod("c_custkey", F.lit(5)) == 0
    ).select(F.col("c_custkey").alias("name"))
    return catalog.latest_available(w, have, "cycle").select("cycle")


@query(
    f"""WITH {SPOTS}, ids AS (SELECT scene_id AS s, TIMESTAMP '2026-01-01 04:00:00' + to_seconds(22200 * scene_id) AS t FROM (SELECT DISTINCT scene_id FROM pix WHERE scene_id % 2 = 0)) SELECT fire_id, CAST(s AS VARCHAR) AS catalog_scene FROM spots LEFT JOIN ids ON acq_ts = t"""
)
def catalog_scene_ids(spark, sf_dir):
    p = pix(spark, sf_dir).filter("scene_id % 2 = 0").select("scene_id", "acq_ts").distinct()
    return catalog.scene_ids(spots(spark, sf_dir), p).select(
        "fire_id", F.col("scene_id").cast("string").alias("catalog_scene")
    )


@query(
    "WITH n AS (SELECT c_nationkey AS k, 2 AS p, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY ALL UNION ALL SELECT s_nationkey, 1, count(*) FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY ALL) SELECT k, p, n FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY p) = 1"
)
def source_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_nationkey % 3 <> 0").groupBy(
        F.col("c_nationkey").alias("k")
    ).agg(F.count("*").alias("n")).withColumn("p", F.lit(2))
    s = table(spark, sf_dir, "supplier").filter("s_nationkey % 2 = 0").groupBy(
        F.col("s_nationkey").alias("k")
    ).agg(F.count("*").alias("n")).withColumn("p", F.lit(1))
    return catalog.by_priority(c.unionByName(s), ["k"], "p").select("k", "p", "n")


@query(
    "WITH h AS (SELECT o_custkey AS band, count(DISTINCT o_orderkey % 10) AS found FROM orders WHERE o_orderkey % 10 > 3 GROUP BY o_custkey) SELECT c_custkey AS band, coalesce(found, 0) AS found, greatest(4 - coalesce(found, 0), 0) AS missing, greatest(4 - coalesce(found, 0), 0) = 0 AS complete FROM customer LEFT JOIN h ON band = c_custkey"
)
def slot_completeness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("band"), F.pmod("o_orderkey", F.lit(10)).alias("segment")
    ).filter("segment > 3")
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("band"), F.lit(4).alias("wanted"))
    return catalog.completeness(o, e, ("band",)).select("band", "found", "missing", "complete")


@query(
    f"""WITH {SPOTS}, routed AS (SELECT *, (fire_id % 10) / 10.0 AS p, lon < 105 AS west, tier = 'model-rescue' AND NOT official_confirmed AND CASE WHEN lon < 105 THEN (fire_id % 10) / 10.0 ELSE 0 END < 0.35 AS dropped FROM spots),
kept AS (SELECT * FROM routed WHERE NOT dropped QUALIFY NOT west OR official_confirmed OR row_number() OVER (PARTITION BY scene_id, west ORDER BY official_confirmed DESC, p DESC, fire_id) <= 50)
SELECT count(*) AS scored, count(*) FILTER (west) AS west, count(*) FILTER (tier = 'model-rescue') AS rescued, count(*) FILTER (dropped) AS rescue_dropped, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FILTER (west) FROM kept) AS kept_west, (SELECT count(*) FILTER (NOT west) FROM kept) AS kept_elsewhere FROM routed"""
)
def score_summary(spark, sf_dir):
    s = kept(
        spots(spark, sf_dir).withColumns(
            {
                "center_lon": F.col("lon"), "west_prob": F.pmod("fire_id", F.lit(10)) / 10,
                "east_prob": F.lit(None).cast("double"), "confidence": F.lit("low")
            }
        ),
        "spots"
    )
    routed = ranking.route(s)
    return ranking.score_summary(routed, ranking.within_budget(routed))


@query()
def scene_flow(spark, sf_dir):
    """The whole online flow: cascade, rescue, official detections, suppression."""
    from emberframe.plans import scene

    r = refs(spark, sf_dir).withColumns({"scan_km": F.lit(0.4), "track_km": F.lit(0.4)})
    out = scene.detect(pix(spark, sf_dir), heat(spark, sf_dir), zone(spark), r, c=scene.SceneConfig(rescue=RESCUE))
    return out.selected.select("fire_id", "scene_id", "row", "col", "score", "confidence", "official_confirmed", "tier")


# ------------------------------------------------------------------ encoded grids, rounding

#: Scenes of 2,500 events as grids of 50 columns, or of one row where the last scene's events make no whole rows. The stand-in
#: for files: a scene's values, in order, as one array.
GRIDS = """grids AS (SELECT event_id // 2500 AS scene_id, CASE WHEN count(*) % 50 = 0 THEN 50 ELSE count(*) END AS nx FROM events GROUP BY ALL),
placed AS (SELECT event_id // 2500 AS scene_id, CAST(row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) - 1 AS INTEGER) AS k, value FROM events)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, nx, numbers): the events of a scene, at most 2,500, in the order of their ids."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2500).alias("scene_id"), "event_id", "value")
    g = e.groupBy(big("scene_id").alias("scene_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return g.select("scene_id", F.when(F.size("v") % 50 == 0, 50).otherwise(F.size("v")).alias("nx"), F.col("v.value").alias("numbers"))


@query(
    f"""WITH {GRIDS} SELECT scene_id, CAST(k % nx AS INTEGER) AS i, CAST(k // nx AS INTEGER) AS j, round(30 - 0.02 * (k // nx) + 1e-9, 4) AS lat, round(104.5 + 0.02 * (k % nx) + 1e-9, 4) AS lon, round(round(value * 100) / 100 + 1e-9, 2) AS value FROM placed JOIN grids USING (scene_id)"""
)
def sql_grib_values(spark, sf_dir):
    """Every event's value, packed into weather messages scene by scene and read again by SQL."""
    from emberframe.sources import grib, table_functions

    table_functions.register(spark)
    g = grids(spark, sf_dir).withColumn("numbers", F.transform("numbers", lambda v: F.round(v * 100) / 100))
    files = g.select(
        "scene_id", grib.encode_grid("numbers", "nx", F.lit(30.0), F.lit(104.5), 0.02, 0.02, width=24).alias("content")
    )
    v = spark.sql("SELECT f.scene_id, v.* FROM {files} f, LATERAL grib_values(f.content) v", files=files)
    return v.select("scene_id", "i", "j", r4("lat").alias("lat"), r4("lon").alias("lon"), F.round(F.col("value") + 1e-9, 2).alias("value"))


@query(
    f"""WITH {GRIDS} SELECT scene_id, CAST(k // nx AS INTEGER) AS "row", CAST(k % nx AS INTEGER) AS col, round(CAST(CAST(value AS FLOAT) AS DOUBLE) + 1e-9, 4) AS value, kind FROM placed JOIN grids USING (scene_id), (VALUES ('float32'), ('json')) kinds(kind)"""
)
def sql_raster_values(spark, sf_dir):
    """Every event's value as rasters of floats and of JSON, read again by SQL."""
    from emberframe.sources import table_functions

    table_functions.register(spark)

    @F.pandas_udf("binary")
    def floats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.asarray(v, dtype="<f4").tobytes() for v in batch])

    g = grids(spark, sf_dir).withColumn("height", (F.size("numbers") / F.col("nx")).cast("int"))
    single = F.transform("numbers", lambda v: v.cast("float").cast("double"))
    raw = g.select("scene_id", "nx", "height", floats("numbers").alias("content"), F.to_json(single).cast("binary").alias("text"))
    both = spark.sql(
        "SELECT f.scene_id, v.row, v.col, CAST(v.value AS DOUBLE) AS value, 'float32' AS kind FROM {raw} f, LATERAL raster_values(f.content, 'float32', f.height, f.nx) v "
        "UNION ALL SELECT f.scene_id, v.row, v.col, v.value, 'json' AS kind FROM {raw} f, LATERAL raster_values(f.text, 'json', f.height, f.nx) v",
        raw=raw
    )
    return both.select("scene_id", "row", "col", r4("value").alias("value"), "kind")


@query(
    """WITH given AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * ((event_id * 7919) % 100003) AS k FROM events),
parts AS (SELECT event_id, k, d, p, abs(k) * p // 8 AS q, abs(k) * p % 8 AS r FROM given, (VALUES (0, 1), (1, 10), (2, 100)) digits(d, p))
SELECT event_id, CAST(d AS INTEGER) AS digits, CAST(sign(k) * (q + CASE WHEN r > 4 OR (r = 4 AND q % 2 = 1) THEN 1 ELSE 0 END) / p AS DOUBLE) AS rounded FROM parts"""
)
def round_half_even(spark, sf_dir):
    """Eighths, which have ties at every number of decimals below three, rounded with ties to even."""
    from emberframe.functions.rounding import half_even

    e = table(spark, sf_dir, "events").select(
        "event_id", (F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1) * F.pmod(F.col("event_id") * 7919, F.lit(100003)) / 8).alias("x")
    )
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("digits"), half_even("x", d).alias("rounded")) for d in (0, 1, 2)]))
    return e.select("event_id", each.alias("v")).select("event_id", "v.digits", (F.col("v.rounded") + 0.0).alias("rounded"))


@query(
    f"""WITH {SPOTS}, picked AS (SELECT fire_id, scene_id, "row", col, round(score * 2 + 1e-9, 4) AS score, 'high' AS confidence, round(score / 20 + 1e-9, 6) AS model_prob FROM spots WHERE fire_id % 3 = 0)
SELECT s.fire_id, round(coalesce(p.score, s.score) + 1e-9, 4) AS score, coalesce(p.confidence, 'low') AS confidence, p.model_prob, p.fire_id IS NOT NULL AS scored FROM spots s LEFT JOIN picked p ON s.fire_id = p.fire_id
WHERE p.fire_id IS NOT NULL OR s.lon >= 105 OR s.official_confirmed"""
)
def sync_scores(spark, sf_dir):
    """Scores of every third fire carried back to all fires; western ones without one go unless confirmed."""
    s = spots(spark, sf_dir).withColumn("confidence", F.lit("low"))
    scored = s.filter(F.pmod("fire_id", F.lit(3)) == 0).withColumns({
        "score": F.round(F.col("score") * 2 + 1e-9, 4), "confidence": F.lit("high"),
        "model_prob": F.round(F.col("score") / 20 + 1e-9, 6)
    })
    out = ranking.sync_scores(s, scored)
    return out.select("fire_id", r4("score").alias("score"), "confidence", "model_prob", F.col("model_prob").isNotNull().alias("scored"))


@query(
    f"""WITH RECURSIVE {SPOTS}, near AS (SELECT a.fire_id AS a, b.fire_id AS b FROM spots a JOIN spots b ON a.scene_id = b.scene_id AND a.user_id % 5 = b.user_id % 5 AND abs(a.lat - b.lat) <= 0.03 WHERE {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 2.5),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), label AS (SELECT a, min(b) AS event_id FROM reach GROUP BY a)
SELECT event_id, min(acq_ts + to_seconds(60 * 3600 * (user_id % 5))) AS first_seen, count(DISTINCT acq_ts) AS persistence_count, count(*) AS fire_count, round(avg(lon) + 1e-9, 4) AS lon, round(avg(lat) + 1e-9, 4) AS lat, max(score) AS max_score FROM spots JOIN label ON a = fire_id GROUP BY event_id"""
)
def fire_events(spark, sf_dir):
    """All fires as events: those of a scene and fifth of its users that chain together within 2.5 km at one time."""
    from emberframe.operators import events

    f = spots(spark, sf_dir).withColumn("fifth", F.pmod("user_id", F.lit(5)))
    late = F.col("fifth") * 60 * 3600 * 1_000_000
    f = f.withColumn("acq_ts", F.timestamp_micros(F.unix_micros("acq_ts") + late))
    # scenes and fifths come within 30 minutes of each other: 39 scenes are 4 fifths and half an hour
    e = events.fire_events(f, 2.5, 30.0, by=("scene_id", "fifth"), digits=None)
    return e.select(
        "event_id", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), "persistence_count", "fire_count",
        r4("lon").alias("lon"), r4("lat").alias("lat"), "max_score"
    )


@query("SELECT p_partkey AS path, CAST(strlen(p_name) AS BIGINT) AS size, md5(p_name) AS md5, sha256(p_name) AS sha256 FROM part")
def file_digests(spark, sf_dir):
    """Digests of every part's name, each also listed a second time with other contents that do not count."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("path"), F.col("p_name").cast("binary").alias("content"), F.lit(0).alias("order")
    )
    again = p.withColumns({"content": F.encode(F.lit("other"), "utf-8"), "order": F.lit(1)})
    return catalog.digests(p.unionByName(again))


@query(
    f"""WITH {SPOTS}, squares AS (SELECT s_suppkey AS id, s_name AS name, 104.507 + (s_suppkey % 31) * 0.03 AS x, 30.007 + (s_suppkey % 29) * 0.03 AS y FROM supplier)
SELECT fire_id, (SELECT arg_min(name, id) FROM squares WHERE lon BETWEEN x AND x + 0.06 AND lat BETWEEN y AND y + 0.06) AS polygon_name FROM spots"""
)
def polygon_names(spark, sf_dir):
    """The supplier on whose square every fire lies; squares overlap, and the least number is on top."""
    x = 104.507 + F.pmod("s_suppkey", F.lit(31)) * 0.03
    y = 30.007 + F.pmod("s_suppkey", F.lit(29)) * 0.03
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.array(corner(0, 0), corner(0.06, 0), corner(0.06, 0.06), corner(0, 0.06))
    squares = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("polygon_id"), F.col("s_name").alias("name"), F.array(ring).alias("rings")
    )
    return serving.polygon_at(spots(spark, sf_dir).select("fire_id", "lon", "lat"), squares, "fire_id").select(
        "fire_id", "polygon_name"
    )


@query(
    f"""WITH {SPOTS} SELECT fire_id, '{{"scene_id":' || scene_id || ',"row":' || "row" || ',"col":' || col || ',"tier":"' || tier || '","user":' || CASE WHEN fire_id % 4 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END || '}}' AS detail FROM spots"""
)
def detail_payload(spark, sf_dir):
    """Every fire with its details as one JSON text."""
    from emberframe.sources import sinks

    s = spots(spark, sf_dir).withColumn("user", F.when(F.pmod("fire_id", F.lit(4)) != 0, F.col("user_id")))
    return sinks.with_detail(s, ["scene_id", "row", "col", "tier", "user"]).select("fire_id", "detail")
