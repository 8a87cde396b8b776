"""Spatial and spatio-temporal joins without nested loops: cells first, exact distances after."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.geo import EARTH_KM, haversine_km
from emberframe.operators.cover import cover, covered
from emberframe.operators.tables import kept


def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90) / step).cast("int")


def _columns(band: Column, step: float) -> Column:
    """Cells of a latitude band: as many as keep a cell at least ``step`` degrees of a great circle wide."""
    edge = F.least(F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90)), F.lit(90.0))
    return F.greatest(F.floor(360 * F.cos(F.radians(edge)) / step), F.lit(1)).cast("int")


def _place(lon: Column, count: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * count).cast("int"), count)


def _steps(km: float) -> tuple[float, float]:
    """(degrees of latitude that the distance reaches, height of a cell)."""
    away = math.degrees(km / EARTH_KM) * 1.0001 + 1e-9
    return away, max(2 * away, 1e-4)


def in_cells(points: DataFrame, km: float, lon: str = "r_lon", lat: str = "r_lat") -> DataFrame:
    """``points`` with the cell (_band, _cell) that holds them, for distances of ``km``; those without a place are left out."""
    _, step = _steps(km)
    p = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_band", _band(F.col(lat), step))
    return p.withColumn("_cell", _place(F.col(lon), _columns(F.col("_band"), step)))


def around_cells(
    points: DataFrame, km: float, lon: str = "lon", lat: str = "lat", keep_unplaced: bool = False
) -> DataFrame:
    """``points`` once for each cell (see ``in_cells``) within ``km``. Those without a place are left out, or kept once with a
    null cell."""
    away, step = _steps(km)
    # within the distance, longitudes differ by asin(sin(d) / cos(lat)) at most: near a pole the whole band is searched
    reach = math.sin(min(km / EARTH_KM, math.pi / 2))
    ratio = reach / F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-9))
    span = F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.0001 + 1e-9)
    spread = F.explode_outer if keep_unplaced else F.explode
    m = points if keep_unplaced else points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    bands = F.sequence(_band(F.col(lat) - away, step), _band(F.col(lat) + away, step))
    m = m.withColumn("_span", span).withColumn("_band", spread(bands))
    m = m.withColumn("_n", _columns(F.col("_band"), step))
    at = lambda x: F.floor((x + 180) / 360 * F.col("_n")).cast("int")
    m = m.withColumn("_first", at(F.col(lon) - F.col("_span"))).withColumn("_last", at(F.col(lon) + F.col("_span")))
    m = m.withColumn("_last", F.least("_last", F.col("_first") + F.col("_n") - 1))  # around the globe at most once
    m = m.withColumn("_cell", spread(F.sequence("_first", "_last"))).withColumn("_cell", F.pmod("_cell", "_n"))
    return m.drop("_span", "_n", "_first", "_last")


def distance_join(
    left: DataFrame, right: DataFrame, km: float, on: tuple[str, ...] = (), extra: Column | None = None,
    lon: str = "lon", lat: str = "lat", r_lon: str = "r_lon", r_lat: str = "r_lat"
) -> DataFrame:
    """``left`` x ``right`` where the points lie within ``km``, with distance_km; ``on`` are equal columns besides.

    Both sides are bucketed into latitude bands and cells of twice the distance, the right side in its cell, the left in
    those that the distance reaches (four on average), so it is an equi join with the distance as a residual, after any
    cheaper condition. Cells narrow with the latitude and wrap at the date line:
    no pair is lost anywhere. The right side's columns must have other names than the left's. A null coordinate joins
    nothing. ``extra`` is one more condition on both sides' columns.
    """
    r = in_cells(right, km, r_lon, r_lat)
    m = around_cells(left, km, lon, lat)
    d = haversine_km(lon, lat, r_lon, r_lat)
    keys = [*on, "_band", "_cell"]
    joined = m.join(r, keys) if extra is None else m.join(r, keys).filter(extra)
    return joined.withColumn("distance_km", d).filter(F.col("distance_km") <= km).drop("_band", "_cell")


def time_distance_join(
    left: DataFrame, right: DataFrame, km: float, hours: float, ts: str = "acq_ts", r_ts: str = "r_ts"
) -> DataFrame:
    """``distance_join`` of rows within ``hours`` of each other as well: times are bucketed by that width, and a left row
    looks at its own bucket and those beside it, so a place that burns for years never meets its whole history."""
    width = max(hours * 3.6e9, 1.0)
    slot = lambda c: F.floor(F.unix_micros(c) / width).cast("long")
    a = left.withColumn("_slot", F.explode(F.sequence(slot(ts) - 1, slot(ts) + 1)))
    close = F.abs(F.unix_micros(ts) - F.unix_micros(r_ts)) <= hours * 3.6e9
    return distance_join(a, right.withColumn("_slot", slot(r_ts)), km, on=("_slot",), extra=close).drop("_slot")


def nearest_reference(fires: DataFrame, references: DataFrame, km: float = 4.0, hours: float = 3.0) -> DataFrame:
    """Fires (fire_id, lon, lat, acq_ts, ...) each with its nearest official detection (id, sensor, lon, lat, acq_ts,
    confidence, frp) by distance, then time difference, then id; official_* are null where there is none."""
    r = references.select("id", "sensor", "lon", "lat", "acq_ts", "confidence", "frp").toDF(
        "r_id", "r_sensor", "r_lon", "r_lat", "r_ts", "r_confidence", "r_frp"
    )
    near = time_distance_join(fires.select("fire_id", "lon", "lat", "acq_ts"), r, km, hours)
    near = near.withColumn("dt", F.abs(F.unix_micros("r_ts") - F.unix_micros("acq_ts")) / 3.6e9)
    best = near.groupBy("fire_id").agg(
        F.min(F.struct("distance_km", "dt", "r_id", "r_sensor", "r_confidence", "r_frp")).alias("o")
    )
    out = fires.join(best, "fire_id", "left")
    return fused(out, fires.columns)


def fused(best: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and what the nearest detection ``o`` (null: none) says of a fire."""
    found = F.col("o").isNotNull()
    return best.select(
        *columns, found.alias("official_confirmed"),
        F.when(found, "official-confirmed").otherwise("self-detected-unconfirmed").alias("fusion_status"),
        F.when(found, "confirmed").otherwise("suspected").alias("fused_status"), F.col("o.r_id").alias("official_id"),
        F.col("o.r_sensor").alias("official_sensor"),
        F.round("o.distance_km", 3).alias("official_distance_km"),
        F.round(F.col("o.dt") * 60, 1).alias("official_minutes"), F.col("o.r_confidence").alias("official_confidence"),
        F.col("o.r_frp").alias("official_frp"),
    )


def official_ranges(references: DataFrame, fused: DataFrame) -> DataFrame:
    """Official detections with their footprint's size and whether a fire matched them."""
    matched = fused.filter("official_confirmed").select(
        F.col("official_id").alias("id")
    ).distinct().withColumn("matched", F.lit(True))
    size = lambda c: F.greatest(F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(0.375)), F.lit(0.1))
    out = references.join(matched, "id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    return out.withColumns(
        {
            "width_km": size("scan_km"), "height_km": size("track_km"),
            "fusion_status": F.when(F.col("matched"), "official-confirmed").otherwise("official-only")
        }
    )


def near_sources(points: DataFrame, sources: DataFrame, key: str, default_km: float = 4.0) -> DataFrame:
    """(key): the points within the radius of a static source (lon, lat, radius_km; a radius not above 0 is the default).

    Sources are joined by classes of radius, each twice as wide as the one before, so a wide source does not widen the
    cells of the others. There are as many classes as the radii have magnitudes."""
    radius = F.when(F.col("radius_km") > 0, F.col("radius_km")).otherwise(default_km).cast("double")
    s = sources.select(
        F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), radius.alias("r_km")
    ).withColumn("_class", F.ceil(F.log2("r_km")).cast("int"))
    classes = [r["_class"] for r in s.select("_class").distinct().orderBy("_class").collect()]
    p, found = points.select(key, "lon", "lat"), points.select(key).limit(0)
    for c in classes:
        hits = distance_join(
            p, s.filter(F.col("_class") == c).drop("_class"), 2.0**c
        ).filter("distance_km <= r_km").select(key)
        found = hits if c == classes[0] else found.unionByName(hits)
    return found.distinct()


def without_sources(points: DataFrame, sources: DataFrame, key: str, default_km: float = 4.0) -> DataFrame:
    """``points`` that no static source covers."""
    return points.join(near_sources(points, sources, key, default_km), key, "left_anti")


def within_polygons(points: DataFrame, polygons: DataFrame, key: str, cell: float | None = None) -> DataFrame:
    """(key, polygon_id): points in polygons (polygon_id, rings), by the even-odd rule: in the first ring and in none of the
    others. Polygons are cut into quadtree cells, and points are looked up in theirs: in cells inside a polygon no edge is
    tested, in those on its boundary the edges of the cell's row. ``cell`` bounds the width of boundary cells in degrees.
    Rows that repeat a polygon_id are polygons of their own."""
    numbered = kept(polygons.filter(F.size("rings") > 0).select(
        "polygon_id", "rings", F.monotonically_increasing_id().alias("polygon")
    ), "polygons")
    hit = covered(points, kept(cover(numbered, cell), "cover"), key)
    return hit.join(numbered.select("polygon", "polygon_id"), "polygon").select(key, "polygon_id")


def top_polygon(points: DataFrame, polygons: DataFrame, order: str = "polygon_id") -> DataFrame:
    """(lon, lat, name) of the distinct places of ``points`` in polygons (polygon_id, name, rings): of several polygons, the
    first by ``order``, then polygon_id.

    Of polygons with the same rings only the first is cut into cells, and of the polygons of a cell only those that come
    before the first one that holds all of it stay, so a place does not meet all that lies below the one on top."""
    first = polygons.filter(F.size("rings") > 0).groupBy("rings").agg(
        F.min(F.struct(F.col(order).alias("order"), "polygon_id", "name")).alias("first")
    )
    # numbers rise with the order
    numbered = kept(first.orderBy("first").select(
        "rings", "first.name", F.monotonically_increasing_id().alias("polygon")
    ), "polygons")
    cells = kept(cover(numbered), "cover")
    whole = cells.filter("interior").groupBy("level", "x", "y").agg(F.min("polygon").alias("_whole"))
    cells = cells.join(whole, ["level", "x", "y"], "left").filter("_whole is null or polygon <= _whole").drop("_whole")
    places = points.select("lon", "lat").distinct().withColumn("_at", F.struct("lon", "lat"))
    top = covered(places, cells, "_at").groupBy("_at").agg(F.min("polygon").alias("polygon"))
    return top.join(numbered.select("polygon", "name"), "polygon").select("_at.*", "name")


def clip(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """``points`` with accepted: whether any polygon holds the point. Without polygons every point is accepted."""
    if not polygons.limit(1).count():
        return points.withColumn("accepted", F.lit(True))
    inside = within_polygons(points, polygons, key).select(key).distinct().withColumn("accepted", F.lit(True))
    return points.join(inside, key, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def rejected_sample(clipped: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return clipped.filter(~F.col("accepted")).orderBy(*order).limit(n)


#: References in a cell of the first ring, on average over the references.
IN_A_CELL = 32


def _first_ring(r: DataFrame, km: float) -> float:
    """The distance, ``km`` at most, at which a reference's cell holds about ``IN_A_CELL`` of them."""
    for _ in range(12):
        n = in_cells(r, km).groupBy("_band", "_cell").agg(F.count("*").cast("double").alias("n"))
        held = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if held <= 2 * IN_A_CELL or km <= 0.005:
            break
        km = max(km * max(math.sqrt(IN_A_CELL / held), 1 / 1024), 0.005)
    return km


def nearest_distance(points: DataFrame, references: DataFrame, key: str, start_km: float = 50.0) -> DataFrame:
    """(key, distance_km) to the nearest reference at any distance, by rings that grow until every point has one.

    Each distinct place is looked up once. The first ring is ``start_km`` or, where references lie close, so narrow that a
    place meets some tens of them, however many there are. Each ring's result is written, so no ring is computed again. Points
    without a reference within some hundred kilometres are few or far from all: they go through cells instead
    (``_far_distance``), for a wider ring would meet all references.
    """
    r = kept(references.select(F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat")).dropna().distinct(), "places")
    every = points.select(key, "lon", "lat")
    if not r.limit(1).count():
        return every.select(key, F.lit(None).cast("double").alias("distance_km"))
    at = ["lon", "lat"]
    done, left, km = None, kept(every.select(*at).dropna().distinct(), "open"), _first_ring(r, start_km)
    while left.limit(1).count():
        if km > 600:
            far = _far_distance(left.withColumn("_at", F.struct(*at)), r, "_at").select("_at.*", "distance_km")
            done = far if done is None else done.unionByName(far)
            break
        found = kept(distance_join(left, r, km).groupBy(*at).agg(F.min("distance_km").alias("distance_km")), "ring")
        done = found if done is None else done.unionByName(found)
        left = kept(left.join(found.select(*at), at, "left_anti"), "open")
        km *= 4
    if done is None:
        return every.select(key, F.lit(None).cast("double").alias("distance_km"))
    return every.join(done, at, "left").select(key, "distance_km")


def _far_distance(points: DataFrame, r: DataFrame, key: str) -> DataFrame:
    """The distance to the nearest reference, by cells of 15 degrees, then of one. A cell's centre and the greatest distance
    of its references from it bound from both sides how far the nearest of them is, so a point meets the cells that can
    hold its nearest reference, and of the references only theirs. There are 288 wide cells at most; they come as one row."""
    wide, cell = (lambda c: F.floor(F.col(c) / 15).cast("int")), (lambda c: F.floor(c).cast("int"))
    r = r.withColumns({"_x": cell("r_lon"), "_y": cell("r_lat")})
    spread = lambda x, y: F.max(haversine_km(F.col("r_lon"), F.col("r_lat"), x, y)).alias("spread")
    fine = r.groupBy("_x", "_y").agg(
        spread(F.col("_x") + 0.5, F.col("_y") + 0.5)
    ).withColumns({"_wx": wide("_x"), "_wy": wide("_y")})
    coarse = r.withColumns({"_wx": wide("_x"), "_wy": wide("_y")}).groupBy("_wx", "_wy").agg(
        spread((F.col("_wx") + 0.5) * 15, (F.col("_wy") + 0.5) * 15)
    )
    one = coarse.agg(F.collect_list(F.struct("_wx", "_wy", "spread")).alias("_cells"))
    away = lambda c: haversine_km(
        F.col("lon"), F.col("lat"), (c["_wx"] + 0.5) * 15, (c["_wy"] + 0.5) * 15
    )
    p = points.crossJoin(F.broadcast(one)).withColumn(
        "_most", F.array_min(F.transform("_cells", lambda c: away(c) + c["spread"])) + 1e-6
    )
    p = p.withColumn(
        "_c", F.explode(F.filter("_cells", lambda c: away(c) - c["spread"] <= F.col("_most")))
    ).select(key, "lon", "lat", "_most", "_c._wx", "_c._wy")
    p = p.join(fine, ["_wx", "_wy"]).withColumn(
        "_away", haversine_km(F.col("lon"), F.col("lat"), F.col("_x") + 0.5, F.col("_y") + 0.5)
    )
    p = p.filter(F.col("_away") - F.col("spread") <= F.col("_most"))
    best = p.groupBy(key).agg(F.min(F.col("_away") + F.col("spread")).alias("_near"))
    p = p.join(best, key).filter(F.col("_away") - F.col("spread") <= F.col("_near") + 1e-6)
    near = p.select(key, "lon", "lat", "_x", "_y").join(r, ["_x", "_y"])
    return near.groupBy(key).agg(F.min(haversine_km("lon", "lat", "r_lon", "r_lat")).alias("distance_km"))


def in_time_reach(references: DataFrame, candidates: DataFrame, hours: float) -> DataFrame:
    """References with a candidate within ``hours``: distinct times of both by hour, searched in the hours around."""
    width = max(hours, 1e-6) * 3600
    slot = lambda ts: F.floor(F.unix_micros(ts) / 1e6 / width).cast("long")
    times = candidates.select(F.col("acq_ts").alias("c_ts")).distinct().withColumn("_slot", slot(F.col("c_ts")))
    probe = references.select("acq_ts").distinct().withColumn(
        "_slot", F.explode(F.sequence(slot(F.col("acq_ts")) - 1, slot(F.col("acq_ts")) + 1))
    )
    near = F.abs(F.unix_micros("acq_ts") - F.unix_micros("c_ts")) <= F.lit(hours * 3.6e9)
    hit = probe.join(times, "_slot").filter(near).select("acq_ts").distinct()
    return references.join(hit, "acq_ts", "left_semi")


def rasterize(pixels: DataFrame, polygons: DataFrame, keys: tuple[str, ...] = ("scene_id", "row", "col")) -> DataFrame:
    """``pixels`` with a boolean ``masked``: the pixel's centre lies in a polygon."""
    point = pixels.withColumn("_key", F.struct(*keys)).select("_key", "lon", "lat")
    inside = within_polygons(
        point, polygons, "_key"
    ).select("_key").distinct().select("_key.*").withColumn("masked", F.lit(True))
    return pixels.join(inside, list(keys), "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
