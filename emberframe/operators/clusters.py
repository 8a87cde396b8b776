"""Clusters of fires, of official detections and of persistent heat, and their footprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.geo import EARTH_KM, axis_step, haversine_km, pixel_ring, ring_area_km2
from emberframe.operators.graphs import connected_components
from emberframe.operators.spatial import distance_join
from emberframe.operators.tables import kept


def footprints(fires: DataFrame, pixels: DataFrame, key: str = "fire_id") -> DataFrame:
    """``fires`` with ring and area_km2 from the four neighbouring pixels' centres (``pixels`` must be on the same grid)."""
    near = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("side"), (F.col("row") + r).alias("_r"), (F.col("col") + c).alias("_c")) for n,
                r, c in (("up", -1, 0), ("down", 1, 0), ("left", 0, -1), ("right", 0, 1))
            ]
        )
    )
    grid = pixels.select(
        "scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), F.struct("lon", "lat").alias("at")
    )
    sides = fires.select("scene_id", key, "row", "col").withColumn("_n", near).select("scene_id", key, "_n.*").join(
        grid, ["scene_id", "_r", "_c"]
    )
    side = lambda n: F.first(F.when(F.col("side") == n, F.col("at")), ignorenulls=True).alias(n)
    found = fires.join(sides.groupBy(key).agg(*[side(n) for n in ("up", "down", "left", "right")]), key, "left")
    step = lambda c, a, b: axis_step(F.col(f"{a}.{c}"), F.col(c), F.col(f"{b}.{c}"))
    ring = pixel_ring(
        F.col("lon"), F.col("lat"), step("lon", "up", "down"), step("lon", "left", "right"), step("lat", "up", "down"),
        step("lat", "left", "right")
    )
    found = found.withColumn("ring", ring).withColumn("area_km2", F.round(ring_area_km2(F.col("ring")), 4))
    return found.drop("up", "down", "left", "right")


def adjacent(fires: DataFrame, key: str = "fire_id") -> DataFrame:
    """(a, b): fires of one scene on neighbouring pixels, diagonals included."""
    offsets = F.array(
        *[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))]
    )
    a = fires.select(
        "scene_id", F.col(key).alias("a"), F.col("row").alias("_r"), F.col("col").alias("_c"),
        F.explode(offsets).alias("o")
    )
    a = a.select(
        "scene_id", "a", (F.col("_r") + F.col("o.dr")).alias("row"), (F.col("_c") + F.col("o.dc")).alias("col")
    )
    return a.join(
        fires.select("scene_id", "row", "col", F.col(key).alias("b")), ["scene_id", "row", "col"]
    ).select("a", "b")


def fire_clusters(fires: DataFrame, least: int = 2, key: str = "fire_id") -> DataFrame:
    """Areas of ``least`` or more connected fires: score-weighted centre, counts, extremes, whether any is confirmed. A
    cluster is named by its scene and the least (row, col) of its pixels. Optional columns area_km2, model_prob,
    official_confirmed and ring are used where they are."""
    label = connected_components(
        fires.select(F.col(key).alias("id")), adjacent(fires, key)
    ).withColumnRenamed("id", key)
    w = F.greatest(F.col("score"), F.lit(0.0)) + 1
    have = lambda c, agg: [agg] if c in fires.columns else []
    return fires.join(label, key).groupBy("scene_id", "component").agg(
        F.min(F.struct("row", "col")).alias("first"), F.count("*").alias("pixel_count"),
        F.round(F.sum(F.col("lon") * w) / F.sum(w), 6).alias("centroid_lon"),
        F.round(F.sum(F.col("lat") * w) / F.sum(w), 6).alias("centroid_lat"),
        F.max("score").alias("max_score"), F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.max("bt_tir"), 2).alias("max_bt_tir"), F.round(F.max("bt_dif"), 2).alias("max_bt_dif"),
        *have("area_km2", F.round(F.sum("area_km2"), 4).alias("area_km2")),
        *have("model_prob", F.round(F.max("model_prob"), 6).alias("max_model_prob")),
        *have("model_prob", F.round(F.avg("model_prob"), 6).alias("mean_model_prob")),
        *have(
            "official_confirmed", F.bool_or(F.coalesce("official_confirmed", F.lit(False))).alias("official_confirmed")
        ),
        *have("ring", F.collect_list("ring").alias("rings")),
    ).filter(F.col("pixel_count") >= least).select(
        F.concat_ws("-", "scene_id", "first.row", "first.col").alias("cluster_id"), "*",
        *(
            [F.when(F.col("official_confirmed"), "confirmed").otherwise("suspected").alias("cluster_status")]
            if "official_confirmed" in fires.columns else []
        ),
    ).drop("first", "component")


def _own_cell(km: float) -> Column:
    """A cell whose diagonal is below ``km``, at any latitude: any two points of it are that near."""
    if km > 600:  # the sphere's curvature counts: points of one place only
        return F.struct("lon", "lat")
    step = math.degrees(km / EARTH_KM) / math.sqrt(2) * 0.999
    band = F.floor((F.col("lat") + 90) / step)
    low, high = band * step - 90, (band + 1) * step - 90
    nearest = F.when(low * high <= 0, 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
    columns = F.ceil(360 * F.cos(F.radians(nearest)) / step)
    return F.struct(band.alias("band"), F.floor((F.col("lon") + 180) / 360 * columns).alias("column"))


def _linked_cells(
    points: DataFrame, km: float, minutes: float | None, by: tuple[str, ...]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, rep, component) of the points that have a cell, links (a, b) of cells by their least ids that make these
    components, and links of components; see ``chain_edges``.

    First the cells' first points are compared, a number that stops growing where points lie close, and make components.
    Then cells of different components that are near enough for a link compare all of their distinct places."""
    timed = minutes is not None
    width = max((minutes or 0) * 6e7, 1.0)
    slot = F.floor(F.unix_micros("acq_ts") / width).cast("long") if timed else F.lit(0).cast("long")
    at = F.unix_micros("acq_ts") if timed else F.lit(0).cast("long")
    same = [f"_by_{c}" for c in by]
    p = points.select(
        "id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), at.alias("at"),
        slot.alias("_slot"), *[F.col(c).alias(f"_by_{c}") for c in by]
    ).dropna(subset=["lon", "lat", "at", *same])
    p = p.withColumn("cell", F.struct(_own_cell(km).alias("place"), "_slot", *same))
    # one of the cell's points: which one does not matter
    cells = kept(p.groupBy("cell").agg(
        F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("lon", "lat", "at", "_slot", *same)]
    ), "cells")
    # near in time are points of the same slot or of the next, so each looks at its own and forward
    ahead = F.array(*[F.col("_slot") + k for k in ((0, 1) if timed else (0,))])
    once = (F.col("_slot") > F.col("_own")) | (F.col("rep") < F.col("r_rep"))
    near = F.abs(F.col("at") - F.col("r_at")) <= width

    def met(d: DataFrame, reach: float, extra: Column) -> DataFrame:
        other = d.select(*[F.col(c).alias(c if c in ("_slot", *same) else f"r_{c}") for c in d.columns])
        left = d.withColumn("_own", F.col("_slot")).withColumn("_slot", F.explode(ahead))
        # both sides grow with the points: never broadcast
        return distance_join(left, other.hint("merge"), reach, on=("_slot", *same), extra=once & extra)

    links = kept(
        met(cells.drop("cell"), km, near).select(F.col("rep").alias("a"), F.col("r_rep").alias("b")), "links"
    )
    label = connected_components(cells.select(F.col("rep").alias("id")), links)
    cells = kept(cells.join(label, F.col("rep") == F.col("id")).drop("id"), "labelled")
    named = kept(p.join(cells.select("cell", "rep", "component"), "cell").drop("cell"), "named")
    # a point is within km of its cell's first point
    open_ = kept(met(cells.drop("cell"), 3.001 * km, F.col("component") != F.col("r_component")).select(
        "rep", "component", "r_rep", "r_component", "r_lon", "r_lat"
    ), "open-cells")
    places = named.select("rep", "lon", "lat", "at").distinct()
    left = open_.join(places, "rep").filter(haversine_km("lon", "lat", "r_lon", "r_lat") <= 2.001 * km)
    right = places.select(
        F.col("rep").alias("r_rep"), F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), F.col("at").alias("r_at")
    )
    pairs = left.join(right, "r_rep").filter(near).filter(haversine_km("lon", "lat", "q_lon", "q_lat") <= km)
    pairs = pairs.select(F.col("component").alias("a"), F.col("r_component").alias("b")).distinct()
    more = kept(pairs if open_.limit(1).count() else links.limit(0), "more-links")
    return named.select("id", "rep", "component"), links, more


def chain_edges(points: DataFrame, km: float, minutes: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b): links whose components are those of all pairs of points (id, lon, lat, acq_ts) within ``km`` and, unless it is
    None, ``minutes``; with equal values of the columns ``by``, if there are any.

    Cells of space and time whose points are all linked with each other link each with the cell's least id. Only places of
    different cells are compared, each distinct place and time once, and give a link between the cells, so a flare that is
    seen for years at one place, or by many passes at once, does not meet itself; and only where the cells are not yet linked
    by their first points. Points without a place (or time, or a value of ``by``) have no links."""
    named, links, more = _linked_cells(points, km, minutes, by)
    return named.select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b").unionByName(links).unionByName(more)


def chain_components(
    points: DataFrame, km: float, minutes: float | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """(id, component) of the distinct ids of ``points``: the components of ``chain_edges``. The cells are the graph's nodes, not the
    points, so where points lie close the graph does not grow with them. Points without a cell are their own component."""
    named, _, more = _linked_cells(points, km, minutes, by)
    per = kept(named.groupBy("id").agg(F.min("component").alias("first"), F.max("component").alias("last")), "reps")
    # an id that comes at several places links their components
    several = per.filter("first <> last").select("id", F.col("first").alias("a"))
    again = named.join(several, "id").select("a", F.col("component").alias("b")).filter("a <> b").distinct()
    more = kept(more.unionByName(again), "more-links")
    label = per.select("id", F.col("first").alias("component"))
    if more.limit(1).count():
        ends = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id")))
        top = connected_components(ends, more).select(F.col("id").alias("first"), F.col("component").alias("top"))
        label = per.join(top, "first", "left").select("id", F.coalesce("top", "first").alias("component"))
    return points.select("id").distinct().join(label, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def reference_clusters(references: DataFrame, km: float = 2.5, minutes: float = 30.0, order: str = "id") -> DataFrame:
    """Detections (id, sensor, lon, lat, acq_ts, frp) that chain together, weighted by radiative power: place, time, sum,
    sensors and members."""
    label = chain_components(references, km, minutes)
    w = F.greatest(F.coalesce("frp", F.lit(0.0)), F.lit(0.0)) + 1
    return references.join(label, "id").groupBy("component").agg(
        F.array_join(F.sort_array(F.collect_set("sensor")), "+").alias("sensor"),
        (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"),
        F.timestamp_micros((F.sum(F.unix_micros("acq_ts") * w) / F.sum(w)).cast("long")).alias("acq_ts"),
        F.sum(F.coalesce("frp", F.lit(0.0))).alias("frp"), F.count("*").alias("member_count"),
        F.sort_array(F.collect_list(order)).alias("member_ids"),
    ).withColumnRenamed("component", "id")


def persistent_sources(points: DataFrame, km: float = 1.5, days: int = 4, hits: int = 4) -> DataFrame:
    """Places (points: id, lon, lat, acq_date, frp, daynight) seen at least ``hits`` times on ``days`` different days."""
    label = chain_components(points, km)
    frp = F.coalesce("frp", F.lit(0.0))
    w = F.greatest(frp, F.lit(0.0)) + 1
    night = F.upper(F.coalesce("daynight", F.lit("")))
    found = points.join(label, "id").groupBy("component").agg(
        F.round(F.sum(F.col("lon") * w) / F.sum(w), 6).alias("lon"),
        F.round(F.sum(F.col("lat") * w) / F.sum(w), 6).alias("lat"), F.count("*").alias("detection_count"),
        F.count_distinct("acq_date").alias("day_count"),
        F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"),
        F.round(F.avg(frp), 3).alias("mean_frp"), F.round(F.max(frp), 3).alias("max_frp"),
        F.count_if(night == "D").alias("by_day"), F.count_if(night == "N").alias("by_night"),
    )
    return found.filter(
        (F.col("detection_count") >= hits) & (F.col("day_count") >= days)
    ).withColumn("radius_km", F.lit(round(km, 3))).drop("component").orderBy(
        F.desc("day_count"), F.desc("detection_count"), "lon", "lat"
    )
