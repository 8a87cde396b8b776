"""What a map needs from the tables: sizes, forecast frames, values at a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.geo import _col, haversine_km, in_box

# Symbol sizes by score, linear between these stops.
STOPS = [(0.5, 7.0), (2.0, 10.0), (4.0, 14.0)]


def symbol_size(score, stops: list[tuple[float, float]] = STOPS) -> Column:
    """Size of a fire's symbol: linear between the stops, the outer sizes beyond them."""
    score = _col(score)
    size = F.when(score <= stops[0][0], stops[0][1])
    for (a, x), (b, y) in zip(stops, stops[1:]):
        size = size.when(score <= b, x + (score - a) / (b - a) * (y - x))
    return size.when(score.isNotNull(), stops[-1][1])


def frame_time(now: Column, forecast_hour, start: Column, end: Column) -> Column:
    """Seconds of the frame to show: so many hours ahead, within the frames that there are."""
    target = F.unix_timestamp(now) + F.greatest(_col(forecast_hour), F.lit(0)) * 3600
    return F.least(F.coalesce(end, target), F.greatest(F.coalesce(start, target), target)).cast("long")


def next_forecast_hour(hour, step: int = 3, last: int = 72) -> Column:
    """The next frame of a loop; after the last one it begins anew."""
    hour = F.coalesce(_col(hour), F.lit(0))
    return F.when(hour >= last, 0).otherwise(hour + step)


def in_extent(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside a map's extent (min lon, min lat, max lon, max lat)."""
    return rows.filter(in_box("lon", "lat", *box))


def value_at(points: DataFrame, grid: DataFrame, step_lon: float, step_lat: float, key: str = "key") -> DataFrame:
    """Points with the values of the grid point (lon, lat, ...) nearest to them, of those in the cells around. An equi join
    on cells of the grid's own steps."""
    at = lambda c, s: F.floor(_col(c) / s).cast("int")
    around = F.explode(
        F.array(
            *[
                F.struct(
                    (at("lon", step_lon) + x).alias("_x"), (at("lat", step_lat) + y).alias("_y")
                ) for x in (-1, 0, 1) for y in (-1, 0, 1)
            ]
        )
    )
    g = grid.select(*[F.col(c).alias(f"grid_{c}") for c in grid.columns]).withColumns(
        {"_x": at("grid_lon", step_lon), "_y": at("grid_lat", step_lat)}
    )
    near = points.withColumn("_c", around).select("*", "_c.*").drop("_c").join(g, ["_x", "_y"]).drop("_x", "_y")
    w = Window.partitionBy(key).orderBy(haversine_km("lon", "lat", "grid_lon", "grid_lat"), "grid_lon", "grid_lat")
    best = near.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return points.join(best.select(key, *[c for c in best.columns if c.startswith("grid_")]), key, "left")


def polygon_at(points: DataFrame, polygons: DataFrame, key: str = "key", order: str = "polygon_id") -> DataFrame:
    """``points`` with the name of the polygon (polygon_id, name, rings) under each, null where there is none; of several, the
    first by ``order``."""
    from emberframe.operators.spatial import top_polygon

    top = top_polygon(points, polygons, order).withColumnRenamed("name", "polygon_name")
    return points.join(top, ["lon", "lat"], "left").select(*points.columns, "polygon_name")


def merged_config(template: dict, private: dict, parts: tuple[str, ...] = ("variables", "ftp")) -> dict:
    """``template`` with its parts overlaid by those of ``private``."""
    return template | {p: (template.get(p) or {}) | (private.get(p) or {}) for p in parts}
