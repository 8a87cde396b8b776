"""Weather grids, units and the fire-risk index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.geo import _col


def clamp(x, low: float, high: float) -> Column:
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def grid_bounds(grid: dict | None = None, lat: float = 39.9, lon: float = 116.39) -> dict[str, float]:
    """Bounds and steps of a weather grid: given numbers, else 8 degrees around the place by steps of 2; swapped bounds are
    put in order, steps are a quarter at least."""
    grid = grid or {}

    def number(key: str, default: float) -> float:
        try:
            v = float(grid[key])
        except (KeyError, TypeError, ValueError):
            return default
        return v if v == v and abs(v) != float("inf") else default

    a, b = (min(max(number(k, d), -90.0), 90.0) for k, d in (("minLat", lat - 8), ("maxLat", lat + 8)))
    c, d = (min(max(number(k, d), -180.0), 180.0) for k, d in (("minLon", lon - 8), ("maxLon", lon + 8)))
    return {
        "min_lat": min(a, b), "max_lat": max(a, b), "min_lon": min(c, d), "max_lon": max(c, d),
        "step_lat": max(number("stepLat", 2.0), 0.25), "step_lon": max(number("stepLon", 2.0), 0.25)
    }


def grid_points(spark: SparkSession, g: dict[str, float]) -> DataFrame:
    """(lat, lon) of every grid point, both ends included, made by the executors."""
    n = [int((g[f"max_{k}"] - g[f"min_{k}"] + 1e-4) // g[f"step_{k}"]) + 1 for k in ("lat", "lon")]
    k = spark.range(n[0] * n[1])
    return k.select(
        F.round(g["min_lat"] + F.floor(F.col("id") / n[1]) * g["step_lat"], 4).alias("lat"),
        F.round(g["min_lon"] + F.pmod("id", F.lit(n[1])) * g["step_lon"], 4).alias("lon")
    )


def grids_of(boxes: DataFrame, key: str, lat: float = 39.9, lon: float = 116.39) -> DataFrame:
    """(key, lat, lon) of every grid point of every row of ``boxes`` (key, min_lat, max_lat, min_lon, max_lon, step_lat, step_lon:
    doubles), by the rules of ``grid_bounds``: a bound or step that is null or not finite has its default."""
    given = lambda c, default: F.when(
        F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)
    ).otherwise(F.lit(float(default)))
    inside = lambda x, most: F.least(F.greatest(x, F.lit(-most)), F.lit(most))
    ends = {
        n: [inside(given(f"{side}_{n}", at + d), most) for side, d in (("min", -8), ("max", 8))]
        for n, at, most in (("lat", lat, 90.0), ("lon", lon, 180.0))
    }

    def axis(n: str) -> Column:
        (a, b), step = ends[n], F.greatest(given(f"step_{n}", 2.0), F.lit(0.25))
        low, high = F.least(a, b), F.greatest(a, b)
        places = F.sequence(F.lit(0).cast("long"), F.floor((high - low + 1e-4) / step))
        return F.transform(places, lambda k: F.round(low + k * step, 4))

    rows = boxes.select(key, axis("lat").alias("_lat"), axis("lon").alias("_lon"))
    return rows.withColumn("lat", F.explode("_lat")).withColumn("lon", F.explode("_lon")).select(key, "lat", "lon")


def celsius(value, unit) -> Column:
    value = _col(value)
    return F.when(F.lower(F.coalesce(_col(unit), F.lit(""))).contains("k"), value - 273.15).otherwise(value)


def hectopascal(value, unit) -> Column:
    value, unit = _col(value), F.lower(F.coalesce(_col(unit), F.lit("")))
    return F.when((unit == "pa") | unit.endswith("*pa"), value / 100).when(unit == "kpa", value * 10).otherwise(value)


def millimetres(value, unit) -> Column:
    value = _col(value)
    return F.when(F.lower(F.coalesce(_col(unit), F.lit(""))) == "m", value * 1000).otherwise(value)


def wind_speed(u, v) -> Column:
    return F.round(F.hypot(_col(u), _col(v)), 1)


def fire_risk(humidity, celsius_, wind, rain=None, convective_rain=None, cape=None) -> Column:
    """0 to 100; each missing part has a default of its own."""
    zero = F.lit(0.0)
    dry = F.coalesce(clamp((100 - _col(humidity)) / 100, 0, 1), F.lit(0.4))
    heat = F.coalesce(clamp((_col(celsius_) - 18) / 20, 0, 1), F.lit(0.3))
    air = F.coalesce(clamp(_col(wind) / 18, 0, 1), F.lit(0.25))
    lift = zero if cape is None else F.coalesce(clamp(_col(cape) / 2500, 0, 1) * 0.2, zero)
    rain_ = (zero if rain is None else F.coalesce(_col(rain), zero)) + (
        zero if convective_rain is None else F.coalesce(_col(convective_rain), zero)
    )
    risk = clamp(0.38 * dry + 0.32 * heat + 0.22 * air + lift - 0.35 * clamp(rain_ / 6, 0, 1), 0, 1)
    return F.floor(risk * 100 + 0.5).cast("int")


def forecast_index(times: Column, target: Column) -> Column:
    """0-based place of the first valid time at or after ``target``, else of the last valid one, else -1."""
    places = F.sequence(F.lit(0), F.greatest(F.size(times) - 1, F.lit(0)))
    valid = F.filter(places, lambda i: F.get(times, i).isNotNull())
    return F.when(F.size(times) <= 0, -1).otherwise(
        F.coalesce(
            F.get(F.filter(valid, lambda i: F.get(times, i) >= target), F.lit(0)),
            F.element_at(F.when(F.size(valid) > 0, valid), -1), F.lit(-1)
        )
    )


def forecast_cells(points: DataFrame, target_ms: Column, step_lon: float, step_lat: float) -> DataFrame:
    """(lat, lon, ring, forecast_ts, and the values) of weather points at the forecast time for ``target_ms``, as cells of
    their grid. Points without a valid time are left out."""
    from emberframe.functions.geo import cell_ring

    # the array of one keeps the index above what it is made of, so that no use of it computes it again
    p = points.withColumn("_at", F.explode(F.array(forecast_index(F.col("ts"), target_ms)))).filter("_at >= 0")
    values = _values_at(F.col("_at"), F.col("series"), F.col("units"))
    at = F.timestamp_millis(F.get("ts", F.col("_at")))
    # columns of their own: those that nobody asks for are not computed
    return p.select(
        "lat", "lon", cell_ring("lon", "lat", step_lon, step_lat).alias("ring"), at.alias("forecast_ts"),
        *[c.alias(k) for k, c in values.items()]
    )


def forecast_values(times: Column, series: Column, units: Column, target: Column) -> Column:
    """struct of the converted and rounded weather at the forecast time. ``series`` maps a variable to its values,
    ``units`` to its unit."""
    return F.struct(*[c.alias(k) for k, c in _values_at(forecast_index(times, target), series, units).items()])


def _values_at(at: Column, series: Column, units: Column) -> dict[str, Column]:
    raw = lambda name: F.when(at >= 0, F.get(series[f"{name}-surface"], at))
    unit = lambda name: units[f"{name}-surface"]
    u, v = F.round(raw("wind_u"), 2), F.round(raw("wind_v"), 2)
    out = {
        "temp_c": F.round(celsius(raw("temp"), unit("temp")), 1),
        "dewpoint_c": F.round(celsius(raw("dewpoint"), unit("dewpoint")), 1), "rh_pct": F.round(raw("rh"), 1),
        "pressure_hpa": F.round(hectopascal(raw("pressure"), unit("pressure")), 1), "wind_ms": wind_speed(u, v),
        "u_ms": u, "v_ms": v, "gust_ms": F.round(raw("gust"), 1),
        "precip_3h_mm": F.round(millimetres(raw("past3hprecip"), unit("past3hprecip")), 2),
        "conv_precip_3h_mm": F.round(millimetres(raw("past3hconvprecip"), unit("past3hconvprecip")), 2),
        "cape_jkg": F.round(raw("cape"), 1), "lcloud_pct": F.round(raw("lclouds"), 1),
        "mcloud_pct": F.round(raw("mclouds"), 1), "hcloud_pct": F.round(raw("hclouds"), 1),
    }
    risk = fire_risk(
        out["rh_pct"], out["temp_c"], out["wind_ms"], out["precip_3h_mm"], out["conv_precip_3h_mm"], out["cape_jkg"]
    )
    return out | {"fire_risk": risk}
