"""Candidate features for a classifier, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.geo import _col, great_circle_km

# Longitude below the satellite, and boxes (min lon, max lon, min lat, max lat) of cities with industry.
SATELLITE_LON = 140.7
URBAN_BOXES = [
    (114.0, 120.5, 36.0, 41.5), (118.0, 122.5, 29.5, 33.0), (112.5, 115.5, 22.0, 24.5), (103.5, 107.5, 28.5, 32.0),
    (112.0, 115.0, 27.5, 31.0)
]
# Boxes of deserts; their bounds do not belong to them.
DESERT_BOXES = [(76.8, 88.5, 36.0, 42.5), (99.0, 105.0, 37.0, 42.0)]
TURN = 6.283185307179586


def urban(lon, lat) -> Column:
    lon, lat = _col(lon), _col(lat)
    tests = [lon.between(a, b) & lat.between(c, d) for a, b, c, d in URBAN_BOXES]
    return F.coalesce(tests[0] | tests[1] | tests[2] | tests[3] | tests[4], F.lit(False))


def desert(lon, lat) -> Column:
    lon, lat = _col(lon), _col(lat)
    tests = [(lon > a) & (lon < b) & (lat > c) & (lat < d) for a, b, c, d in DESERT_BOXES]
    return F.coalesce(tests[0] | tests[1], F.lit(False))


def region(lon) -> Column:
    lon = _col(lon)
    return F.when(lon < 105, "west").when(lon < 115, "central").otherwise("east")


def solar_hour(ts: Column, lon) -> Column:
    return F.pmod(F.hour(ts) + F.minute(ts) / 60 + _col(lon) / 15, F.lit(24.0))


def day_phase(code, ts: Column, lon) -> Column:
    """day, twilight or night: by its code, else by the local solar hour; without a time, night."""
    c, h = F.upper(F.trim(F.coalesce(_col(code), F.lit("")))), solar_hour(ts, lon)
    by_hour = F.when((h >= 6) & (h < 18), "day").when(
        ((h >= 5) & (h < 6)) | ((h >= 18) & (h < 19)), "twilight"
    ).otherwise("night")
    return F.when(c.isin("N", "NIGHT"), "night").when(c.isin("D", "DAY"), "day").when(
        c.isin("T", "TWILIGHT"), "twilight"
    ).otherwise(by_hour)


def slot_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def slot_ordinal(slot) -> Column:
    """Number of the 10-minute slot since 2000, from yyyyMMddHHmm; -1 where that is no time."""
    ts = F.try_to_timestamp(_col(slot), F.lit("yyyyMMddHHmm"))
    return F.coalesce(F.floor((F.unix_timestamp(ts) - 946684800) / 600).cast("int"), F.lit(-1))


def candidate_frame(fires: DataFrame) -> DataFrame:
    """Fires (lon, lat, acq_ts, bt_tir, bt_dif, score, and optionally area_pixels, daynight, scene_id, fire_id) as one row
    per candidate. Missing numbers become 0, a missing area 1; the area is 1 at least."""
    have = lambda name, default: F.col(name) if name in fires.columns else default
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    lon, lat, ts = zero(F.col("lon")), zero(F.col("lat")), F.col("acq_ts")
    scene = have("scene_id", F.lit(None)).cast("string")
    area = have("area_pixels", F.lit(1.0))
    return fires.select(
        "*",
        F.coalesce(
            slot_text(ts), F.when(F.length(scene) >= 12, F.substring(scene, -12, 12)).otherwise(scene), F.lit("")
        ).alias("scene_slot"),
        lon.alias("center_lon"), lat.alias("center_lat"), lon.alias("peak_lon"), lat.alias("peak_lat"),
        lon.alias("bbox_lon_min"), lon.alias("bbox_lon_max"), lat.alias("bbox_lat_min"), lat.alias("bbox_lat_max"),
        F.greatest(
            F.when(area == 0, 1.0).otherwise(F.coalesce(area.cast("double"), F.lit(1.0))), F.lit(1.0)
        ).alias("cand_area"),
        zero(F.col("bt_tir")).alias("max_bt07_k"), zero(F.col("bt_dif")).alias("max_t713_k"),
        day_phase(have("daynight", F.lit(None).cast("string")), ts, lon).alias("day_phase"),
        region(lon).alias("region"), zero(F.col("score")).alias("physics_score"),
    )


def base_features(frame: DataFrame) -> DataFrame:
    """The 26 features that need nothing but the candidate itself."""
    c = F.col
    ts = c("acq_ts")
    month, hour = F.coalesce(F.month(ts), F.lit(1)), F.pmod(
        F.coalesce(F.hour(ts), F.lit(0)) + F.coalesce(F.minute(ts), F.lit(0)) / 60 + c("center_lon") / 15, F.lit(24.0)
    )
    out = frame.withColumns({
        "month_sin": F.sin(TURN * month / 12), "month_cos": F.cos(TURN * month / 12),
        "hour_sin": F.sin(TURN * hour / 24), "hour_cos": F.cos(TURN * hour / 24),
        "distance_star_km": great_circle_km("center_lon", "center_lat", SATELLITE_LON, 0.0),
        "lon_span_deg": c("bbox_lon_max") - c("bbox_lon_min"), "lat_span_deg": c("bbox_lat_max") - c("bbox_lat_min"),
        "peak_offset_km": great_circle_km("center_lon", "center_lat", "peak_lon", "peak_lat"),
        "bt07_level": c("max_bt07_k"), "bt07_sq": c("max_bt07_k") * c("max_bt07_k"),
        "t713_strength": F.greatest(c("max_t713_k"), F.lit(0.0)), "bt07_x_t713": c("max_bt07_k") * c("max_t713_k"),
        "area_sq": c("cand_area") * c("cand_area"),
        **{f"dn_{v}": (c("day_phase") == v).cast("float") for v in ("day", "twilight", "night")},
        **{f"region_{v}": (c("region") == v).cast("float") for v in ("east", "central", "west")},
    })
    return out.withColumns({
        "aspect_ratio": c("lon_span_deg") / F.greatest(c("lat_span_deg"), F.lit(1e-6)),
        "peak_offset_ratio": c("peak_offset_km") / (F.greatest(c("cand_area"), F.lit(1.0)) * 2),
    })


def plant_radius_km(capacity_mw) -> Column:
    """Radius of a solar plant's area at 35 MW per square km, between 0.25 and 2.5 km."""
    mw = _col(capacity_mw)
    r = F.when(mw > 0, F.sqrt(mw / (35 * 3.141592653589793))).otherwise(0.25)
    return F.round(F.least(F.greatest(r, F.lit(0.25)), F.lit(2.5)), 3)
