"""Geometry on the sphere and in longitude/latitude, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Mean radius used for distances to the point below the satellite.
EARTH_MEAN_KM = 6371.0088


def _col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    a = F.pow(
        F.sin(F.radians(lat2 - lat1) / 2), 2
    ) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.greatest(a, F.lit(0.0))))


def great_circle_km(lon1, lat1, lon2, lat2) -> Column:
    """By the spherical law of cosines; noisy for points that nearly coincide."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    p, q = F.radians(lat1), F.radians(lat2)
    c = F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(F.radians(lon1 - lon2))
    return EARTH_MEAN_KM * F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def in_box(lon, lat, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Column:
    """Both bounds belong to the box; a null coordinate is outside."""
    return F.coalesce(_col(lon).between(min_lon, max_lon) & _col(lat).between(min_lat, max_lat), F.lit(False))


def normalize_longitude(lon) -> Column:
    """Into [-180, 180] by whole turns; both ends stay as they are."""
    lon = _col(lon)
    return F.when(lon > 180, lon - 360 * F.ceil((lon - 180) / 360)).when(
        lon < -180, lon + 360 * F.ceil((-180 - lon) / 360)
    ).otherwise(lon)


def grid_cell(coordinate, degrees: float) -> Column:
    return F.floor(_col(coordinate) / degrees).cast("int")


def ring_crossings(ring: Column, lon: Column, lat: Column) -> Column:
    """Edges of a ring (array of struct x, y, closed or not) that a ray to the east crosses; half-open in latitude."""
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, 1), F.slice(ring, 1, n - 1))
    return F.aggregate(
        F.zip_with(
            ring,
            before,
            lambda a, b: F.when(
                ((a["y"] > lat) != (b["y"] > lat))
                & (
                    lon < (b["x"] - a["x"]) * (lat - a["y"]) / F.when(
                        b["y"] == a["y"], F.lit(1e-12)
                    ).otherwise(b["y"] - a["y"])
                    + a["x"]
                ),
                1,
            ).otherwise(0),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )


def point_in_polygon(rings: Column, lon, lat) -> Column:
    """Even-odd test against rings of one polygon: inside the first, in none of the others (holes)."""
    lon, lat = _col(lon), _col(lat)
    outer = F.when(F.size(rings) > 0, F.pmod(ring_crossings(rings[0], lon, lat), F.lit(2)) == 1).otherwise(False)
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    in_hole = F.exists(holes, lambda r: F.pmod(ring_crossings(r, lon, lat), F.lit(2)) == 1)
    return F.coalesce(outer & ~F.coalesce(in_hole, F.lit(False)), F.lit(False))


def on_ring(ring: Column, lon: Column, lat: Column, tolerance: float = 1e-9) -> Column:
    """Whether the point lies on an edge of the ring."""
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, 1), F.slice(ring, 1, n - 1))
    touched = F.zip_with(
        ring,
        before,
        lambda a, b: (F.abs((b["x"] - a["x"]) * (lat - a["y"]) - (b["y"] - a["y"]) * (lon - a["x"])) <= tolerance)
        & lon.between(F.least(a["x"], b["x"]) - tolerance, F.greatest(a["x"], b["x"]) + tolerance)
        & lat.between(F.least(a["y"], b["y"]) - tolerance, F.greatest(a["y"], b["y"]) + tolerance),
    )
    return F.exists(touched, lambda t: t)


def point_in_polygon_inclusive(rings: Column, lon, lat) -> Column:
    """As ``point_in_polygon``, and points on the outer ring or on a hole's ring count as inside."""
    lon, lat = _col(lon), _col(lat)
    return point_in_polygon(rings, lon, lat) | F.coalesce(F.exists(rings, lambda r: on_ring(r, lon, lat)), F.lit(False))


def ring_box(rings: Column) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y) of the outer ring."""
    x, y = F.transform(rings[0], lambda p: p["x"]), F.transform(rings[0], lambda p: p["y"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def axis_step(before: Column, here: Column, after: Column) -> Column:
    """Step of a coordinate along an axis: the central difference, or one-sided at an edge, or 0."""
    return F.when(
        before.isNotNull() & after.isNotNull(), (after - before) / 2
    ).when(after.isNotNull(), after - here).when(before.isNotNull(), here - before).otherwise(0.0)


def pixel_ring(lon, lat, lon_row, lon_col, lat_row, lat_col) -> Column:
    """Closed ring of a pixel from its centre and the steps of both coordinates along rows and columns."""
    lon, lat, lr, lc, ar, ac = map(_col, (lon, lat, lon_row, lon_col, lat_row, lat_col))
    corners = ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))
    return F.array(
        *[
            _point(F.round(lon + 0.5 * r * lr + 0.5 * c * lc, 7), F.round(lat + 0.5 * r * ar + 0.5 * c * ac, 7)) for r,
            c in corners
        ]
    )


def metre_box(lon, lat, width_m, height_m) -> Column:
    """Closed ring of an axis-aligned box of the given size around a point."""
    lon, lat, w, h = map(_col, (lon, lat, width_m, height_m))
    scale = EARTH_KM * 1000 * 3.141592653589793 / 180
    dx = w / 2 / (scale * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    dy = h / 2 / scale
    corners = ((-1, 1), (1, 1), (1, -1), (-1, -1), (-1, 1))
    return F.array(*[_point(F.round(lon + sx * dx, 7), F.round(lat + sy * dy, 7)) for sx, sy in corners])


def ring_area_km2(ring: Column) -> Column:
    """Area of a four-cornered ring: mean of opposite widths times mean of opposite heights."""
    side = lambda a, b: haversine_km(ring[a]["x"], ring[a]["y"], ring[b]["x"], ring[b]["y"])
    return (side(0, 1) + side(3, 2)) / 2 * ((side(0, 3) + side(1, 2)) / 2)


def cell_ring(lon, lat, step_lon, step_lat) -> Column:
    """Closed ring of a grid cell around its centre; across the date line the right side lies beyond 180."""
    lon, lat, sx, sy = map(_col, (lon, lat, step_lon, step_lat))
    left, right = normalize_longitude(lon - sx / 2), normalize_longitude(lon + sx / 2)
    low, high = F.greatest(lat - sy / 2, F.lit(-90.0)), F.least(lat + sy / 2, F.lit(90.0))
    right = F.when(right < left, right + 360).otherwise(right)
    return F.array(_point(left, low), _point(right, low), _point(right, high), _point(left, high), _point(left, low))


def point_wkt(lon, lat) -> Column:
    return F.format_string("POINT (%.6f %.6f)", _col(lon).cast("double"), _col(lat).cast("double"))


def _signed(tile: Column, positive: str, negative: str, width: int) -> Column:
    return F.concat(F.when(tile >= 0, positive).otherwise(negative), F.lpad(F.abs(tile).cast("string"), width, "0"))


def elevation_tile(lon, lat) -> Column:
    """Name of the 1-degree elevation tile, such as N39_00_E116_00."""
    y, x = F.floor(_col(lat)).cast("int"), F.floor(_col(lon)).cast("int")
    return F.concat(_signed(y, "N", "S", 2), F.lit("_00_"), _signed(x, "E", "W", 3), F.lit("_00"))


def land_cover_tile(lon, lat) -> Column:
    """Name of the 3-degree land-cover tile, such as N39E114."""
    y, x = (F.floor(_col(lat) / 3) * 3).cast("int"), (F.floor(_col(lon) / 3) * 3).cast("int")
    return F.concat(_signed(y, "N", "S", 2), _signed(x, "E", "W", 3))
