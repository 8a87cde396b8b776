"""Calibration, navigation, sun geometry, masks and scores of geostationary imagery, as Column expressions.

A missing value is null, never NaN. A predicate that may be used under NOT or in CASE is false, not null, where an input
is missing.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.functions.geo import _col

# Constants of Planck's law in W / (m2 sr um) and um K.
PLANCK_C1, PLANCK_C2 = 1.191042972e8, 1.4387769e4
RAD = 57.29577951308232


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the detector, with its defaults."""

    suspicious_offset_k: float = 20.0
    suspicious_visible_factor: float = 100.0
    min_valid_ratio: float = 0.2
    night_absolute_t7_k: float = 320.0
    night_visible_max: float = 0.7
    night_zenith_deg: float = 87.0
    cloud_visible_reflectance: float = 0.28
    cloud_zenith_limit_deg: float = 70.0
    cloud_visible_delta: float = 0.15
    cloud_t13_delta_k: float = 5.0
    edge_threshold_c: float = 8.0
    thermal_source_radius_km: float = 4.0
    min_background_pixels: int = 4
    min_std_t713_k: float = 2.0
    max_std_t713_k: float = 4.0
    absolute_score_scale_k: float = 10.0
    confidence_medium: float = 2.0
    confidence_high: float = 3.5
    night_candidate_offset_k: float = 4.0
    local_maximum_window: int = 1
    windows: tuple[int, ...] = (7, 9, 11, 19)

    def checked(self) -> Thresholds:
        """Raises on values that no run can use."""
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name != "windows" and not v == v:
                raise ValueError(f"{f.name} is not a number")
        if not 0 <= self.min_valid_ratio <= 1:
            raise ValueError("min_valid_ratio must lie in [0, 1]")
        if not self.windows or any(w < 3 or w % 2 == 0 for w in self.windows):
            raise ValueError("windows must be odd and at least 3")
        if self.min_std_t713_k > self.max_std_t713_k:
            raise ValueError("min_std_t713_k exceeds max_std_t713_k")
        return self


@dataclass(frozen=True)
class Rescue:
    """Second tier with a scaled threshold, decided on by a model later."""

    enabled: bool = False
    scale: float = 0.8
    edge_threshold_c: float = 5.0
    most: int = 400

    def normal(self) -> Rescue:
        return Rescue(
            bool(self.enabled), min(max(float(self.scale), 0.4), 1.0), max(float(self.edge_threshold_c), 0.0),
            max(int(self.most), 0)
        )


def true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def present(x) -> Column:
    """Finite: neither null nor NaN nor infinite."""
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite(x) -> Column:
    """The value, or null where it is not finite."""
    return F.when(present(x), _col(x))


def _radiance(count: Column, slope, intercept, error_count, outside_count) -> Column:
    r = _col(slope) * count + _col(intercept)
    return F.when((count != _col(error_count)) & (count != _col(outside_count)) & (r > 0), r)


def brightness_temperature(count, slope, intercept, wavelength_um, c0, c1, c2, error_count, outside_count) -> Column:
    """Kelvin, or null for error and outside counts and radiances not above 0."""
    r = _radiance(_col(count), slope, intercept, error_count, outside_count)
    w = _col(wavelength_um)
    te = PLANCK_C2 / (w * F.log1p(PLANCK_C1 / (r * F.pow(w, 5))))
    return _col(c0) + _col(c1) * te + _col(c2) * te * te


def reflectance(count, slope, intercept, albedo, error_count, outside_count) -> Column:
    x = _radiance(_col(count), slope, intercept, error_count, outside_count) * _col(albedo)
    return F.when(x >= 0, x)


@dataclass(frozen=True)
class Projection:
    """Normalised geostationary projection."""

    sub_lon: float
    cfac: int
    lfac: int
    coff: float
    loff: float
    height_km: float = 42164.0
    equatorial_km: float = 6378.137
    polar_km: float = 6356.7523


def to_column_line(lon, lat, p: Projection) -> tuple[Column, Column, Column]:
    """(column, line, visible) of a place; columns and lines count from 1."""
    lon, lat = _col(lon), _col(lat)
    flat = p.polar_km**2 / p.equatorial_km**2
    dl = F.radians(lon - p.sub_lon)
    phi = F.atan(flat * F.tan(F.radians(lat)))
    re = p.polar_km / F.sqrt(1 - (1 - flat) * F.pow(F.cos(phi), 2))
    r1 = p.height_km - re * F.cos(phi) * F.cos(dl)
    r2 = -re * F.cos(phi) * F.sin(dl)
    r3 = re * F.sin(phi)
    rn = F.sqrt(r1 * r1 + r2 * r2 + r3 * r3)
    column = p.coff + F.degrees(F.atan2(-r2, r1)) * p.cfac / 65536
    line = p.loff + F.degrees(F.asin(-r3 / rn)) * p.lfac / 65536
    # seen on the near side of the plane through the limb
    visible = true(p.height_km * (p.height_km - r1) > r2 * r2 + r3 * r3 / flat)
    return column, line, visible


def to_lon_lat(column, line, p: Projection) -> tuple[Column, Column]:
    """(lon, lat) seen by a pixel, null beyond the disk."""
    x = F.radians((_col(column) - p.coff) * 65536 / p.cfac)
    y = F.radians((p.loff - _col(line)) * 65536 / p.lfac)
    k = p.equatorial_km**2 / p.polar_km**2
    cc = F.cos(x) * F.cos(y)
    q = F.cos(y) * F.cos(y) + k * F.sin(y) * F.sin(y)
    d = F.pow(p.height_km * cc, 2) - q * (p.height_km**2 - p.equatorial_km**2)
    sn = (p.height_km * cc - F.sqrt(F.when(d > 0, d))) / q
    s1, s2, s3 = p.height_km - sn * cc, sn * F.sin(x) * F.cos(y), sn * F.sin(y)
    return p.sub_lon + F.degrees(F.atan2(s2, s1)), F.degrees(F.atan(k * s3 / F.sqrt(s1 * s1 + s2 * s2)))


def affine_lon_lat(row, col, lon0: float, lat0: float, lon_step: float, lat_step: float) -> tuple[Column, Column]:
    """(lon, lat) of a pixel of a regular grid that begins at (lon0, lat0), to six digits."""
    return F.round(lon0 + _col(col) * lon_step, 6), F.round(lat0 + _col(row) * lat_step, 6)


def crop_bounds(
    p: Projection, columns: int, lines: int, box: tuple[float, float, float, float], margin: int
) -> dict[str, int]:
    """Pixel bounds of a box (min lon, min lat, max lon, max lat): its corners and centre, a margin, clamped to the disk."""
    import math

    def place(lon: float, lat: float) -> tuple[float, float]:
        flat = p.polar_km**2 / p.equatorial_km**2
        dl, phi = math.radians(lon - p.sub_lon), math.atan(flat * math.tan(math.radians(lat)))
        re = p.polar_km / math.sqrt(1 - (1 - flat) * math.cos(phi) ** 2)
        a, b, c = p.height_km - re * math.cos(phi) * math.cos(dl), re * math.cos(phi) * math.sin(dl), re * math.sin(phi)
        return p.coff + math.degrees(math.atan2(b, a)) * p.cfac / 65536, p.loff + math.degrees(
            math.asin(-c / math.sqrt(a * a + b * b + c * c))
        ) * p.lfac / 65536

    x0, y0, x1, y1 = box
    at = [place(x, y) for x, y in ((x0, y0), (x0, y1), (x1, y0), (x1, y1), ((x0 + x1) / 2, (y0 + y1) / 2))]
    c, r = [a for a, _ in at], [b for _, b in at]
    low_c, high_c = max(math.floor(min(c)) - margin, 1), min(math.ceil(max(c)) + margin, columns)
    low_r, high_r = max(math.floor(min(r)) - margin, 1), min(math.ceil(max(r)) + margin, lines)
    return {
        "lineStart": low_r, "lineEnd": high_r, "colStart": low_c, "colEnd": high_c, "height": high_r - low_r + 1,
        "width": high_c - low_c + 1
    }


def solar_altitude(ts, lon, lat) -> Column:
    """Degrees above the horizon; ``ts`` is a timestamp in a UTC session."""
    ts, lon, lat = F.col(ts) if isinstance(ts, str) else ts, _col(lon), _col(lat)
    declination = F.radians(23.45 * F.sin(F.radians(F.lit(360.0 / 365.0) * (284 + F.dayofyear(ts)))))
    hour = F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600
    angle = F.radians(15.0 * (hour + lon / 15.0 - 12.0))
    s = F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(angle)
    return F.degrees(F.asin(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0))))


def solar_zenith(ts, lon, lat) -> Column:
    return 90.0 - solar_altitude(ts, lon, lat)


def thermal_valid(roi, b07, b13, b14) -> Column:
    return true(_col(roi)) & _col(b07).isNotNull() & _col(b13).isNotNull() & _col(b14).isNotNull()


def cloudy(b07, b13, b14, rvis, zenith, night: Column, t: Thresholds) -> Column:
    """The five cloud tests, for pixels that are valid."""
    b07, b13, b14, rvis, zenith = map(_col, (b07, b13, b14, rvis, zenith))
    d = b07 - b13
    cold = (b13 < 270) & ((b13 - b14 < 4) | (b13 - b14 > 60))
    bright = (rvis > t.cloud_visible_reflectance) & (zenith < t.cloud_zenith_limit_deg)
    return true(~night & (d < 4)) | true(
        (d > 20) & ((b07 < 275) | (b13 < 270))
    ) | true(bright) | true(b14 < 265) | true(cold)


def cloudy_simple(b07, b13, b14, rvis, zenith) -> Column:
    """The cloud tests of the simple detector: a difference below 4 K is cloud by night too, and a missing reflectance is 0."""
    b07, b13, b14, zenith = map(_col, (b07, b13, b14, zenith))
    d = b07 - b13
    v = F.coalesce(_col(rvis), F.lit(0.0))
    return true(d < 4) | true(
        (d > 20) & ((b07 < 275) | (b13 < 270))
    ) | true((v > 0.28) & (zenith < 70)) | true(b14 < 265) | true(
        (b13 < 270) & ((b13 - b14 < 4) | (b13 - b14 > 60))
    )


def day_seed(b07, b13, rvis, clear: Column, t: Thresholds) -> Column:
    """Two independent conditions: on the difference, and on the 3.9 um temperature against the reflectance."""
    b07, b13, rvis = map(_col, (b07, b13, rvis))
    return clear & true(
        (b07 - b13 > t.suspicious_offset_k) & (b07 > rvis * t.suspicious_visible_factor + t.suspicious_offset_k)
    )


def night_seed(b07, rvis, clear: Column, night: Column, t: Thresholds) -> Column:
    return clear & night & true(_col(b07) > t.night_absolute_t7_k) & (
        _col(rvis).isNull() | true(_col(rvis) < t.night_visible_max)
    )


def permissive_candidate(b07, b13, rvis, clear: Column, night: Column, t: Thresholds) -> Column:
    """The wide mask on which a classifier is trained."""
    d = _col(b07) - _col(b13)
    return (day_seed(b07, b13, rvis, clear, t) & ~night) | (clear & night & true(d > t.night_candidate_offset_k))


def dynamic_factor(altitude, pv, pc) -> Column:
    """Threshold factor from the sun's altitude and the shares of non-vegetation and cloud around."""
    altitude, pv, pc = map(_col, (altitude, pv, pc))
    s = F.greatest(F.sin(F.radians(F.greatest(altitude, F.lit(0.0)))), F.lit(0.0))
    return F.when(altitude < 60, (s + 1) * (1 + pv) * (1 + pc)).otherwise((1.2 * s + 1) * (1 + pv) * F.pow(1 + pc, 2))


def evidence(t7, t713, t7_bg, std_t7, t713_bg, std_t713, factor, night_hot, t: Thresholds) -> Column:
    """struct(score, t7_excess, t713_excess): how many deviations both temperatures exceed their thresholds by."""
    t7, t713, t7_bg, t713_bg, factor = map(_col, (t7, t713, t7_bg, t713_bg, factor))
    s7, s713 = F.greatest(_col(std_t7), F.lit(0.1)), F.greatest(_col(std_t713), F.lit(0.1))
    a, b = (t7 - (t7_bg + factor * s7)) / s7, (t713 - (t713_bg + factor * s713)) / s713
    relative = F.greatest(F.least(a, b), F.lit(0.0)) + 0.25 * F.greatest((a + b) / 2, F.lit(0.0))
    absolute = F.when(
        true(_col(night_hot)),
        2.0 + F.greatest((t7 - t.night_absolute_t7_k) / max(t.absolute_score_scale_k, 0.1), F.lit(0.0))
    ).otherwise(0.0)
    return F.struct(
        F.round(F.least(F.greatest(relative, absolute), F.lit(10.0)), 3).alias("score"),
        F.round(a, 3).alias("t7_excess"), F.round(b, 3).alias("t713_excess")
    )


def confidence(score, high: float = 3.5, medium: float = 2.0) -> Column:
    """high, medium or low; a medium bound above the high one counts as the high one."""
    score = _col(score)
    return F.when(score >= high, "high").when(score >= min(medium, high), "medium").otherwise("low")


def model_confidence(probability, high: float = 0.65, medium: float = 0.35) -> Column:
    p = _col(probability)
    return F.when(p >= high, "high").when(p >= medium, "medium").otherwise("low")
