"""File and slot names of satellite archives, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.geo import _col

# Fixed value: name of a segment file.
SEGMENT = r"^HS_(H\d{2})_(\d{8})_(\d{4})_B(\d{2})_FLDK_R(\d{2})_S(\d{2})(\d{2})\.DAT\.bz2$"


def segment_name(name) -> Column:
    """struct(satellite, scene_id, band, segment, total) of a segment file, null if the name is none."""
    part = lambda k: F.regexp_extract(_col(name), SEGMENT, k)
    return F.when(
        F.coalesce(_col(name).rlike(SEGMENT), F.lit(False)),
        F.struct(
            part(1).alias("satellite"), F.concat(part(2), part(3)).alias("scene_id"), part(4).alias("band"),
            part(6).cast("int").alias("segment"), part(7).cast("int").alias("total")
        ),
    )


def expected_name(satellite, scene_id, band, segment) -> Column:
    """The archive's name of a segment; band 03 has the finest resolution."""
    satellite, scene_id, band, segment = map(_col, (satellite, scene_id, band, segment))
    return F.format_string(
        "HS_%s_%s_%s_B%s_FLDK_R%s_S%02d10.DAT.bz2", satellite, F.substring(scene_id, 1, 8), F.substring(scene_id, 9, 4),
        band, F.when(band == "03", "05").otherwise("20"), segment.cast("int")
    )


def band_of(key) -> Column:
    return F.nullif(F.regexp_extract(_col(key), r"B(\d{2})", 1), F.lit(""))


def segment_of(key) -> Column:
    return F.regexp_extract(_col(key), r"_S(\d{2})10", 1).try_cast("int")


def normal_bands(bands: Column) -> Column:
    """Band labels such as B7, 07 or 13 as two digits, each once, in their order."""
    return F.array_distinct(F.transform(bands, lambda b: F.lpad(F.regexp_replace(F.upper(b), "[^0-9]", ""), 2, "0")))


def scene_time(scene_id) -> Column:
    return F.try_to_timestamp(_col(scene_id), F.lit("yyyyMMddHHmm"))


def scene_key(iso) -> Column:
    """yyyyMMddHHmm of an ISO time text."""
    return F.substring(F.regexp_replace(_col(iso), r"[-:TZ.]", ""), 1, 12)


def slot_floor(ts: Column, minutes: int = 10) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / (60 * minutes)) * (60 * minutes))


def slots(spark: SparkSession, now: Column, lookback: int, minutes: int = 10, lag_minutes: int = 20) -> DataFrame:
    """(slot): the last ``lookback`` + 1 slots that can be complete, the latest first."""
    latest = slot_floor(now - F.make_interval(mins=F.lit(lag_minutes)), minutes)
    return spark.range(lookback + 1).select(
        F.timestamp_seconds(F.unix_timestamp(latest) - F.col("id") * 60 * minutes).alias("slot")
    )


def render(template, variables: Column) -> Column:
    """``{NAME}`` replaced by its value; an unknown name by nothing. ``variables`` is a map column."""
    names = F.array_distinct(F.regexp_extract_all(_col(template), F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1)))
    return F.aggregate(
        names, _col(template), lambda text,
        n: F.replace(text, F.concat(F.lit("{"), n, F.lit("}")), F.coalesce(variables[n], F.lit("")))
    )


def time_variables(ts: Column, lon: float = 116.39, lat: float = 39.9) -> Column:
    """Map of the template variables of a time and a place."""
    from emberframe.functions.geo import elevation_tile, land_cover_tile

    f = lambda p: F.date_format(ts, p)
    pairs = {
        "YYYY": f("yyyy"), "MM": f("MM"), "DD": f("dd"), "HH": f("HH"), "mm": f("mm"), "YYYYMM": f("yyyyMM"),
        "YYYYMMDD": f("yyyyMMdd"), "AOI_LON": F.lit(str(lon)), "AOI_LAT": F.lit(str(lat)),
        "DEM_TILE": elevation_tile(lon, lat), "WORLDCOVER_TILE": land_cover_tile(lon, lat)
    }
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def safe_name(name) -> Column:
    return F.regexp_replace(_col(name), r'[<>:"/\\|?*]+', "_")


def sensor_of(file_name) -> Column:
    """Sensor of an official active-fire file, by its name."""
    n = F.upper(_col(file_name))
    return F.when(n.contains("MODIS"), "MODIS").when(n.contains("SUOMI") | n.contains("SNPP"), "VIIRS_SNPP").when(
        n.contains("NOAA21") | n.contains("J2_VIIRS"), "VIIRS_NOAA21"
    ).otherwise("VIIRS_NOAA20")


def report_time(date, time) -> Column:
    """Time of a report with a date yyyy-MM-dd and a time HHmm that may lack leading zeros; null if it is none."""
    return F.try_to_timestamp(
        F.concat(F.trim(_col(date)), F.lit(" "), F.lpad(F.trim(_col(time).cast("string")), 4, "0")),
        F.lit("yyyy-MM-dd HHmm")
    )


def listing_next(xml) -> Column:
    """The token of the listing's next page, null on the last one."""
    token = F.regexp_extract(_col(xml), r"(?s)<NextContinuationToken>(.*?)</NextContinuationToken>", 1)
    more = F.lower(F.regexp_extract(_col(xml), r"<IsTruncated>\s*(\w+)\s*</IsTruncated>", 1)) == "true"
    return F.when(more & (F.length(token) > 0), token)


def listing_entries(xml) -> Column:
    """array of struct(key, size, modified) of an object-store listing in XML, with entities decoded."""
    entry = F.regexp_extract_all(_col(xml), F.lit(r"(?s)<Contents>(.*?)</Contents>"), F.lit(1))

    def decoded(text: Column) -> Column:
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(sign))
        return text

    tag = lambda e, name: F.regexp_extract(e, rf"(?s)<{name}>(.*?)</{name}>", 1)
    return F.transform(
        entry,
        lambda e: F.struct(
            decoded(tag(e, "Key")).alias("key"), tag(e, "Size").try_cast("long").alias("size"),
            F.try_to_timestamp(tag(e, "LastModified")).alias("modified")
        )
    )
