"""Catalog and file bookkeeping: completeness, fallbacks, upserts, manifests, retention, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_scenes(files: DataFrame, bands: list[str], segments: list[int], least: int | None = None) -> DataFrame:
    """(scene_id, files) of scenes (files: scene_id, band, segment, path) that have every wanted segment of every wanted
    band, and ``least`` segments a band; relational division by counting what matches."""
    wanted = files.filter(F.col("band").isin(bands))
    per = wanted.groupBy("scene_id", "band").agg(
        F.count_distinct("segment").alias("n"),
        F.count_distinct(F.when(F.col("segment").isin(segments), F.col("segment"))).alias("have")
    )
    good = per.filter(
        (F.col("have") == len(set(segments))) & (F.col("n") >= (least or len(set(segments))))
    ).groupBy("scene_id").agg(F.count("*").alias("bands"))
    good = good.filter(F.col("bands") == len(set(bands))).select("scene_id")
    listed = F.sort_array(F.collect_list(F.struct("band", "segment", "path"))).alias("files")
    return wanted.join(good, "scene_id", "left_semi").groupBy("scene_id").agg(listed)


def latest_scenes(
    files: DataFrame, bands: list[str], segments: list[int], n: int | None = 1, oldest_first: bool = False
) -> DataFrame:
    """The ``n`` latest scenes (None: all) that are complete by their files' names, or for a replay the oldest; partial
    downloads do not count. ``hsd.latest_scenes`` reads the files too."""
    whole = files.filter(~F.coalesce(F.col("path").contains(".partial-"), F.lit(False)))
    order = F.asc("scene_id") if oldest_first else F.desc("scene_id")
    out = complete_scenes(whole, bands, segments).orderBy(order)
    return out if n is None else out.limit(n)


def completeness(files: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("slot", "band")) -> DataFrame:
    """Per expected key (with ``wanted``): found, missing and whether it is complete."""
    have = files.groupBy(*keys).agg(F.count_distinct("segment").alias("found"))
    out = expected.join(have, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn(
        "missing", F.greatest(F.col("wanted") - F.col("found"), F.lit(0))
    ).withColumn("complete", F.col("missing") == 0)


def by_priority(df: DataFrame, keys: list[str], priority: str, order: list[str] | None = None) -> DataFrame:
    """One row per key: that of the preferred source, others only where it has none."""
    w = Window.partitionBy(*keys).orderBy(priority, *(order or []))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_rows(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def distinct_references(references: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Official detections without repeats of sensor, time and place (to 6 digits), the first read staying."""
    return first_rows(references, ["sensor", "acq_ts", F.round("lon", 6), F.round("lat", 6)], [order])


def accepted_references(
    references: DataFrame, box: tuple[float, float, float, float], at: Column, hours: float,
    viirs: tuple[str, ...] = ("nominal", "high", "n", "h"), modis_least: float = 30.0
) -> DataFrame:
    """Detections inside the box and time, of a vegetation fire type, with enough confidence (a word for one sensor
    family, a number for the other)."""
    from emberframe.functions.geo import in_box

    close = F.abs(F.unix_micros("acq_ts") - F.unix_micros(at)) <= hours * 3.6e9
    kind = F.trim(F.coalesce("fire_type", F.lit(""))).isin("", "0", "0.0")
    word = F.lower(F.trim("confidence"))
    sure = F.when(F.col("sensor") == "MODIS", word.try_cast("double") >= modis_least).otherwise(word.isin(*viirs))
    return references.filter(in_box("lon", "lat", *box) & close & kind & F.coalesce(sure, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with ``new`` rows put in by key, the last by ``order`` of several; columns ``keep`` stay as they were where
    the row was there before. Columns that only one side has are added."""
    latest = first_rows(new, [key], [F.desc(order)])
    both = old.withColumn("_s", F.lit(0)).unionByName(latest.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key)
    for c in keep:
        both = both.withColumn(c, F.coalesce(F.max(F.when(F.col("_s") == 0, F.col(c))).over(w), F.col(c)))
    return first_rows(both, [key], [F.desc("_s")]).drop("_s")


def replace_scenes(
    old: DataFrame, new: DataFrame, scenes: DataFrame, keys: tuple[str, ...] = ("source_sat", "acq_ts")
) -> DataFrame:
    """``old`` without the rows of ``scenes`` (keys), plus ``new``: a scene that has no fires any more is cleared too."""
    return old.join(scenes.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def digests(files: DataFrame) -> DataFrame:
    """(path, size, md5, sha256) of files (path, content, order); of several with one path the first stays."""
    one = first_rows(files, ["path"], ["order"])
    content = F.col("content").cast("binary")
    return one.select(
        "path", F.length(content).cast("long").alias("size"), F.md5(content).alias("md5"),
        F.sha2(content, 256).alias("sha256")
    )


def manifest(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files; see ``digests``."""
    return digests(files).drop("md5")


def collected_outputs(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """(output, path, order) of the files (output, path) of the wanted outputs (output, order, required), a path once, for
    the first output that has it. A required output without a file fails the job; others may have none."""
    found = outputs.join(files, "output", "left")
    missing = F.col("path").isNull() & F.coalesce("required", F.lit(True))
    checked = F.when(
        missing, F.raise_error(F.concat(F.lit("no file of the output "), "output"))
    ).otherwise(F.col("path"))
    present = found.select("output", checked.alias("path"), "order").filter("path is not null")
    return first_rows(present, ["path"], ["order", "output"])


def resolved_overlays(overlays: DataFrame, files: DataFrame) -> DataFrame:
    """Overlays (source_id, type, local_path, web_path, description) with the names of the latest files (local_path,
    file_name, web_path, place) at their paths, the first of several; without one, the path's own last part."""
    one = first_rows(files, ["local_path"], ["place"]).select(
        "local_path", F.col("file_name").alias("_name"), F.col("web_path").alias("_web")
    )
    own = F.element_at(F.split("local_path", r"[/\\]"), -1)
    return overlays.join(one, "local_path", "left").select(
        "source_id", "type", F.coalesce("_name", own).alias("file_name"),
        F.coalesce("_web", "web_path").alias("web_path"), F.coalesce("description", F.lit("")).alias("description")
    )


def manifest_changes(old: DataFrame, new: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(path, change): new, changed, missing (listed in both, alike, but not ``present`` here), same, or removed."""
    o = old.select("path", F.col("size").alias("o_size"), F.col("sha256").alias("o_sha"), F.lit(True).alias("_o"))
    n = new.select("path", F.col("size").alias("n_size"), F.col("sha256").alias("n_sha"), F.lit(True).alias("_n"))
    both = o.join(n, "path", "full_outer")
    here = both.withColumn("_h", F.lit(True)) if present is None else both.join(
        present.select("path").distinct().withColumn("_h", F.lit(True)), "path", "left"
    )
    changed = (F.col("o_size") != F.col("n_size")) | (F.col("o_sha") != F.col("n_sha"))
    change = F.when(
        F.col("_n").isNull(), "removed"
    ).when(F.col("_o").isNull(), "new").when(changed, "changed").when(F.col("_h").isNull(), "missing").otherwise("same")
    return here.select("path", change.alias("change"))


def retained(rows: DataFrame, ts: str = "acq_ts", minutes: float = 60.0) -> DataFrame:
    """Rows not older than ``minutes`` before the latest event; a row without a time stays."""
    latest = rows.agg(F.max(ts).alias("_latest"))
    out = rows.crossJoin(F.broadcast(latest))  # one row
    return out.filter(
        F.col(ts).isNull() | (F.unix_micros(ts) >= F.unix_micros("_latest") - minutes * 6e7)
    ).drop("_latest")


def latest_snapshots(rows: DataFrame, key: str, n: int) -> DataFrame:
    last = rows.select(key).distinct().orderBy(F.desc(key)).limit(n)
    return rows.join(last, key, "left_semi")


def staleness(scenes: DataFrame, now: Column, limit_minutes: float = 20.0, ts: str = "acq_ts") -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros(ts)) / 6e7
    return scenes.withColumn("age_minutes", F.round(age, 1)).withColumn("stale", age > limit_minutes)


def recent(
    scenes: DataFrame, now: Column, max_age_minutes: float, slot_minutes: float = 10.0, lookback: int = 0,
    ts: str = "acq_ts"
) -> DataFrame:
    """Scenes not older than the greater of the maximal age and the slots looked back on."""
    most = max(max_age_minutes, slot_minutes * (lookback + 1))
    return scenes.filter(F.unix_micros(ts) >= F.unix_micros(now) - most * 6e7)


def last_good(current: DataFrame, previous: DataFrame, key: str = "source_id") -> DataFrame:
    """Current entries; where one failed (status not ok), the previous entry of the source if there is one, marked so."""
    p = previous.select(key, F.struct(*[c for c in previous.columns if c != key]).alias("_p"))
    failed = F.coalesce(F.col("status") != "ok", F.lit(True))
    use = failed & F.col("_p").isNotNull()
    out = current.join(p, key, "left")
    return out.select(
        key, *[F.when(use, F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c) for c in current.columns if c != key],
        use.alias("recovered")
    )


def transfer_lanes(files: DataFrame, lanes: int, chunk: int, order: tuple[str, ...] = ("name",)) -> DataFrame:
    """Files dealt round-robin to at most ``lanes`` lanes per band, then cut into chunks."""
    w = Window.partitionBy("band").orderBy(*order)
    n = F.row_number().over(w) - 1
    use = F.least(F.lit(lanes), F.count("*").over(Window.partitionBy("band")))
    out = files.withColumn("lane", F.pmod(n, use).cast("int"))
    place = F.row_number().over(Window.partitionBy("band", "lane").orderBy(*order)) - 1
    return out.withColumn("batch", F.floor(place / chunk).cast("int"))


def unmatched_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key is not in ``parent``: what a foreign key would refuse."""
    return child.filter(F.col(key).isNotNull()).join(
        parent.select(F.col(parent_key or key).alias(key)).distinct(), key, "left_anti"
    )


def repeated_keys(df: DataFrame, keys: list[str], partial: bool = False) -> DataFrame:
    """Keys that occur more than once: what a unique index would refuse; with ``partial``, keys with a null may repeat."""
    rows = df.dropna(subset=keys) if partial else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def scene_ids(rows: DataFrame, scenes: DataFrame, ts: str = "acq_ts") -> DataFrame:
    """``rows`` with the greatest scene_id of their time."""
    s = scenes.groupBy(F.col(ts).alias("_t")).agg(F.max("scene_id").alias("scene_id"))
    return rows.drop("scene_id").join(s, F.col(ts) == F.col("_t"), "left").drop("_t")


def unprocessed(scenes: DataFrame, done: DataFrame, ts: str = "acq_ts") -> DataFrame:
    return scenes.join(done.select(ts).distinct(), ts, "left_anti")


def latest_available(wanted: DataFrame, listing: DataFrame, order: str, key: str = "name") -> DataFrame:
    """The latest of the wanted cycles whose first file the listing has; none if no cycle is available."""
    return wanted.join(listing.select(key).distinct(), key, "left_semi").orderBy(F.desc(order)).limit(1)


def expired(
    rows: DataFrame, before: Column, ts: str = "acq_ts", fallback: str = "download_time",
    prefix: tuple[str, str] | None = None
) -> DataFrame:
    """Rows older than ``before`` by their time, or by ``fallback`` where they have none; with a prefix, only those whose
    column begins with it."""
    old = F.coalesce(F.col(ts), F.col(fallback)) < before
    return rows.filter(old if prefix is None else old & F.col(prefix[0]).startswith(prefix[1]))
