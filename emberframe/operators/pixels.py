"""Detection of thermal anomalies on pixels: masks, seeds, background statistics, the cascade of tests, scores.

A pixel table has scene_id, row, col, lon, lat, acq_ts, b07, b13, b14, rvis, roi, non_vegetation; a missing value is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from emberframe.functions import radiometry as R
from emberframe.functions.radiometry import Rescue, Thresholds, true
from emberframe.operators.tables import kept

PIXEL = ("scene_id", "row", "col")


def observe(pixels: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``pixels`` with t713, altitude, zenith (unless given), thermal, night, visible, valid, cloud, clear."""
    if "altitude" not in pixels.columns:
        pixels = pixels.withColumn("altitude", R.solar_altitude("acq_ts", "lon", "lat"))
    if "zenith" not in pixels.columns:
        pixels = pixels.withColumn("zenith", 90.0 - F.col("altitude"))
    p = pixels.withColumns({
        "t713": F.col("b07") - F.col("b13"), "thermal": R.thermal_valid("roi", "b07", "b13", "b14"),
        "night": true(F.col("zenith") > t.night_zenith_deg), "visible": F.col("rvis").isNotNull(),
    })
    p = p.withColumn("valid", F.col("thermal") & (F.col("night") | F.col("visible")))
    p = p.withColumn("cloud", F.col("valid") & R.cloudy("b07", "b13", "b14", "rvis", "zenith", F.col("night"), t))
    return p.withColumn("clear", F.col("valid") & ~F.col("cloud"))


def seed(observed: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The columns ``day`` and ``night_hot``: the pixel is suspicious by day, or hot in absolute terms by night."""
    s = observed.withColumns(
        {
            "day": R.day_seed("b07", "b13", "rvis", F.col("clear") & F.col("visible"), t),
            "night_hot": R.night_seed("b07", "rvis", F.col("clear"), F.col("night"), t)
        }
    )
    if t.local_maximum_window > 1:
        s = local_maximum(s, "t713", t.local_maximum_window).withColumn(
            "day", F.col("day") & F.col("is_maximum")
        ).drop("is_maximum")
    return s


def local_maximum(pixels: DataFrame, value: str, window: int) -> DataFrame:
    """The column ``is_maximum``: no pixel of the square window exceeds this one. The maximum is separable, so two range
    windows (along rows, then columns) do; pixels beyond the edge or without a value do not count."""
    size = max(int(window), 1)
    if size % 2 == 0:
        raise ValueError("the window of a local maximum must be odd")
    if size == 1:
        return pixels.withColumn("is_maximum", F.col(value).isNotNull())
    r = size // 2
    along = Window.partitionBy("scene_id", "row").orderBy("col").rangeBetween(-r, r)
    across = Window.partitionBy("scene_id", "col").orderBy("row").rangeBetween(-r, r)
    p = pixels.withColumn("_top", F.max(value).over(along)).withColumn("_top", F.max("_top").over(across))
    return p.withColumn("is_maximum", true(F.col(value) >= F.col("_top"))).drop("_top")


#: Neighbours of seeds that are gathered at once.
GATHER = 1 << 21
STATISTICS = (
    "scene_id string, row int, col int, window int, n_valid long, n_clear long, n_used long, t7_bg double, t13_bg double, rvis_bg double, n_rvis long, t713_bg double, "
    "std_t7 double, std_t713 double, pv double, pc double"
)


def background(seeds: DataFrame, observed: DataFrame, t: Thresholds = Thresholds(), tile: int = 96) -> DataFrame:
    """Background statistics of each seed (scene_id, row, col) in its first window with enough clear pixels; seeds without
    one are left out.

    Valid pixels are sent, once per tile that needs them, to the tiles of ``tile`` rows and columns that hold a seed: a
    tile comes with a halo as wide as the largest window's half. A task lays a tile out as arrays and gathers the
    neighbours of its seeds window by window; a seed that a window decides takes no part in the larger ones. One shuffle,
    and a group is bounded by the tile, whatever the scene or the number of seeds.
    """
    reach = max(t.windows) // 2
    kinds = {c: seeds.schema[c].dataType.simpleString() for c in PIXEL}
    place = [F.floor(F.col(c) / tile).cast("int").alias(f"_t{c[0]}") for c in ("row", "col")]
    s = seeds.select(*PIXEL).dropDuplicates().select(
        F.col("scene_id").cast("string").alias("scene_id"), F.col("row").cast("int").alias("row"),
        F.col("col").cast("int").alias("col"), *place
    )
    tiles = s.select("scene_id", "_tr", "_tc").distinct()
    near = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    p = observed.filter("valid").select(
        F.col("scene_id").cast("string").alias("scene_id"), F.col("row").cast("int").alias("row"),
        F.col("col").cast("int").alias("col"),
        *[F.col(c).cast("double").alias(c) for c in ("b07", "b13", "rvis", "t713")],
        "cloud", "clear", true(F.col("non_vegetation")).alias("bare"), F.lit(False).alias("seed"),
    )
    p = p.withColumn("_tr", F.explode(near("row"))).withColumn("_tc", F.explode(near("col"))).withColumns(
        {c: F.col(c).cast("int") for c in ("_tr", "_tc")}
    )
    p = p.join(tiles, ["scene_id", "_tr", "_tc"], "left_semi")
    none = {
        c: F.lit(None).cast("double") for c in ("b07", "b13", "rvis", "t713")
    } | {c: F.lit(False) for c in ("cloud", "clear", "bare")} | {"seed": F.lit(True)}
    rows = p.unionByName(s.withColumns(none))

    def run(table: pa.Table) -> pa.Table:
        return _tile_statistics(table, t)

    found = rows.groupBy("scene_id", "_tr", "_tc").applyInArrow(run, STATISTICS)
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in PIXEL})


def _tile_statistics(table: pa.Table, t: Thresholds) -> pa.Table:
    """The statistics of one tile's seeds from the pixels around them."""
    reach = max(t.windows) // 2
    row, col, seed = (np.asarray(table[c]) for c in ("row", "col", "seed"))
    here = ~seed
    top, left = row[seed].min() - reach, col[seed].min() - reach
    height, width = row[seed].max() + reach + 1 - top, col[seed].max() + reach + 1 - left
    here &= (row >= top) & (row < top + height) & (col >= left) & (col < left + width)
    at = (row[here] - top) * width + col[here] - left
    layers = {}
    for name in ("b07", "b13", "rvis", "t713"):
        layers[name] = np.full(height * width, np.nan)
        layers[name][at] = table[name].to_numpy(zero_copy_only=False).astype(float)[here]
    for name in ("valid", "clear", "cloud", "bare"):
        layers[name] = np.zeros(height * width, dtype=bool)
        layers[name][at] = True if name == "valid" else table[name].to_numpy(zero_copy_only=False)[here]
    rows, cols = row[seed] - top, col[seed] - left
    open_, out = np.arange(len(rows)), []
    for window in t.windows:
        r = window // 2
        away = (np.arange(-r, r + 1)[:, None] * width + np.arange(-r, r + 1)).ravel()
        away = away[away != 0]
        left_open = []
        for k in range(0, len(open_), max(1, GATHER // len(away))):
            some = open_[k : k + max(1, GATHER // len(away))]
            x = {n: v[(rows[some] * width + cols[some])[:, None] + away] for n, v in layers.items()}
            stats, enough = _window_statistics(x, t)
            left_open.append(some[~enough])
            done = some[enough]
            out.append([row[seed][done], col[seed][done], np.full(len(done), window), *(v[enough] for v in stats)])
        open_ = np.concatenate(left_open) if left_open else open_
        if not len(open_):
            break
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 15
    schema = [pa.int32()] * 3 + [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int64()] + [pa.float64()] * 5
    scene = pa.array([table["scene_id"][0].as_py()] * len(columns[0]), pa.string())
    names = [f.split()[0] for f in STATISTICS.split(", ")]
    return pa.table([scene, *(pa.array(c).cast(k) for c, k in zip(columns, schema))], names=names)


def _window_statistics(x: dict[str, np.ndarray], t: Thresholds) -> tuple[list[np.ndarray], np.ndarray]:
    """(statistics of rows of neighbours, which rows have enough clear ones)."""
    n_valid, n_clear = x["valid"].sum(1), x["clear"].sum(1)
    ordered = np.sort(np.where(x["clear"], x["b07"], np.inf), axis=1)
    at = 0.8 * np.maximum(n_clear - 1, 0)  # linear between the ranks around it
    line, low, high = np.arange(len(ordered)), np.floor(at).astype(int), np.ceil(at).astype(int)
    with np.errstate(invalid="ignore"):
        p80 = ordered[line, low] + (at - low) * (ordered[line, high] - ordered[line, low])
        hot = (x["b07"] >= p80[:, None]) & (
            x["b07"] >= x["b13"] + np.nan_to_num(x["rvis"]) * t.suspicious_visible_factor + t.suspicious_offset_k
        )
    use = x["clear"] & ~hot
    n_used = use.sum(1)
    n = np.maximum(n_used, 1)

    def mean(v: np.ndarray) -> np.ndarray:
        return np.where(use, v, 0).sum(1) / n

    def deviation(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.sqrt((np.where(use, v - m[:, None], 0) ** 2).sum(1) / n)

    seen = use & ~np.isnan(x["rvis"])
    n_rvis = seen.sum(1)
    rvis = np.where(seen, x["rvis"], 0).sum(1) / np.maximum(n_rvis, 1)
    t7, t13, t713 = mean(x["b07"]), mean(x["b13"]), mean(x["t713"])
    std_t7 = np.maximum(deviation(x["b07"], t7), 0.5)
    std_t713 = np.clip(deviation(x["t713"], t713), t.min_std_t713_k, t.max_std_t713_k)
    valid = np.maximum(n_valid, 1)
    least = np.maximum(np.ceil(n_valid * t.min_valid_ratio), t.min_background_pixels)
    enough = (n_clear >= least) & (n_used >= least)
    return [
        n_valid, n_clear, n_used, t7, t13, rvis, n_rvis, t713, std_t7, std_t713, x["bare"].sum(1) / valid,
        x["cloud"].sum(1) / valid
    ], enough


STAGES = ("background", "dynamic", "cloud", "edge", "static")


def cascade(seeds: DataFrame, t: Thresholds = Thresholds(), rescue: Rescue = Rescue()) -> DataFrame:
    """Seeds with their background (null where there is none) and ``static`` get ``reject``: the first stage of the
    cascade that rejects them, null if none does; and factor, tier, score, excesses and confidence.

    The order counts: background, dynamic threshold, cloud, edge, static source. The edge test rejects only where both
    temperatures fail it.
    """
    r = rescue.normal()
    c = F.col
    s = seeds.withColumn("factor", R.dynamic_factor("altitude", "pv", "pc"))
    above = lambda f: true(
        (c("b07") > c("t7_bg") + f * c("std_t7")) & (c("t713") > c("t713_bg") + f * c("std_t713"))
    )
    s = s.withColumn("relative", above(c("factor"))).withColumn("rescue_factor", c("factor") * r.scale)
    s = s.withColumn("rescued", F.lit(r.enabled) & ~c("night_hot") & ~c("relative") & above(c("rescue_factor")))
    cloud = true(
        (c("n_rvis") > 0) & (c("rvis") >= c("rvis_bg") + t.cloud_visible_delta)
        & (c("b13") <= c("t13_bg") - t.cloud_t13_delta_k)
    )
    edge = F.when(c("rescued"), F.lit(r.edge_threshold_c)).otherwise(F.lit(t.edge_threshold_c))
    at_edge = true((c("b07") <= c("t7_bg") + edge * c("std_t7")) & (c("t713") <= c("t713_bg") + edge * c("std_t713")))
    reject = (
        F.when(c("window").isNull(), "background").when(
            ~c("night_hot") & ~c("relative") & ~c("rescued"), "dynamic"
        ).when(cloud, "cloud").when(at_edge, "edge").when(true(c("static")), "static")
    )
    s = s.withColumn("reject", reject).withColumn("tier", F.when(c("rescued"), "model-rescue").otherwise("strict"))
    e = R.evidence(
        "b07", "t713", "t7_bg", "std_t7", "t713_bg", "std_t713",
        F.when(c("rescued"), c("rescue_factor")).otherwise(c("factor")), "night_hot", t
    )
    s = s.withColumn("_e", e).select("*", "_e.score", "_e.t7_excess", "_e.t713_excess").drop("_e")
    return s.withColumn(
        "confidence", R.confidence("score", t.confidence_high, t.confidence_medium)
    ).withColumn("daynight", F.when(c("zenith") > t.night_zenith_deg, "N").otherwise("D"))


def limit_rescued(fires: DataFrame, rescue: Rescue, order: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Of each scene's rescued fires, those with the highest scores (a limit of the feature; 0: all)."""
    most = rescue.normal().most
    if most <= 0:
        return fires
    w = Window.partitionBy("scene_id", "tier").orderBy(F.desc("score"), *order)
    return fires.withColumn("_n", F.row_number().over(w)).filter(
        (F.col("tier") != "model-rescue") | (F.col("_n") <= most)
    ).drop("_n")


def judge(
    pixels: DataFrame, sources: DataFrame | None = None, polygons: DataFrame | None = None,
    t: Thresholds = Thresholds(), rescue: Rescue = Rescue()
) -> DataFrame:
    """All seeds of the pixels' scenes with their background, the stage that rejects them, and scores."""
    from emberframe.operators.spatial import near_sources, within_polygons

    t.checked()
    observed = observe(pixels, t)
    # few of the pixels; read by the background, the sources, the polygons and the result
    seeds = kept(seed(observed, t).filter(F.col("day") | F.col("night_hot")), "seeds")
    found = seeds.drop("pv", "pc").join(background(seeds, observed, t), list(PIXEL), "left")
    found = found.withColumn("_key", F.struct(*PIXEL))
    hits, places = None, seeds.select(
        F.struct(*PIXEL).alias("_key"), "lon", "lat"
    )  # without the background, which is costly
    if sources is not None:
        hits = near_sources(places, sources, "_key", t.thermal_source_radius_km)
    if polygons is not None:
        inside = within_polygons(places, polygons, "_key").select("_key")
        hits = inside.distinct() if hits is None else hits.unionByName(inside).distinct()
    found = found.withColumn("static", F.lit(False)) if hits is None else found.join(
        hits.withColumn("static", F.lit(True)), "_key", "left"
    ).withColumn("static", F.coalesce("static", F.lit(False)))
    return cascade(found.drop("_key"), t, rescue)


def stage_aggregates() -> list[Column]:
    """Aggregates over judged seeds: seeds, rejections by stage, accepted and rescued."""
    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    return [
        F.count("*").alias("seeds"), count(F.col("day")).alias("day_seeds"),
        count(F.col("night_hot")).alias("night_seeds"),
        *[count(F.col("reject") == s).alias(f"rejected_{s}") for s in STAGES],
        count(F.col("reject").isNull()).alias("accepted"),
        count(F.col("reject").isNull() & (F.col("tier") == "model-rescue")).alias("rescued"),
    ]


def stage_counts(judged: DataFrame) -> DataFrame:
    """Per scene: seeds, rejections by stage, accepted and rescued."""
    return judged.groupBy("scene_id").agg(*stage_aggregates())


def counted(judged: DataFrame, into: Observation | str) -> DataFrame:
    """``judged``, whose stages are counted by the pass that reads it, all scenes together, with the newest time: no second
    aggregation. A stream takes a name, and its progress has the counts (``streaming.metrics``)."""
    return judged.observe(into, *stage_aggregates(), F.max(F.unix_micros("acq_ts")).alias("newest_micros"))


def simple_detector(pixels: DataFrame, background_: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The older single-window detector: no seeds, masks for land, known heat and reflectance, day and night split at 85
    degrees, a missing reflectance as 0. ``background_`` gives t7_bg, std_t7, t713_bg, std_t713, pv, pc by pixel."""
    p = pixels.withColumn(
        "altitude", R.solar_altitude("acq_ts", "lon", "lat")
    ).withColumn("zenith", 90 - F.col("altitude"))
    p = p.withColumn("t713", F.col("b07") - F.col("b13")).withColumn("night", F.col("zenith") > 85)
    ok = true(F.col("roi")) & true(F.col("land")) & ~true(F.col("static_hot")) & ~true(
        F.col("high_reflectance")
    ) & ~R.cloudy_simple(
        "b07", "b13", "b14", "rvis", "zenith"
    )
    p = p.filter(ok).join(background_, list(PIXEL)).withColumn("factor", R.dynamic_factor("altitude", "pv", "pc"))
    hot = true(
        (F.col("b07") >= F.col("t7_bg") + F.col("factor") * F.col("std_t7"))
        & (F.col("t713") >= F.col("t713_bg") + F.col("factor") * F.col("std_t713"))
    )
    night_hot = F.col("night") & true(F.col("b07") > t.night_absolute_t7_k) & true(
        F.coalesce("rvis", F.lit(0.0)) < t.night_visible_max
    )
    p = p.filter(hot | night_hot).withColumn("night_hot", night_hot)
    return p.withColumn(
        "_e", R.evidence("b07", "t713", "t7_bg", "std_t7", "t713_bg", "std_t713", "factor", "night_hot", t)
    ).select("*", "_e.score").drop("_e").withColumn(
        "confidence", R.confidence("score", t.confidence_high, t.confidence_medium)
    )


def suppress(
    fires: DataFrame, radius: int = 2, key: str = "fire_id", order: tuple[Column, ...] | None = None
) -> DataFrame:
    """``fires`` that a greedy pass by falling score keeps: none within ``radius`` rows and columns of one kept before.
    Ties go to the lower row, column and key.

    A scene's fires come to one task in that order, and only the places kept so far are remembered: a cell as wide as the
    radius holds one at most, so a fire looks at nine cells. What a scene holds is bounded by its grid, not by the table.
    """
    order = order or (F.desc("score"), F.asc("row"), F.asc("col"), F.asc(key))
    names = [f"c{i}" for i in range(len(fires.columns))]
    scene, row, col = (fires.columns.index(c) for c in PIXEL)
    side = radius + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = object(), {}
        for batch in batches:
            keep = []
            for s, r, c in zip(*(batch.column(i).to_pylist() for i in (scene, row, col))):
                if s != now:
                    now, taken = s, {}
                a, b = r // side, c // side
                near = (taken.get((a + i, b + j)) for i in (-1, 0, 1) for j in (-1, 0, 1))
                free = not any(n and abs(n[0] - r) <= radius and abs(n[1] - c) <= radius for n in near)
                if free:
                    taken[a, b] = (r, c)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = fires.repartition("scene_id").sortWithinPartitions("scene_id", *order).toDF(*names)
    return ordered.mapInArrow(run, ordered.schema).toDF(*fires.columns)
