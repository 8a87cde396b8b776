"""Ranks within a scene, model scores by region, and budgets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.features import desert, urban
from emberframe.functions.radiometry import model_confidence


def rank_share(value: str, by: str = "scene_slot") -> Column:
    """Average rank of the value in its group as a share of the group; nulls have none."""
    at, same, whole = Window.partitionBy(by).orderBy(value), Window.partitionBy(by, value), Window.partitionBy(by)
    return F.when(
        F.col(value).isNotNull(),
        (F.rank().over(at) - F.count_if(F.col(value).isNull()).over(whole) + (F.count("*").over(same) - 1) / 2) / F.count(value).over(whole)
    )


def scene_rank_features(frame: DataFrame, by: str = "scene_slot") -> DataFrame:
    """Values relative to the scene, ranks, and flags of regions; a value that is not finite becomes 0."""
    w = Window.partitionBy(by)
    c = F.col
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    out = frame.withColumns({
        "bt07_to_scene_max": zero(c("max_bt07_k") / F.greatest(F.max("max_bt07_k").over(w), F.lit(1e-3))),
        "bt07_minus_scene_mean": zero(c("max_bt07_k") - F.avg("max_bt07_k").over(w)),
        "bt07_scene_rank_pct": zero(rank_share("max_bt07_k", by)),
        "t713_to_scene_max": zero(c("max_t713_k") / F.greatest(F.max("max_t713_k").over(w), F.lit(1e-3))),
        "t713_scene_rank_pct": zero(rank_share("max_t713_k", by)),
        "area_scene_rank_pct": zero(rank_share("cand_area", by)),
        "scene_candidate_count_log": F.log1p(F.count("*").over(w)),
        "desert_suppress": desert("center_lon", "center_lat").cast("int"),
        "urban_industrial_suppress": urban("center_lon", "center_lat").cast("int"),
    })
    return out.withColumns({
        "scene_peak_x_t713": c("bt07_to_scene_max") * c("t713_to_scene_max"),
        "thermal_rank_fuse": 0.7 * c("bt07_scene_rank_pct") + 0.3 * c("t713_scene_rank_pct"),
        "east_day_risk": (
            (c("center_lon") >= 115) & (c("day_phase") == "day") & (c("urban_industrial_suppress") == 1)
        ).cast("int"),
    })


@dataclass(frozen=True)
class Scorer:
    """Models by region and what follows from their probabilities."""

    west_lon_max: float = 105.0
    west_budget: int = 50
    east_budget: int = 50
    east_model: bool = False
    west_model_elsewhere: bool = False
    scale: float = 10.0
    high: float = 0.65
    medium: float = 0.35
    rescue_least: float = 0.35


def route(
    frame: DataFrame, s: Scorer = Scorer(), west_prob: str = "west_prob", east_prob: str = "east_prob"
) -> DataFrame:
    """Scores by region: the western model below ``west_lon_max``, else the eastern one if there is one, else the western
    one if it is to be used elsewhere, else the physical score stays. Adds region_for_scorer, model_prob, score_source,
    forced (an official confirmation is never dropped) and dropped (a rescued fire whose probability is too low)."""
    west = F.col("center_lon") < s.west_lon_max
    east = F.lit(s.east_model)
    prob = F.when(west, F.col(west_prob)).when(east, F.col(east_prob)).when(
        F.lit(s.west_model_elsewhere), F.col(west_prob)
    )
    out = frame.withColumn("physics_score", F.col("score")).withColumn("_p", prob)
    out = out.withColumns({
        "region_for_scorer": F.when(west, "west").when(east, "east").otherwise("elsewhere"),
        "score_source": F.when(
            west | (~east & F.lit(s.west_model_elsewhere)), "west-model"
        ).when(east, "east-model").otherwise("physics-rule"),
        "model_prob": F.round("_p", 6),
        "score": F.when(F.col("_p").isNotNull(), F.round(F.col("_p") * s.scale, 4)).otherwise(F.col("score")),
        "confidence": F.when(
            F.col("_p").isNotNull(), model_confidence("_p", s.high, s.medium)
        ).otherwise(F.col("confidence")),
        "forced": F.coalesce("official_confirmed", F.lit(False)),
    })
    drop = (
        F.coalesce("tier", F.lit("strict")) == "model-rescue"
    ) & ~F.col("forced") & (F.coalesce("model_prob", F.lit(0.0)) < s.rescue_least)
    return out.withColumn("dropped", drop).drop("_p")


def within_budget(
    routed: DataFrame, s: Scorer = Scorer(), by: tuple[str, ...] = ("scene_id",), order: tuple[str, ...] = ("fire_id",)
) -> DataFrame:
    """Without dropped fires and, per group and region with a model, without those beyond the region's budget: forced ones
    first, then by score; every forced one stays, even beyond the budget. A budget not above 0 keeps all."""
    alive = routed.filter(~F.col("dropped"))
    w = Window.partitionBy(*by, "region_for_scorer").orderBy(F.desc("forced"), F.desc("score"), *order)
    budget = F.when(
        F.col("region_for_scorer") == "west", s.west_budget
    ).when(F.col("region_for_scorer") == "east", s.east_budget).otherwise(0)
    ranked = alive.withColumn("_n", F.row_number().over(w)).withColumn("_b", budget)
    return ranked.filter((F.col("_b") <= 0) | (F.col("_n") <= F.col("_b")) | F.col("forced")).drop("_n", "_b")


def top_budget(fires: DataFrame, budget: int, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The ``budget`` best of each group (forced, then score), and every forced one."""
    w = Window.partitionBy(*by).orderBy(F.desc("forced"), F.desc("score"), *order)
    return fires.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= budget) | F.col("forced")).drop("_n")


#: What the scorer adds to a fire besides its score and confidence.
CARRIED = ("model_prob", "physics_score", "score_source", "region_for_scorer")


def sync_scores(pixels: DataFrame, scored: DataFrame, west_lon_max: float = 105.0) -> DataFrame:
    """Pixels take score, confidence and what the scorer says about it (``CARRIED``) of the scored fire at the same place
    (rounded to 6 digits) and pixel; others keep theirs. Western pixels without one are dropped unless they are confirmed."""
    key = lambda d: d.withColumns({"_x": F.round("lon", 6), "_y": F.round("lat", 6)})
    carried = [c for c in CARRIED if c in scored.columns]
    s = key(scored).select(
        "scene_id", "_x", "_y", "row", "col", F.struct("score", "confidence", *carried).alias("_s")
    )
    out = key(pixels.drop(*carried)).join(s, ["scene_id", "_x", "_y", "row", "col"], "left")
    out = out.filter(
        F.col("_s").isNotNull() | (F.col("lon") >= west_lon_max) | F.coalesce("official_confirmed", F.lit(False))
    )
    return out.withColumns(
        {c: F.coalesce(f"_s.{c}", c) for c in ("score", "confidence")} | {c: F.col(f"_s.{c}") for c in carried}
    ).drop("_x", "_y", "_s")


def score_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many fires were scored, kept and dropped, by region."""
    a = before.agg(
        F.count("*").alias("scored"), F.count_if(F.col("region_for_scorer") == "west").alias("west"),
        F.count_if(F.col("tier") == "model-rescue").alias("rescued"), F.count_if("dropped").alias("rescue_dropped")
    )
    b = after.agg(
        F.count("*").alias("kept"), F.count_if(F.col("region_for_scorer") == "west").alias("kept_west"),
        F.count_if(F.col("region_for_scorer") != "west").alias("kept_elsewhere")
    )
    return a.crossJoin(b)  # one row each


def in_order(fires: DataFrame) -> DataFrame:
    """Fires as they are published: by falling score, then from north to south and from east to west."""
    return fires.orderBy(F.desc("score"), F.desc("lat"), F.desc("lon"))


def confidence_counts(fires: DataFrame, by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Fires by confidence; only high, medium and low count."""
    return fires.groupBy(*by).agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")])


def custom_step(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a step of the user's own on a table; its result must be a table."""
    out = step(df)
    if not isinstance(out, DataFrame):
        raise TypeError("a step must return a DataFrame")
    return out
