"""Whole dataflows: an online scene, a replay of history, a validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from emberframe.functions.features import base_features, candidate_frame, slot_ordinal
from emberframe.functions.radiometry import Rescue, Thresholds
from emberframe.operators import clusters, pixels, ranking, spatial, temporal
from emberframe.operators.tables import kept


@dataclass(frozen=True)
class SceneConfig:
    thresholds: Thresholds = field(default_factory=Thresholds)
    rescue: Rescue = field(default_factory=Rescue)
    scorer: ranking.Scorer | None = None
    west_model: str | None = None
    east_model: str | None = None
    match_km: float = 4.0
    match_hours: float = 3.0
    suppress_radius: int = 2
    grid_degrees: float = 0.05
    keep_slots: int = 400
    #: Drop eastern fires when the eastern model is wanted but absent, as some deployments do; by default they stay.
    drop_unscored_east: bool = False
    #: Keep the physical scores where the scorer fails, instead of failing with it.
    fail_open: bool = False
    #: Use official detections where there are any.
    fuse: bool = True


@dataclass
class SceneResult:
    """All seeds with what became of them; the fires among them, with scores as published; those that stay after suppression
    and budgets; areas of connected fires; the grid state; the official detections with what matched them; why the
    scorer failed, if it did; and how many seeds each stage rejected."""

    judged: DataFrame
    fires: DataFrame
    selected: DataFrame
    areas: DataFrame
    state: DataFrame | None = None
    ranges: DataFrame | None = None
    scorer_error: str | None = None
    #: ``pixels.counted`` over all scenes.
    counts: dict | None = None


def fire_rows(judged: DataFrame) -> DataFrame:
    """Accepted seeds as fires, with an id from scene, row and column."""
    f = judged.filter(F.col("reject").isNull())
    key = F.concat_ws(
        "-", "scene_id", F.lpad(F.col("row").cast("string"), 6, "0"), F.lpad(F.col("col").cast("string"), 6, "0")
    )
    return f.withColumns({"fire_id": key, "bt_tir": F.round("b07", 2), "bt_dif": F.round("t713", 2)})


def detect(
    frame: DataFrame, sources: DataFrame | None = None, boundary: DataFrame | None = None,
    references: DataFrame | None = None, state: DataFrame | None = None, c: SceneConfig = SceneConfig()
) -> SceneResult:
    """Pixels to fires: cascade, rescue limit, boundary, official detections, suppression, model scores and budget, areas.

    Scores go back to the fires that suppression left out: those at a scored place take its score, western ones without
    one are dropped unless confirmed. Areas are formed of what is left, with the rings of their pixels. A scorer that fails
    ends the run unless ``fail_open``; then fires keep their physical scores, and the result says why."""
    seen = Observation("stages")
    judged = kept(pixels.counted(pixels.judge(frame, sources, None, c.thresholds, c.rescue), seen), "judged")
    fires = pixels.limit_rescued(fire_rows(judged), c.rescue)
    if boundary is not None:
        fires = spatial.clip(fires, boundary, "fire_id").filter("accepted").drop("accepted")
    if references is not None and c.fuse:
        fires = spatial.nearest_reference(fires, references, c.match_km, c.match_hours)
        fires = fires.withColumn(
            "confidence", F.when(F.col("official_confirmed"), "official").otherwise(F.col("confidence"))
        )
    else:
        fires = fires.withColumn("official_confirmed", F.lit(False))
    fires = kept(fires, "fires")
    selected, error = pixels.suppress(fires, c.suppress_radius), None
    if c.west_model is not None:
        try:
            selected, state = score(selected, state, c)
            selected = kept(selected, "selected")
        except Exception as failure:  # noqa: BLE001  the policy of the caller
            if not c.fail_open:
                raise
            error = str(failure).split("\n")[0]
        fires = ranking.sync_scores(fires, selected, (c.scorer or ranking.Scorer()).west_lon_max)
    fires = kept(clusters.footprints(fires, frame), "footprints")
    ranges = spatial.official_ranges(references, fires) if references is not None and c.fuse else None
    return SceneResult(judged, fires, selected, clusters.fire_clusters(fires), state, ranges, error, dict(seen.get))


def score(fires: DataFrame, state: DataFrame | None, c: SceneConfig) -> tuple[DataFrame, DataFrame]:
    """Fires with model scores within their budgets, and the grid state with the scene merged in."""
    from emberframe.plans.model import probability

    f = base_features(candidate_frame(fires)).withColumn("slot_ord", slot_ordinal("scene_slot"))
    f = ranking.scene_rank_features(f)
    new = temporal.grid_state(f, c.grid_degrees)
    state = temporal.latest_slots(new if state is None else temporal.merge_state(state, new), c.keep_slots)
    state = kept(state, "state")
    f = temporal.neighbour_features(
        temporal.lag_features(f, state, "fire_id", degrees=c.grid_degrees), state, "fire_id", c.grid_degrees
    )
    s = c.scorer or ranking.Scorer()
    f = f.withColumn("west_prob", probability(c.west_model, f.columns))
    f = f.withColumn("east_prob", probability(c.east_model, f.columns) if c.east_model else F.lit(None).cast("double"))
    routed = kept(ranking.route(f, s), "routed")
    if s.east_model and c.east_model is None:
        routed = routed.filter(F.col("region_for_scorer") == "west") if c.drop_unscored_east else routed
    return ranking.within_budget(routed, s), state


def replay(frame: DataFrame, done: DataFrame, c: SceneConfig = SceneConfig(), **tables: DataFrame) -> SceneResult:
    """Detection on all scenes that ``done`` (acq_ts) does not list; scenes are independent, so they run together."""
    from emberframe.operators.catalog import unprocessed

    return detect(unprocessed(frame, done), c=c, **tables)
