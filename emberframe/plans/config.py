"""Settings of the dataflows from JSON files: names in camel case become the fields' names."""

from __future__ import annotations

import json
import re
from dataclasses import fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.radiometry import Rescue, Thresholds
from emberframe.operators import catalog
from emberframe.operators.ranking import Scorer
from emberframe.plans.scene import SceneConfig

# Names in files that differ from the fields' names.
OTHER = {
    "confidenceMediumScore": "confidence_medium", "confidenceHighScore": "confidence_high",
    "dynamicFactorScale": "scale", "maxCandidatesPerScene": "most", "mideastBudget": "east_budget",
    "mideastEnabled": "east_model", "applyToNonWest": "west_model_elsewhere", "scoreScale": "scale",
    "confidenceHighProb": "high", "confidenceMediumProb": "medium", "rescueMinProbability": "rescue_least",
    "gridDeg": "grid_degrees", "temporalKeepSlots": "keep_slots", "spatialMatchKm": "match_km",
    "timeWindowHours": "match_hours"
}


# The region of interest where a file names none.
ROI = {"minLon": 73.0, "minLat": 18.0, "maxLon": 135.5, "maxLat": 54.0}


def load(path: str) -> dict[str, Any]:
    """A file's settings; anything but an object is refused."""
    with open(path, encoding="utf-8-sig") as file:
        found = json.load(file)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    return found


def field_name(name: str) -> str:
    return OTHER.get(name) or re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def settings(default: Any, given: dict[str, Any] | None) -> Any:
    """``default`` (a dataclass) with the values that ``given`` names; names that are no field are left out."""
    known = {f.name for f in fields(default)}
    named = {field_name(k): tuple(v) if isinstance(v, list) else v for k, v in (given or {}).items() if v is not None}
    return replace(default, **{k: v for k, v in named.items() if k in known})


def scene_config(given: dict[str, Any]) -> SceneConfig:
    """The settings of ``scene.detect`` from a file's ``thresholds``, ``candidateRescue``, ``v15Scorer`` and
    ``officialFusion``, checked. Models are read by ``with_models``."""
    thresholds = settings(Thresholds(), given.get("thresholds"))
    scorer, fusion = given.get("v15Scorer") or {}, given.get("officialFusion") or {}
    c = SceneConfig(
        thresholds=thresholds.checked(), rescue=settings(Rescue(), given.get("candidateRescue")).normal(),
        scorer=settings(Scorer(), scorer), fail_open=bool(scorer.get("failOpen", False)),
        fuse=fusion.get("enabled", True) is not False
    )
    places = {k: v for k, v in (scorer | fusion).items() if k in ("gridDeg", "temporalKeepSlots", "spatialMatchKm", "timeWindowHours")}
    return settings(c, places)


def with_models(spark: SparkSession, c: SceneConfig, given: dict[str, Any]) -> SceneConfig:
    """``c`` with the texts of the models that ``v15Scorer`` names, read by Spark; none where the scorer is off. Without a
    readable eastern model, eastern fires keep their physical scores; without a readable western one, it is an error,
    unless ``failOpen``."""
    scorer = given.get("v15Scorer") or {}
    if scorer.get("enabled", True) is False:
        return replace(c, west_model=None, east_model=None)

    def text(name: str) -> str | None:
        path = scorer.get(name)
        return spark.read.text(path, wholetext=True).first()["value"] if path else None

    east = None
    if scorer.get("mideastEnabled"):
        try:
            east = text("mideastModelPath")
        except Exception:  # noqa: BLE001  absent or unreadable
            east = None
    try:
        west = text("modelPath")
    except Exception:  # noqa: BLE001
        if not c.fail_open:
            raise
        west = None
    return replace(c, west_model=west, east_model=east, scorer=replace(c.scorer or Scorer(), east_model=east is not None))


def accepted_references(references: DataFrame, at: Column, given: dict[str, Any]) -> DataFrame:
    """``references`` that ``officialFusion`` and ``roi`` accept around the time ``at``; none where fusion is off."""
    fusion, roi = given.get("officialFusion") or {}, given.get("roi") or {}
    if fusion.get("enabled", True) is False:
        return references.filter(F.lit(False))
    box = tuple(float(roi.get(k, v)) for k, v in ROI.items())
    words = [str(w).strip().lower() for w in fusion.get("acceptedViirsConfidence", ("nominal", "high", "n", "h"))]
    return catalog.accepted_references(
        references, box, at, float(fusion.get("timeWindowHours", 3.0)), tuple(words),
        float(fusion.get("minModisConfidence", 30.0))
    )
