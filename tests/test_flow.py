"""The online flow with a model, against the same flow in plain Python; its settings from a file."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from emberframe.functions.radiometry import Thresholds
from emberframe.operators import pixels, ranking
from emberframe.operators.ranking import Scorer
from emberframe.plans import config, scene

AT = dt.datetime(2026, 1, 1, 4, tzinfo=dt.timezone.utc)
T = Thresholds(night_absolute_t7_k=360.0)
PIXEL = "scene_id string, row int, col int, lon double, lat double, acq_ts timestamp, b07 double, b13 double, b14 double, rvis double, roi boolean, non_vegetation boolean, altitude double, zenith double"
REF = "id string, sensor string, lon double, lat double, acq_ts timestamp, confidence string, frp double, scan_km double, track_km double"
SPLIT, LOW, HIGH = 341.0, -2.0, 1.5
MODEL = f"""tree
version=v4
objective=binary sigmoid:1
feature_names=bt07_level unused

Tree=0
num_leaves=2
split_feature=0
threshold={SPLIT}
decision_type=2
left_child=-1
right_child=-2
leaf_value={LOW} {HIGH}

end of trees
"""
#: (row, column): temperature. The region ends east of column 15; two scenes have the same pixels.
HOT = {
    (4, 4): 340.0, (4, 5): 345.0, (5, 6): 343.0, (20, 5): 350.0, (20, 6): 342.0, (12, 3): 344.0, (8, 20): 340.0, (8, 21): 346.0,
    (9, 22): 339.0, (22, 25): 338.0
}


def frame(spark, number=False):
    rows = []
    for s in (202601010400, 202601010410):
        for r in range(30):
            for c in range(30):
                b07 = HOT.get((r, c))
                rows.append((
                    str(s), r, c, round(104.85 + c * 0.01, 6), round(30 + r * 0.01, 6), AT, b07 or 300.0, 292.0 if b07 else 290.0,
                    290.0 if b07 else 289.0, 0.2, True, False, 45.0, 45.0
                ))
    out = spark.createDataFrame(rows, PIXEL)
    return out.withColumn("scene_id", F.col("scene_id").cast("long")) if number else out


def refs(spark):
    # confirms the fires around (4, 4), within 4 km
    return spark.createDataFrame([("r", "VIIRS", 104.885, 30.04, AT, "n", 5.0, 0.4, 0.4), ("q", "VIIRS", 110.0, 40.0, AT, "n", 5.0, 0.4, 0.4)], REF)


def km(lon, lat, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat) / 2) ** 2
    a += math.cos(math.radians(lat)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(a))


def expected(judged, budget, confirmed):
    """(selected, pixels: score and probability, areas) of one scene by row and column."""
    physics = {(j["row"], j["col"]): j["score"] for j in judged if j["reject"] is None}
    lon = lambda c: 104.85 + c * 0.01
    kept = []
    for p in sorted(physics, key=lambda p: (-physics[p], p)):
        if not any(max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 2 for q in kept):
            kept.append(p)
    sure = {p for p in physics if confirmed and km(lon(p[1]), 30 + p[0] * 0.01, 104.885, 30.04) <= 4}
    prob = {p: 1 / (1 + math.exp(-(HIGH if HOT[p] > SPLIT else LOW))) for p in kept if lon(p[1]) < 105}
    score = {p: round(prob[p] * 10, 4) if p in prob else physics[p] for p in kept}
    west = sorted(prob, key=lambda p: (p not in sure, -score[p], p))
    selected = {p for k, p in enumerate(west) if k < budget or p in sure} | {p for p in kept if p not in prob}
    pixels = {}
    for p in physics:
        if p in selected:
            pixels[p] = (score[p], round(prob[p], 6) if p in prob else None)
        elif lon(p[1]) >= 105 or p in sure:
            pixels[p] = (physics[p], None)
    left, areas = set(pixels), {}
    while left:
        group, todo = set(), [min(left)]
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                group.add(p)
                todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if len(group) > 1:
            w = {p: max(pixels[p][0], 0) + 1 for p in group}
            step_km = [
                (km(lon(c) - 0.005, 30 + r * 0.01 - 0.005, lon(c) + 0.005, 30 + r * 0.01 - 0.005)
                 + km(lon(c) - 0.005, 30 + r * 0.01 + 0.005, lon(c) + 0.005, 30 + r * 0.01 + 0.005)) / 2
                * km(lon(c), 30 + r * 0.01 - 0.005, lon(c), 30 + r * 0.01 + 0.005) for r, c in group
            ]
            probs = [pixels[p][1] for p in group if pixels[p][1] is not None]
            areas[min(group)] = (
                len(group), max(pixels[p][0] for p in group), sum(pixels[p][0] for p in group) / len(group), sum(step_km),
                sum(lon(p[1]) * w[p] for p in group) / sum(w.values()), max(probs, default=None), bool(group & sure)
            )
    return selected, pixels, areas


@pytest.mark.parametrize("budget,confirmed,number", [(50, True, False), (2, True, True), (1, False, False)])
def test_scores_go_back_to_pixels_and_areas(spark, budget, confirmed, number):
    c = scene.SceneConfig(thresholds=T, west_model=MODEL, scorer=Scorer(west_budget=budget))
    out = scene.detect(frame(spark, number), references=refs(spark) if confirmed else None, c=c)
    judged, fires, selected, areas = (t.collect() for t in (out.judged, out.fires, out.selected, out.areas))
    for s in ("202601010400", "202601010410"):
        mine = lambda rows: [r for r in rows if str(r["scene_id"]) == s]  # noqa: B023,E731
        want, pixels, groups = expected(mine(judged), budget, confirmed)
        assert {(r["row"], r["col"]) for r in mine(selected)} == want
        assert {(r["row"], r["col"]): (pytest.approx(r["score"]), r["model_prob"]) for r in mine(fires)} == pixels
        assert {(12, 3), (20, 6)} - set(pixels), "no western pixel was dropped"
        got = {tuple(map(int, r["cluster_id"].split("-")[1:])): r for r in mine(areas)}
        assert got.keys() == groups.keys() and len(got) >= 1
        for at, (n, top, mean, area, lon, prob, sure) in groups.items():
            r = got[at]
            assert (r["pixel_count"], r["max_score"], r["official_confirmed"]) == (n, pytest.approx(top), sure)
            assert r["mean_score"] == pytest.approx(mean, abs=1e-4) and r["centroid_lon"] == pytest.approx(lon, abs=1e-6)
            assert r["area_km2"] == pytest.approx(area, rel=1e-3) and len(r["rings"]) == n and len(r["rings"][0]) == 5
            assert r["max_model_prob"] == prob and r["cluster_status"] == ("confirmed" if sure else "suspected")
    assert out.state.count() > 0 and out.scorer_error is None
    if confirmed:
        assert {r["id"]: (r["matched"], r["width_km"]) for r in out.ranges.collect()} == {"r": (True, 0.4), "q": (False, 0.4)}


def test_failing_scorer(spark):
    c = scene.SceneConfig(thresholds=T, west_model="tree\nfeature_names=a\nTree=0\nnum_leaves=2\n")
    with pytest.raises(Exception):
        scene.detect(frame(spark), c=c)
    out = scene.detect(frame(spark), c=scene.SceneConfig(thresholds=T, west_model=c.west_model, fail_open=True))
    assert out.scorer_error and out.state is None
    plain = scene.detect(frame(spark), c=scene.SceneConfig(thresholds=T))
    key = lambda d: {(r["scene_id"], r["row"], r["col"], r["score"]) for r in d.collect()}
    assert key(out.selected) == key(plain.selected)
    # western fires that suppression left out go, as with a scorer; eastern ones stay
    assert key(out.fires) == {
        q for q in key(plain.fires) if q in key(plain.selected) or 104.85 + q[2] * 0.01 >= 105
    }


def test_scorer_fusion_and_models_from_a_file(spark, tmp_path):
    (tmp_path / "west.txt").write_text(MODEL)
    given = {
        "v15Scorer": {
            "modelPath": str(tmp_path / "west.txt"), "westBudget": 7, "mideastEnabled": True, "mideastBudget": 9,
            "mideastModelPath": str(tmp_path / "none.txt"), "applyToNonWest": True, "scoreScale": 5.0, "westLonMax": 101.5,
            "confidenceHighProb": 0.7, "rescueMinProbability": 0.2, "gridDeg": 0.1, "temporalKeepSlots": 12, "failOpen": True
        },
        "officialFusion": {"timeWindowHours": 2, "spatialMatchKm": 1.5, "minModisConfidence": 40, "acceptedViirsConfidence": ["H"]},
        "roi": {"minLon": 100, "maxLon": 106}
    }
    (tmp_path / "c.json").write_text(json.dumps(given))
    given = config.load(str(tmp_path / "c.json"))
    c = config.with_models(spark, config.scene_config(given), given)
    assert c.west_model == MODEL and c.east_model is None and not c.scorer.east_model and c.fail_open and c.fuse
    assert (c.scorer.west_budget, c.scorer.east_budget, c.scorer.west_model_elsewhere, c.scorer.scale) == (7, 9, True, 5.0)
    assert (c.scorer.west_lon_max, c.scorer.high, c.scorer.rescue_least) == (101.5, 0.7, 0.2)
    assert (c.grid_degrees, c.keep_slots, c.match_km, c.match_hours) == (0.1, 12, 1.5, 2)
    rows = [
        ("a", "VIIRS", 105.0, 30.0, AT, "h", "0"), ("b", "VIIRS", 105.0, 30.0, AT, "n", "0"), ("c", "MODIS", 105.0, 30.0, AT, "45", "0"),
        ("d", "MODIS", 105.0, 30.0, AT, "35", "0"), ("e", "VIIRS", 107.0, 30.0, AT, "h", "0"),
        ("f", "VIIRS", 105.0, 30.0, AT + dt.timedelta(hours=2.1), "h", None), ("g", "VIIRS", 105.0, 30.0, AT, "h", "2")
    ]
    r = spark.createDataFrame(rows, "id string, sensor string, lon double, lat double, acq_ts timestamp, confidence string, fire_type string")
    accepted = lambda g: {q["id"] for q in config.accepted_references(r, F.lit(AT), g).collect()}
    assert accepted(given) == {"a", "c"} and accepted(given | {"officialFusion": {"enabled": False}}) == set()
    with pytest.raises(Exception):
        config.with_models(spark, scene.SceneConfig(), {"v15Scorer": {"modelPath": str(tmp_path / "none.txt")}})
    assert config.with_models(spark, c, {"v15Scorer": {"enabled": False}}).west_model is None


def test_stages_are_counted_in_the_pass(spark):
    out = scene.detect(frame(spark), c=scene.SceneConfig(thresholds=T))
    per = pixels.stage_counts(out.judged).drop("scene_id")
    want = {c: sum(r[c] for r in per.collect()) for c in per.columns}
    assert {c: out.counts[c] for c in per.columns} == want and want["seeds"] == 2 * len(HOT)
    assert out.counts["newest_micros"] == AT.timestamp() * 1e6


def test_progress_of_a_stream_has_the_counts(spark, tmp_path):
    import os
    import time

    from emberframe.streaming import metrics

    schema = "scene_id string, acq_ts timestamp, day boolean, night_hot boolean, reject string, tier string"
    late = dt.datetime.now(dt.timezone.utc) - dt.timedelta(minutes=90)
    fresh = dt.datetime.now(dt.timezone.utc)
    parts = [
        [("a", late, True, False, None, "strict"), ("a", late, True, False, "cloud", "strict")],
        [("b", fresh, False, True, None, "model-rescue"), ("c", late, True, None, "edge", "strict")]
    ]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (file,) = (tmp_path / f"p{k}").glob("*.parquet")
        os.utime(file.rename(tmp_path / "in" / f"{k}.parquet"), (1e9 + k, 1e9 + k))
    listener = metrics.StageListener(limit_minutes=45)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        pixels.counted(stream, "stages").writeStream.foreachBatch(lambda b, _: b.count() and None).option(
            "checkpointLocation", str(tmp_path / "c")
        ).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if len(listener.batches) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    first, second = listener.batches
    assert (first["seeds"], first["rejected_cloud"], first["accepted"], first["stale"]) == (2, 1, 1, True)
    assert 89 < first["age_minutes"] < 100 and (second["night_seeds"], second["rescued"], second["stale"]) == (1, 1, False)
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    per = pixels.stage_counts(whole).drop("scene_id")
    assert {c: sum(r[c] for r in per.collect()) for c in per.columns} == {c: first[c] + second[c] for c in per.columns}


def test_order_of_publication_and_steps_of_ones_own(spark):
    rows = [(1, 5.0, 10.0, 3.0), (2, 7.0, 10.0, 3.0), (3, 5.0, 11.0, 3.0), (4, 5.0, 10.0, 4.0)]
    df = spark.createDataFrame(rows, "id int, score double, lat double, lon double")
    assert [r["id"] for r in ranking.in_order(df).collect()] == [2, 3, 4, 1]
    assert ranking.custom_step(df, lambda d: d.filter("id > 2")).count() == 2
    with pytest.raises(TypeError):
        ranking.custom_step(df, lambda d: d.collect())


def test_summary_is_written_as_lines(spark, tmp_path):
    from emberframe.sources import sinks

    out = scene.detect(frame(spark), c=scene.SceneConfig(thresholds=T))
    per = pixels.stage_counts(out.judged)
    sinks.write_summary(per, str(tmp_path / "s"))
    assert sorted(map(str, spark.read.schema(per.schema).json(str(tmp_path / "s")).collect())) == sorted(map(str, per.collect()))
