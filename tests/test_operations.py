"""Summaries, sources, settings, masks, forecasts, outputs, late events: on small cases with known results."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from emberframe.functions import names, weather
from emberframe.operators import catalog, evaluation, pixels, summaries
from emberframe.plans import config
from emberframe.sources import readers, registry, sinks
from emberframe.streaming import scenes
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def test_run_summary_counts_scenes_without_fires(spark):
    judged = spark.createDataFrame(
        [
            ("a", True, False, None, "strict"), ("a", True, False, "cloud", "strict"),
            ("b", True, False, "edge", "strict")
        ],
        "scene_id string, day boolean, night_hot boolean, reject string, tier string"
    )
    fires = spark.createDataFrame(
        [("a", True, "high")], "scene_id string, official_confirmed boolean, confidence string"
    )
    ranges = spark.createDataFrame([(1, True), (2, False)], "id int, matched boolean")
    areas = spark.createDataFrame([("a", 3)], "scene_id string, pixel_count int")
    got = {q["scene_id"]: q for q in summaries.run_summary(judged, fires, areas, ranges).collect()}
    assert (
        got["a"]["seeds"], got["a"]["rejected_cloud"], got["a"]["fire_pixel_count"],
        got["a"]["official_confirmed_pixel_count"], got["a"]["high"], got["a"]["fire_cluster_count"]
    ) == (2, 1, 1, 1, 1, 1)
    assert (
        got["b"]["fire_pixel_count"], got["b"]["rejected_edge"], got["b"]["official_reference_count"],
        got["b"]["official_matched_count"]
    ) == (0, 1, 2, 1)


def test_interference_summary_of_nothing(spark):
    plants = spark.createDataFrame([(10.0,), (2.345,)], "capacity_mw double")
    hits = spark.createDataFrame([("2026-01-02",), ("2026-01-01",)], "acq_date string")
    (q,) = summaries.interference_summary(plants, hits, hits.limit(1), plants).collect()
    assert (
        q["plant_count"], q["total_capacity_mw"], q["hit_count"], q["first_date"], q["last_date"],
        q["persistent_count"], q["automatic_count"]
    ) == (2, 12.35, 2, "2026-01-01", "2026-01-02", 1, 4)
    (q,) = summaries.interference_summary(plants.limit(0), hits.limit(0), hits.limit(0), plants.limit(0)).collect()
    assert (q["plant_count"], q["total_capacity_mw"], q["first_date"], q["automatic_count"]) == (0, 0.0, None, 0)


def test_outputs_overlays_and_partial_keys(spark):
    outputs = spark.createDataFrame(
        [("fires", 0, True), ("grid", 1, False), ("extra", 2, False)], "output string, order int, required boolean"
    )
    files = spark.createDataFrame([("fires", "a"), ("extra", "a"), ("extra", "b")], "output string, path string")
    assert {
        (q["output"], q["path"]) for q in catalog.collected_outputs(files, outputs).collect()
    } == {("fires", "a"), ("extra", "b")}
    with pytest.raises(Exception, match="no file of the output fires"):
        catalog.collected_outputs(files.filter("output <> 'fires'"), outputs).collect()
    overlays = spark.createDataFrame(
        [("s", "t", "x/y\\z.tif", None, None), ("u", "t", "x/k.tif", "w", "d")],
        "source_id string, type string, local_path string, web_path string, description string"
    )
    latest = spark.createDataFrame(
        [("x/k.tif", "second", "v", 1), ("x/k.tif", "first", None, 0)],
        "local_path string, file_name string, web_path string, place int"
    )
    assert {
        tuple(q) for q in catalog.resolved_overlays(overlays, latest).collect()
    } == {("s", "t", "z.tif", None, ""), ("u", "t", "first", "w", "d")}
    rows = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "path string")
    assert catalog.repeated_keys(rows, ["path"]).count() == 2
    assert [tuple(q) for q in catalog.repeated_keys(rows, ["path"], partial=True).collect()] == [("a", 2)]


def test_masks_of_rasters_and_polygons(spark, tmp_path):
    grid = spark.createDataFrame(
        [("s", r, c, 100 + c * 1.0, 30 + r * 1.0) for r in range(2) for c in range(2)],
        "scene_id string, row int, col int, lon double, lat double"
    )
    np.save(tmp_path / "m.npy", np.array([[0, 2], [0, np.nan]], dtype=np.float32))
    marked = lambda path: {
        (q["row"], q["col"]) for q in readers.support_mask(spark, str(path), grid).filter("masked").collect()
    }
    assert marked(tmp_path / "m.npy") == {(0, 1), (1, 1)}
    ring = [[99.5, 29.5], [100.5, 29.5], [100.5, 30.5], [99.5, 30.5]]
    (tmp_path / "p.geojson").write_text(
        json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {}}]})
    )
    assert marked(tmp_path / "p.geojson") == {(0, 0)}
    (tmp_path / "none.geojson").write_text(json.dumps({"features": []}))
    for name in ("none.geojson", "m.tif"):
        with pytest.raises(ValueError):
            readers.support_mask(spark, str(tmp_path / name), grid)


def test_forecast_answers(spark, tmp_path):
    whole = {
        "ts": [1000, 2000.0, 3000], "units": {"temp-surface": "K"}, "temp-surface": [273.15, None, 283.15],
        "rh-surface": [10, 20, 30], "warning": "w"
    }
    lines = [
        {"lat": 1.0, "lon": 2.0, "payload": json.dumps(whole)}, {"lat": 3.0, "lon": 2.0, "payload": "no json"},
        {"lat": 5.0, "lon": 2.0, "payload": '{"ts": []}'}, {"lat": 7.0, "lon": 179.5, "payload": '{"ts": [5000]}'}
    ]
    (tmp_path / "answers.json").write_text("\n".join(map(json.dumps, lines)))
    points = readers.forecast_points(spark, str(tmp_path / "answers.json"))
    got = {q["lat"]: q for q in weather.forecast_cells(points, F.lit(2500), 2.0, 2.0).collect()}
    assert got.keys() == {1.0, 7.0}
    assert got[1.0]["temp_c"] == 10.0 and got[1.0]["rh_pct"] == 30.0 and got[1.0]["forecast_ts"].timestamp() == 3
    assert got[7.0]["temp_c"] is None and got[7.0]["ring"][1]["x"] == 180.5
    assert {q["lat"]: q["temp_c"] for q in weather.forecast_cells(points, F.lit(9000), 2.0, 2.0).collect()}[1.0] == 10.0


def test_sources_fall_back_to_the_last_good_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    sources = [
        {"id": "a", "kind": "csv", "path": str(tmp_path / "a.csv")},
        {"id": "b", "kind": "csv", "path": str(tmp_path / "missing.csv")}, {"id": "c", "kind": "tape", "path": ""},
        {"id": "d", "kind": "csv", "path": "", "enabled": False}
    ]
    before = spark.createDataFrame([("b", "csv", "ok", "", "old.csv", 7)], registry.ENTRY)
    tables, entries = registry.sync(spark, sources, before)
    got = {q["source_id"]: q for q in entries.collect()}
    assert got.keys() == {"a", "b", "c"} and tables.keys() == {"a"} and tables["a"].count() == 2
    assert (got["a"]["status"], got["a"]["rows"]) == ("ok", 2)
    assert (
        got["b"]["status"], got["b"]["path"], got["b"]["rows"]
    ) == ("error", "old.csv", 7) and got["b"]["message"].endswith("(the last good files stay)")
    assert got["c"]["path"] is None and "tape" in got["c"]["message"]
    assert registry.sync(spark, sources[3:])[1].count() == 0


def test_settings(tmp_path):
    given = {
        "thresholds": {
            "nightAbsoluteT7K": 330, "minStdT713K": 1.5, "confidenceHighScore": 4, "windows": [5, 9], "unknown": 1
        },
        "candidateRescue": {"enabled": True, "dynamicFactorScale": 0.1, "maxCandidatesPerScene": 7}
    }
    (tmp_path / "c.json").write_text("﻿" + json.dumps(given))
    c = config.scene_config(config.load(str(tmp_path / "c.json")))
    assert (
        c.thresholds.night_absolute_t7_k, c.thresholds.min_std_t713_k, c.thresholds.confidence_high,
        c.thresholds.windows
    ) == (330, 1.5, 4, (5, 9))
    assert (c.rescue.enabled, c.rescue.scale, c.rescue.most) == (True, 0.4, 7)
    (tmp_path / "l.json").write_text("[]")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "l.json"))
    with pytest.raises(ValueError):
        config.scene_config({"thresholds": {"windows": [4]}})


def test_listing_pages(spark):
    xml = "<L><IsTruncated>{}</IsTruncated><NextContinuationToken>t1</NextContinuationToken></L>"
    rows = spark.createDataFrame([(xml.format("true"),), (xml.format("false"),), ("<L/>",)], "xml string")
    assert [q[0] for q in rows.select(names.listing_next("xml")).collect()] == ["t1", None, None]


def test_scene_without_rows_loses_its_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "scene_id string, n int")
    sinks.write_scene(rows, path, ["a", "b"])
    sinks.write_scene(rows.filter("scene_id = 'a'").withColumn("n", F.lit(5)), path, ["a", "b"])
    assert [(q["scene_id"], q["n"]) for q in spark.read.parquet(path).collect()] == [("a", 5)]
    sinks.write_scene(rows.limit(0), path, ["a"])
    assert spark.read.schema("n int, scene_id string").parquet(path).count() == 0


def test_late_events_are_dropped(spark, tmp_path):
    """Files come one a batch; what is older than the watermark that the batches before the last one set is not counted."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    for k, minutes in enumerate(([0, 3, 200], [195], [1, 210])):
        part = spark.createDataFrame([(at(m), float(m)) for m in minutes], "ts timestamp, value double").coalesce(1)
        part.write.parquet(str(tmp_path / f"in{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (file,) = (tmp_path / f"in{k}").glob("*.parquet")
        os.utime(file.rename(tmp_path / "in" / f"{k}.parquet"), (1e9 + k, 1e9 + k))  # the order in which they are read
    events = spark.readStream.schema(
        "ts timestamp, value double"
    ).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for mode, want in (("append", {0: 2}), ("update", {0: 2, 190: 1, 200: 1, 210: 1})):
        found = {}
        run = scenes.slot_counts(events, 10, 60).writeStream.outputMode(mode).option(
            "checkpointLocation", str(tmp_path / mode)
        )
        run.foreachBatch(  # noqa: B023
            lambda b,
            _: found.update({int((q["slot"].timestamp() - T0.timestamp()) // 60): q["n"] for q in b.collect()})
        ).trigger(availableNow=True).start().awaitTermination()
        assert found == want


def test_interval_join_of_streams(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    spark.createDataFrame(
        [("f1", 1, at(0)), ("f2", 1, at(400)), ("f3", 2, at(0))], "fire_id string, cell int, acq_ts timestamp"
    ).write.parquet(str(tmp_path / "f"))
    spark.createDataFrame(
        [("r1", 1, at(180)), ("r2", 1, at(181))], "id string, r_cell int, r_ts timestamp"
    ).write.parquet(str(tmp_path / "r"))
    f = spark.readStream.schema("fire_id string, cell int, acq_ts timestamp").parquet(str(tmp_path / "f"))
    r = spark.readStream.schema("id string, r_cell int, r_ts timestamp").parquet(str(tmp_path / "r"))
    found = set()
    scenes.interval_join(f, r, 3).writeStream.foreachBatch(
        lambda b, _: found.update((q["fire_id"], q["id"]) for q in b.collect())
    ).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert found == {("f1", "r1")}


def test_simple_detector(spark):
    noon, night = T0 + dt.timedelta(hours=5), T0 + dt.timedelta(hours=17)
    row = lambda c, at, b07, land=True: (
        "s", 0, c, 100.0, 30.0, at, b07, 295.0, 290.0, 0.1, True, land, False, False
    )
    p = spark.createDataFrame(
        [
            row(0, noon, 350.0), row(1, noon, 301.0), row(2, noon, 350.0, False), row(3, night, 330.0),
            row(4, night, 310.0)
        ],
        "scene_id string, row int, col int, lon double, lat double, acq_ts timestamp, b07 double, b13 double, b14 double, rvis double, roi boolean, land boolean, static_hot boolean, high_reflectance boolean"
    )
    b = p.select(
        "scene_id", "row", "col",
        *[
            F.lit(v).alias(n) for n,
            v in (("t7_bg", 300.0), ("std_t7", 1.0), ("t713_bg", 8.0), ("std_t713", 2.0), ("pv", 0.0), ("pc", 0.0))
        ]
    )
    got = {q["col"]: q for q in pixels.simple_detector(p, b).collect()}
    assert 0 in got and 3 in got and 1 not in got and 2 not in got and got[0]["confidence"] == "high"


def test_recall_at_a_budget(spark):
    rows = [("s", 1, 9.0, "e1"), ("s", 2, 8.0, None), ("s", 3, 7.0, "e2"), ("t", 4, 1.0, "e3"), ("t", 5, 0.5, "e1")]
    (q,) = evaluation.recall_at(
        spark.createDataFrame(rows, "scene_id string, id int, score double, event_id string"), 2
    ).collect()
    assert (q["events"], q["found"], q["recall"]) == (3, 2, 0.6667)
