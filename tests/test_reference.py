"""The dataflows on small cases with known results."""

import bz2
import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.functions import features, geo, names, weather
from emberframe.functions import radiometry as R
from emberframe.functions.radiometry import Rescue, Thresholds
from emberframe.operators import catalog, clusters, evaluation, graphs, pixels, ranking, spatial, temporal
from emberframe.plans import model, scene
from emberframe.sources import grib, hsd, readers, sinks
from emberframe.streaming import scenes

UTC = dt.timezone.utc
DAY, NIGHT = dt.datetime(2026, 1, 1, 4, tzinfo=UTC), dt.datetime(2026, 1, 1, 16, tzinfo=UTC)
T = Thresholds(night_absolute_t7_k=360.0)
PIXEL = "scene_id string, row int, col int, lon double, lat double, acq_ts timestamp, b07 double, b13 double, b14 double, rvis double, roi boolean, non_vegetation boolean, altitude double, zenith double"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def grid(spark, n, b07=300.0, b13=290.0, b14=289.0, rvis=0.2, at=DAY, altitude=45.0, zenith=45.0, change=None):
    rows = []
    for r in range(n):
        for c in range(n):
            p = {"b07": b07, "b13": b13, "b14": b14, "rvis": rvis} | (change or {}).get((r, c), {})
            rows.append(
                (
                    "s", r, c, 100 + c * 0.01, 30 + r * 0.01, at, p["b07"], p["b13"], p["b14"], p["rvis"], True, False,
                    altitude, zenith
                )
            )
    return spark.createDataFrame(rows, PIXEL)


# ------------------------------------------------------------------ detection


def test_day_seed_is_found_by_two_independent_conditions(spark):
    frame = grid(spark, 9, change={(4, 4): {"b07": 306.33, "b13": 271.37, "b14": 270.50, "rvis": 0.2771}})
    t = Thresholds(night_absolute_t7_k=360.0, windows=(7, 9))
    j = pixels.judge(frame, t=t).collect()
    assert len(j) == 1 and j[0]["reject"] is None and j[0]["t713"] == pytest.approx(34.96, abs=0.01) and j[0]["window"] == 7


def test_night_fire_without_reflectance(spark):
    frame = grid(
        spark, 9, rvis=None, at=NIGHT, altitude=-10.0, zenith=100.0, change={(4, 4): {"b07": 380.0, "b13": 300.0}}
    )
    (f,) = pixels.judge(frame, t=T).collect()
    assert f["reject"] is None and f["night_hot"] and f["rvis"] is None and f["daynight"] == "N" and f["confidence"] == "high"


def test_background_leaves_hot_neighbours_out(spark):
    frame = grid(spark, 7, rvis=0.0, change={(2, 2): {"b07": 315.0, "b13": 300.0}})
    o = pixels.observe(frame, T)
    s = o.filter("row = 3 and col = 3")
    (b,) = pixels.background(s, o, Thresholds(windows=(7,))).collect()
    x = np.array([315.0 if (r, c) == (2, 2) else 300.0 for r in range(7) for c in range(7) if (r, c) != (3, 3)])
    hot = (x >= np.percentile(x, 80)) & (x >= np.where(x > 310, 300.0, 290.0) + 20)
    assert b["t7_bg"] == pytest.approx(x[~hot].mean()) and b["t7_bg"] > 300.2


def test_deviation_is_clamped(spark):
    flat = pixels.observe(grid(spark, 7), T)
    wild = pixels.observe(
        grid(
            spark, 7, change={(r, c): {"b07": 290.0 + 5 + r * 7 + c, "rvis": 0.5} for r in range(7) for c in range(7)}
        ),
        Thresholds(cloud_visible_reflectance=0.9)
    )
    centre = lambda o: o.filter("row = 3 and col = 3")
    t = Thresholds(windows=(7,))
    assert pixels.background(centre(flat), flat, t).first()["std_t713"] == 2.0
    assert pixels.background(centre(wild), wild, t).first()["std_t713"] == 4.0


@pytest.mark.parametrize("clear, window", [(10, 7), (16, 9), (25, 11), (80, 19), (0, None)])
def test_every_window_and_none(spark, clear, window):
    rng = np.random.default_rng(1)
    cloudy = {}
    for r in range(21):
        for c in range(21):
            ring = max(abs(r - 10), abs(c - 10))
            inner = {7: 3, 9: 4, 11: 5, 19: 9}.get(window, 99)
            if (r, c) != (10, 10) and (
                window is None or ring < inner or (window != 7 and ring <= {9: 3, 11: 4, 19: 5}[window])
            ):
                cloudy[(r, c)] = {"b14": 250.0}
    if window == 7:
        cloudy = {}
    frame = grid(spark, 21, change={(10, 10): {"b07": 330.0}} | cloudy)
    got = pixels.judge(frame, t=Thresholds()).filter("row = 10 and col = 10").collect()
    assert rng is not None and len(got) == 1
    assert got[0]["window"] == window and (got[0]["reject"] == "background") == (window is None)


def test_cascade_order_and_edges(spark):
    base = dict(
        scene_id="s", row=1, col=1, b07=330.0, b13=290.0, t713=40.0, rvis=0.2, altitude=45.0, zenith=45.0,
        night_hot=False, window=7, t7_bg=300.0, t13_bg=290.0, rvis_bg=0.1, n_rvis=5, t713_bg=10.0, std_t7=1.0,
        std_t713=2.0, pv=0.2, pc=0.3, static=False
    )
    cases = [
        ({}, None),
        (
            {
                "window": None, "t7_bg": None, "std_t7": None, "t713_bg": None, "std_t713": None, "pv": None,
                "pc": None, "n_rvis": None
            },
            "background"
        ),
        ({"b07": 301.0, "t713": 11.0}, "dynamic"),
        ({"rvis": 0.3, "b13": 284.0}, "cloud"), ({"b07": 305.0, "t713": 20.0}, "edge"),
        ({"b07": 305.0, "t713": 40.0}, None), ({"static": True}, "static"),
        ({"static": True, "rvis": 0.3, "b13": 284.0}, "cloud"),
        ({"rvis": None, "b13": 284.0}, None), ({"night_hot": True, "b07": 301.0, "t713": 40.0}, None),
    ]
    schema = "scene_id string, row int, col int, b07 double, b13 double, t713 double, rvis double, altitude double, zenith double, night_hot boolean, window int, t7_bg double, t13_bg double, rvis_bg double, n_rvis long, t713_bg double, std_t7 double, std_t713 double, pv double, pc double, static boolean, k int"
    frame = spark.createDataFrame(
        [tuple((base | change).values()) + (k,) for k, (change, _) in enumerate(cases)], schema
    )
    got = {r["k"]: r["reject"] for r in pixels.cascade(frame, T).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
    near = frame.filter("k = 2").withColumns(
        {"b07": F.lit(302.0), "t713": F.lit(14.0), "pv": F.lit(0.0), "pc": F.lit(0.0), "altitude": F.lit(80.0)}
    )
    rescued = pixels.cascade(near, T, Rescue(True, 0.1, 0.0)).first()
    assert rescued["tier"] == "model-rescue" and rescued["reject"] is None and Rescue(True, 0.1).normal().scale == 0.4


def test_dynamic_factor_on_both_sides_of_60_degrees(spark):
    s45, s60 = math.sin(math.radians(45)), math.sin(math.radians(60))
    assert value(spark, R.dynamic_factor(45.0, 0.2, 0.3)) == pytest.approx((s45 + 1) * 1.2 * 1.3)
    assert value(spark, R.dynamic_factor(60.0, 0.2, 0.3)) == pytest.approx((1.2 * s60 + 1) * 1.2 * 1.3**2)
    assert value(spark, R.dynamic_factor(-10.0, 0.0, 0.0)) == 1.0


def test_score_grows_with_the_signal(spark):
    s = lambda t7, t713: value(
        spark, R.evidence(t7, t713, 300.0, 2.0, 10.0, 2.0, 2.0, F.lit(False), T)["score"]
    )
    assert 0 <= s(310.0, 20.0) < s(320.0, 30.0) <= s(900.0, 600.0) == 10.0
    assert [value(spark, R.confidence(F.lit(x))) for x in (3.5, 2.0, 1.9)] == ["high", "medium", "low"]
    assert value(spark, R.confidence(F.lit(3.0), 2.5, 9.0)) == "high"


def test_local_maximum(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(12, 12))
    x[2, 3] = np.nan
    rows = [("s", i, j, None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(12) for j in range(12)]
    frame = spark.createDataFrame(rows, "scene_id string, row int, col int, v double")
    got = {(q["row"], q["col"]) for q in pixels.local_maximum(frame, "v", 5).filter("is_maximum").collect()}
    filled = np.where(np.isnan(x), -np.inf, x)
    want = {
        (i, j) for i in range(12) for j in range(12) if not np.isnan(x[i, j]) and filled[i, j] >= filled[
            max(0, i - 2) : i + 3, max(0, j - 2) : j + 3
        ].max()
    }
    assert got == want
    with pytest.raises(ValueError):
        pixels.local_maximum(frame, "v", 4)


def test_suppression_equals_a_sequential_pass(spark):
    r = np.random.default_rng(0)
    places = {(int(a), int(b)) for a, b in r.integers(0, 30, (250, 2))}
    fires = sorted((k, a, b, float(r.integers(0, 5))) for k, (a, b) in enumerate(sorted(places)))
    kept = []
    for f in sorted(fires, key=lambda f: (-f[3], f[1], f[2])):
        if not any(abs(f[1] - g[1]) <= 2 and abs(f[2] - g[2]) <= 2 for g in kept):
            kept.append(f)
    frame = spark.createDataFrame(
        [("s", *f) for f in fires], "scene_id string, fire_id long, row int, col int, score double"
    )
    assert {q["fire_id"] for q in pixels.suppress(frame, 2).collect()} == {f[0] for f in kept}
    assert pixels.suppress(frame.limit(0), 2).count() == 0


def test_rescue_limit(spark):
    frame = spark.createDataFrame(
        [("s", k, 0, float(k), "model-rescue" if k else "strict") for k in range(6)],
        "scene_id string, row int, col int, score double, tier string"
    )
    assert {q["row"] for q in pixels.limit_rescued(frame, Rescue(True, most=2)).collect()} == {0, 4, 5}
    assert pixels.limit_rescued(frame, Rescue(True, most=0)).count() == 6


def test_thresholds_are_checked():
    for bad in (
        Thresholds(windows=(8,)), Thresholds(min_valid_ratio=2.0), Thresholds(min_std_t713_k=9.0),
        Thresholds(edge_threshold_c=float("nan"))
    ):
        with pytest.raises(ValueError):
            bad.checked()


# ------------------------------------------------------------------ geometry and joins


def hav(a, b, c, d):
    s = math.sin(
        math.radians(d - b) / 2
    ) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(s))


@pytest.mark.parametrize("lat, lon, km", [(30, 100, 40), (80, 0, 60), (89.5, 10, 80), (10, 179.9, 50)])
def test_distance_join_loses_no_pair(spark, lat, lon, km):
    r = np.random.default_rng(int(lat))
    wrap = lambda x: (x + 180) % 360 - 180
    a = [
        (
            k, wrap(lon + float(r.normal()) * (3 if lat < 85 else 60)), min(max(lat + float(r.normal()), -90.0), 90.0)
        ) for k in range(60)
    ]
    b = [
        (
            k, wrap(lon + float(r.normal()) * (3 if lat < 85 else 60)), min(max(lat + float(r.normal()), -90.0), 90.0)
        ) for k in range(60)
    ]
    left = spark.createDataFrame([*a, (99, None, 1.0)], "a long, lon double, lat double")
    got = {
        (q["a"], q["b"]) for q in spatial.distance_join(
            left, spark.createDataFrame(b, "b long, r_lon double, r_lat double"), km
        ).collect()
    }
    assert got == {(i, j) for i, x, y in a for j, u, v in b if hav(x, y, u, v) <= km}


def test_polygons_with_holes_edges_and_parts(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    polys = spark.createDataFrame(
        [
            (1, [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))]),
            (2, [ring((20, 0), (22, 0), (21, 2))])
        ],
        "polygon_id long, rings array<array<struct<x:double,y:double>>>"
    )
    pts = {1: (1, 1), 2: (5, 5), 3: (5, 3), 4: (21, 1), 5: (15, 1), 6: (0, 5), 7: (10, 5), 8: (4, 5)}
    frame = spark.createDataFrame(
        [(k, float(x), float(y)) for k, (x, y) in pts.items()], "key long, lon double, lat double"
    )
    got = {(q["key"], q["polygon_id"]) for q in spatial.within_polygons(frame, polys, "key", cell=3.0).collect()}
    assert got == {
        (1, 1), (3, 1), (4, 2), (6, 1)
    } | ({(8, 1)} & got)  # half-open: the left edge is inside, the right is not
    inclusive = {
        q["key"] for q in frame.crossJoin(polys.filter("polygon_id = 1")).filter(
            geo.point_in_polygon_inclusive(F.col("rings"), "lon", "lat")
        ).collect()
    }
    assert {1, 3, 6, 7, 8} <= inclusive and 2 not in inclusive and 5 not in inclusive
    clipped = spatial.clip(frame, polys, "key")
    assert {q["key"] for q in spatial.rejected_sample(clipped, ["key"], 2).collect()} <= {2, 5, 7}
    assert spatial.clip(frame, polys.limit(0), "key").filter("accepted").count() == len(pts)


def test_static_radius_is_not_inflated(spark):
    points = spark.createDataFrame(
        [(1, 110.003, 30.0), (2, 110.012, 30.0), (3, 111.03, 30.0)], "key long, lon double, lat double"
    )
    sources = spark.createDataFrame(
        [(110.0, 30.0, 0.5), (111.0, 30.0, 0.0)], "lon double, lat double, radius_km double"
    )
    assert {q["key"] for q in spatial.near_sources(points, sources, "key", 4.0).collect()} == {1, 3}
    assert {q["key"] for q in spatial.without_sources(points, sources.limit(0), "key").collect()} == {1, 2, 3}


FIRE = "fire_id long, lon double, lat double, acq_ts timestamp"
REF = "id string, sensor string, lon double, lat double, acq_ts timestamp, confidence string, frp double, scan_km double, track_km double"


def test_fusion_and_official_ranges(spark):
    fires = spark.createDataFrame([(1, 110.0, 30.0, NIGHT), (2, 120.0, 40.0, NIGHT)], FIRE)
    refs = spark.createDataFrame(
        [
            ("VIIRS-1", "VIIRS", 110.01, 30.0, NIGHT + dt.timedelta(minutes=10), "n", 12.0, 0.4, 0.3),
            ("VIIRS-2", "VIIRS", 100.0, 20.0, NIGHT, "n", None, 0.5, 0.4)
        ],
        REF
    )
    got = {q["fire_id"]: q for q in spatial.nearest_reference(fires, refs).collect()}
    assert got[1]["fused_status"] == "confirmed" and got[1]["official_id"] == "VIIRS-1" and got[1][
        "official_minutes"
    ] == 10.0 and got[1]["official_frp"] == 12.0
    assert got[2]["fused_status"] == "suspected" and got[2]["official_id"] is None
    ranges = {
        q["id"]: q for q in spatial.official_ranges(refs, spatial.nearest_reference(fires, refs)).withColumn(
            "ring", geo.metre_box("lon", "lat", F.col("width_km") * 1000, F.col("height_km") * 1000)
        ).collect()
    }
    assert ranges["VIIRS-1"]["fusion_status"] == "official-confirmed" and ranges["VIIRS-2"]["fusion_status"] == "official-only"
    assert len(ranges["VIIRS-1"]["ring"]) == 5 and ranges["VIIRS-1"]["ring"][0] == ranges["VIIRS-1"]["ring"][-1]


def test_adjacent_fires_make_one_area(spark):
    rows = [("s", 1, 2, 2, 100.1, 30.1, 4.0), ("s", 2, 2, 3, 100.15, 30.1, 3.0), ("s", 3, 0, 0, 100.0, 30.0, 2.0)]
    fires = spark.createDataFrame(
        rows, "scene_id string, fire_id long, row int, col int, lon double, lat double, score double"
    ).withColumns({"bt_tir": F.lit(380.0), "bt_dif": F.lit(80.0), "official_confirmed": F.col("fire_id") == 2})
    grid_ = spark.createDataFrame(
        [("s", r, c, 100 + c * 0.05, 30 + r * 0.05) for r in range(5) for c in range(5)],
        "scene_id string, row int, col int, lon double, lat double"
    )
    printed = clusters.footprints(fires, grid_)
    (area,) = clusters.fire_clusters(printed).collect()
    assert area["pixel_count"] == 2 and area[
        "cluster_status"
    ] == "confirmed" and area["max_score"] == 4.0 and len(area["rings"]) == 2
    assert area["centroid_lon"] == pytest.approx((100.1 * 5 + 100.15 * 4) / 9, abs=1e-6)
    assert clusters.fire_clusters(fires, least=1).agg(F.sum("pixel_count")).first()[0] == 3
    corner = printed.filter("fire_id = 3").first()["ring"]
    assert corner[0]["x"] == pytest.approx(99.975) and corner[2]["y"] == pytest.approx(30.025)


def test_components_of_a_long_chain(spark):
    n = spark.range(200).select("id")
    e = spark.createDataFrame([(k, k + 1) for k in range(0, 99)] + [(150, 150)], "a long, b long")
    got = {q["id"]: q["component"] for q in graphs.connected_components(n, e).collect()}
    assert all(got[k] == 0 for k in range(100)) and got[150] == 150 and len(got) == 200


# ------------------------------------------------------------------ features, ranks, state


def test_state_is_replaced_not_added(spark):
    c = spark.createDataFrame(
        [
            (1, 100.01, 30.01, 300.0, 20.0, 1.0, 5), (2, 100.02, 30.02, 310.0, 10.0, 2.0, 5),
            (3, 100.01, 30.01, 305.0, 10.0, 1.0, 6)
        ],
        "fire_id long, center_lon double, center_lat double, max_bt07_k double, max_t713_k double, cand_area double, slot_ord int"
    )
    s = temporal.grid_state(c)
    again = temporal.merge_state(s, s.filter("slot_ord = 5"))
    assert {(q["slot_ord"], q["n_cand"]) for q in again.collect()} == {(5, 2), (6, 1)}
    assert {
        (q["slot_ord"], q["n_cand"]) for q in temporal.merge_state(s, s, replace=False).collect()
    } == {(5, 4), (6, 2)}
    assert {q["slot_ord"] for q in temporal.latest_slots(s, 1).collect()} == {6}
    f = {
        q["fire_id"]: q for q in temporal.neighbour_features(
            temporal.lag_features(c, s, "fire_id"), s, "fire_id"
        ).collect()
    }
    assert f[3]["temp_bt07_m1"] == 310.0 and f[3]["temp_n_m1"] == 2 and f[3][
        "temp_persist_3"
    ] == 1 and f[3]["temp_nb_hit_m1"] == 1 and f[3][
        "temp_bt07_delta_m1"
    ] == -5.0
    assert f[1]["temp_bt07_m1"] == 0.0 and f[1]["temp_bt07_p1"] == 305.0 and f[1]["temp_nb_n_m1"] == 0
    assert f[3]["temp_hot_persist"] == pytest.approx(math.log1p(305) * math.log1p(10))


def test_rank_share_equals_average_ranks(spark):
    import pandas as pd

    r = np.random.default_rng(0)
    x = [None if v == 0 else float(v) for v in r.integers(0, 6, 40)]
    frame = spark.createDataFrame(
        [(k, "a" if k < 25 else "b", v) for k, v in enumerate(x)], "k long, scene_slot string, v double"
    )
    got = {q["k"]: q["s"] for q in frame.withColumn("s", ranking.rank_share("v")).collect()}
    p = pd.DataFrame({"g": ["a"] * 25 + ["b"] * 15, "v": x}).groupby("g")["v"].rank(method="average", pct=True)
    for k, want in p.items():
        assert (got[k] is None and np.isnan(want)) or got[k] == pytest.approx(want)


def test_budget_keeps_every_forced_fire(spark):
    rows = [
        (
            "s", k, 100.0 if k < 8 else 110.0, float(k), k in (0, 1, 2), "model-rescue" if k == 7 else "strict",
            0.1 * k, "low"
        ) for k in range(10)
    ]
    f = spark.createDataFrame(
        rows,
        "scene_id string, fire_id long, center_lon double, score double, official_confirmed boolean, tier string, west_prob double, confidence string"
    ).withColumn("east_prob", F.lit(None).cast("double"))
    s = ranking.Scorer(west_budget=2, rescue_least=0.9)
    routed = ranking.route(f, s)
    got = {q["fire_id"]: q for q in ranking.within_budget(routed, s).collect()}
    assert set(got) == {0, 1, 2, 8, 9} and got[9]["score_source"] == "physics-rule" and got[9]["score"] == 9.0 and got[2]["score"] == 2.0
    assert {
        q["fire_id"] for q in ranking.within_budget(routed, ranking.Scorer(west_budget=0, rescue_least=0.9)).collect()
    } == set(range(10)) - {7}
    row = ranking.score_summary(routed, ranking.within_budget(routed, s)).first()
    assert (row["scored"], row["kept"], row["rescue_dropped"]) == (10, 5, 1)


def test_score_sync_drops_unmatched_western_pixels(spark):
    schema = "scene_id string, row int, col int, lon double, lat double, score double, confidence string, official_confirmed boolean"
    px = spark.createDataFrame(
        [
            ("s", 1, 1, 100.0, 30.0, 1.0, "low", False), ("s", 2, 2, 100.1, 30.0, 1.0, "low", False),
            ("s", 3, 3, 100.2, 30.0, 1.0, "low", True), ("s", 4, 4, 110.0, 30.0, 1.0, "low", False)
        ],
        schema
    )
    got = {
        q["row"]: q["score"] for q in ranking.sync_scores(
            px, px.filter("row = 1").withColumn("score", F.lit(7.0))
        ).collect()
    }
    assert got == {1: 7.0, 3: 1.0, 4: 1.0}


def test_day_phase_regions_and_slots(spark):
    ts = F.lit(dt.datetime(2026, 1, 1, 23, 30, tzinfo=UTC))
    assert [
        value(spark, features.day_phase(F.lit(c), ts, lon)) for c,
        lon in (("n", 0.0), (None, 97.5), (None, 90.0), (None, 0.0), ("T", 0.0))
    ] == ["night", "day", "twilight", "night", "twilight"]
    assert [value(spark, features.slot_ordinal(F.lit(s))) for s in ("200001010010", "junk", "")] == [1, -1, -1]
    assert value(
        spark, features.urban(F.lit(116.4), F.lit(39.9))
    ) and not value(spark, features.urban(F.lit(90.0), F.lit(39.9)))
    assert value(
        spark, features.desert(F.lit(80.0), F.lit(40.0))
    ) and not value(spark, features.desert(F.lit(76.8), F.lit(40.0)))
    assert [
        value(spark, features.plant_radius_km(F.lit(x))) for x in (0.0, 100.0, 100000.0)
    ] == [0.25, pytest.approx(0.954, abs=1e-3), 2.5]


FOREST = """tree
version=v4
objective=binary sigmoid:1
feature_names=a b

Tree=0
num_leaves=3
split_feature=0 1
threshold=0.5 2
decision_type=2 2
left_child=1 -1
right_child=-2 -3
leaf_value=0.1 0.2 -0.3

Tree=1
num_leaves=1
leaf_value=0.05

end of trees
"""


def test_forest_scores(spark):
    f = model.parse_forest(FOREST)
    x = np.array([[0.0, 1.0], [0.0, 3.0], [1.0, 0.0]])
    assert f.raw(x).tolist() == pytest.approx([0.15, -0.25, 0.25])
    frame = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0), (1.0, None), (float("nan"), 1.0)], "a double, b double")
    got = [q["p"] for q in frame.select(model.probability(FOREST, ["a", "b"]).alias("p")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-v)) for v in (0.15, -0.25, 0.25, 0.15)])
    assert value(spark, model.probability(FOREST, [])) == pytest.approx(1 / (1 + math.exp(-0.15)))
    with pytest.raises(ValueError):
        model.parse_forest(FOREST.replace("decision_type=2 2", "decision_type=1 2"))


# ------------------------------------------------------------------ validation and mining


def detections(spark, rows):
    return spark.createDataFrame(rows, "id long, lon double, lat double, acq_ts timestamp")


def test_matching_is_one_to_one_and_greedy(spark):
    nine = dt.datetime(2026, 1, 1, 9, tzinfo=UTC)
    c, r = detections(
        spark, [(1, 110.0, 30.0, nine), (2, 110.001, 30.001, nine)]
    ), detections(spark, [(7, 110.0, 30.0, nine - dt.timedelta(hours=1))])
    m = evaluation.match(c, r, 5, 3)
    row = evaluation.metrics(c, r, m, 3, 5).first()
    assert (row["true_positive"], row["false_positive"], row["false_negative"]) == (1, 1, 0) and row["precision"] == 0.5
    none = evaluation.metrics(c, r.limit(0), evaluation.match(c, r.limit(0)), 1, 5).first()
    assert none["status"] == "no_reference_detections" and none["precision"] is None and none["candidate_count"] == 2
    assert {q["tag"] for q in evaluation.tagged(c, r, m).collect()} == {
        "true-positive", "apparent-false-positive", "matched-reference"
    }
    rng = np.random.default_rng(5)
    c = [(k, 110 + float(rng.normal()) * 0.03, 30 + float(rng.normal()) * 0.03, nine) for k in range(40)]
    r = [
        (
            k, 110 + float(rng.normal()) * 0.03, 30 + float(rng.normal()) * 0.03,
            nine + dt.timedelta(minutes=int(rng.integers(0, 200)))
        ) for k in range(40)
    ]
    pairs = sorted(
        (hav(a[1], a[2], b[1], b[2]), abs((b[3] - a[3]).total_seconds()) / 3600, a[0], b[0]) for a in c for b in r
    )
    used_c, used_r, want = set(), set(), set()
    for d, t, i, j in pairs:
        if d <= 5 and t <= 3 and i not in used_c and j not in used_r:
            used_c.add(i), used_r.add(j), want.add((i, j))
    assert {
        (q["id"], q["r_id"]) for q in evaluation.match(detections(spark, c), detections(spark, r), 5, 3).collect()
    } == want


def test_reference_clusters_and_reach(spark):
    t0 = dt.datetime(2026, 1, 1, tzinfo=UTC)
    rows = [
        (1, "A", 110.0, 30.0, t0, 3.0), (2, "B", 110.01, 30.0, t0 + dt.timedelta(minutes=20), None),
        (3, "A", 110.03, 30.0, t0 + dt.timedelta(minutes=45), 0.0),
        (4, "A", 110.0, 30.0, t0 + dt.timedelta(hours=5), 1.0)
    ]
    refs = spark.createDataFrame(rows, "id long, sensor string, lon double, lat double, acq_ts timestamp, frp double")
    got = {q["id"]: q for q in clusters.reference_clusters(refs).collect()}
    assert set(got) == {1, 4} and got[1]["member_ids"] == [1, 2, 3] and got[1]["sensor"] == "A+B" and got[1]["frp"] == 3.0
    assert got[1]["lon"] == pytest.approx((110.0 * 4 + 110.01 + 110.03) / 6)
    c = detections(spark, [(1, 0.0, 0.0, t0)])
    assert {q["id"] for q in spatial.in_time_reach(refs, c, 0.5).collect()} == {1, 2}


def test_persistent_sources_need_days_and_hits(spark):
    rows = [
        (k, 110.0 + (k % 2) * 0.005, 30.0, f"2026-01-0{1 + k % 4}", 2.0, "D") for k in range(5)
    ] + [(9 + k, 112.0, 30.0, "2026-01-01", 1.0, "N") for k in range(6)]
    (s,) = clusters.persistent_sources(
        spark.createDataFrame(rows, "id long, lon double, lat double, acq_date string, frp double, daynight string")
    ).collect()
    assert (
        s["detection_count"], s["day_count"], s["first_date"], s["last_date"], s["by_day"], s["mean_frp"]
    ) == (5, 4, "2026-01-01", "2026-01-04", 5, 2.0)


# ------------------------------------------------------------------ weather and names


def test_forecast_takes_the_next_time_else_the_last(spark):
    pick = lambda times, t: value(
        spark,
        weather.forecast_index(
            F.array(*[F.lit(x).cast("long") for x in times]) if times else F.array().cast("array<long>"), F.lit(t)
        )
    )
    assert [
        pick([10, 20, None], t) for t in (5, 10, 11, 99)
    ] == [0, 0, 1, 1] and pick([], 1) == -1 and pick([None], 1) == -1
    series = F.create_map(
        *[
            x for k,
            v in {
                "temp": [290.15, 300.15], "wind_u": [3.0, 6.0], "wind_v": [4.0, 8.0], "rh": [50.0, 20.0],
                "pressure": [101325.0, 100000.0]
            }.items() for x in (F.lit(f"{k}-surface"), F.array(*map(F.lit, v)))
        ]
    )
    units = F.create_map(F.lit("temp-surface"), F.lit("K"), F.lit("pressure-surface"), F.lit("Pa"))
    w = value(spark, weather.forecast_values(F.array(F.lit(1), F.lit(2)), series, units, F.lit(2)))
    assert (w["temp_c"], w["wind_ms"], w["pressure_hpa"], w["gust_ms"]) == (27.0, 10.0, 1000.0, None)
    assert w["fire_risk"] == math.floor(100 * (0.38 * 0.8 + 0.32 * 0.45 + 0.22 * 10 / 18) + 0.5)
    assert value(
        spark, weather.fire_risk(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    ) == 30


def test_weather_grid_bounds_and_rings(spark):
    g = weather.grid_bounds({"minLat": 5, "maxLat": -95, "minLon": 10, "maxLon": 11, "stepLat": 0.1, "stepLon": "x"})
    assert g == {"min_lat": -90.0, "max_lat": 5.0, "min_lon": 10.0, "max_lon": 11.0, "step_lat": 0.25, "step_lon": 2.0}
    assert weather.grid_points(spark, weather.grid_bounds()).count() == 81
    ring = value(spark, geo.cell_ring(F.lit(179.9), F.lit(89.9), 0.5, 0.5))
    assert ring[0]["x"] == pytest.approx(179.65) and ring[1]["x"] == pytest.approx(180.15) and ring[2]["y"] == 90.0
    assert [
        value(spark, geo.normalize_longitude(F.lit(x))) for x in (190.0, -190.0, 180.0, 540.0)
    ] == [-170.0, 170.0, 180.0, 180.0]


def test_names(spark):
    name = "HS_H09_20260101_1010_B07_FLDK_R20_S0310.DAT.bz2"
    n = value(spark, names.segment_name(F.lit(name)))
    assert (n["satellite"], n["scene_id"], n["band"], n["segment"], n["total"]) == ("H09", "202601011010", "07", 3, 10)
    assert value(spark, names.segment_name(F.lit("other"))) is None
    assert value(spark, names.expected_name(F.lit("H09"), F.lit("202601011010"), F.lit("07"), F.lit(3))) == name
    assert value(
        spark, names.render(F.lit("a/{YYYY}{MM}/{DEM_TILE}/{none}"), names.time_variables(F.lit(DAY)))
    ) == "a/202601/N39_00_E116_00/"
    assert value(
        spark, geo.land_cover_tile(F.lit(116.39), F.lit(39.9))
    ) == "N39E114" and value(spark, geo.land_cover_tile(F.lit(-0.5), F.lit(-0.5))) == "S03W003"
    assert value(
        spark, names.scene_key(F.lit("2026-01-01T10:10:00.000Z"))
    ) == "202601011010" and value(spark, names.safe_name(F.lit('a<>b:"c'))) == "a_b_c"
    assert [
        value(spark, names.sensor_of(F.lit(f))) for f in ("MODIS_C6.csv", "SUOMI_VIIRS.csv", "J2_VIIRS.csv", "J1.csv")
    ] == ["MODIS", "VIIRS_SNPP", "VIIRS_NOAA21", "VIIRS_NOAA20"]
    assert value(spark, names.normal_bands(F.array(F.lit("B7"), F.lit("07"), F.lit("13")))) == ["07", "13"]
    e = value(
        spark,
        names.listing_entries(
            F.lit(
                "<L><Contents><Key>a&amp;b</Key><Size>5</Size></Contents><Contents><Key>c</Key><Size>x</Size></Contents></L>"
            )
        )
    )
    assert [(x["key"], x["size"]) for x in e] == [("a&b", 5), ("c", None)]
    assert value(spark, names.slot_floor(F.lit(dt.datetime(2026, 1, 1, 10, 19, 59, tzinfo=UTC)))).minute == 10
    assert names.slots(spark, F.lit(DAY), 2).count() == 3


# ------------------------------------------------------------------ catalog


def test_complete_scenes_need_the_same_segments(spark):
    rows = [
        ("202601011010", b, s, "p") for b in ("03", "07") for s in (1, 2, 3, 5 if b == "07" else 4)
    ] + [("202601011000", b, s, "p") for b in ("03", "07") for s in (1, 2, 3, 4)]
    files = spark.createDataFrame(rows, "scene_id string, band string, segment int, path string")
    assert [
        q["scene_id"] for q in catalog.latest_scenes(files, ["03", "07"], [1, 2, 3, 4]).collect()
    ] == ["202601011000"]
    assert catalog.latest_scenes(files, ["03", "07", "13"], [1]).count() == 0
    assert [
        q["scene_id"] for q in catalog.latest_scenes(files, ["03"], [1], oldest_first=True).collect()
    ] == ["202601011000"]


def test_bookkeeping(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, created int, v string")
    new = spark.createDataFrame(
        [("b", 5, "z", 1), ("b", 4, "w", 1), ("c", 6, "q", 1)], "k string, created int, v string, extra int"
    )
    got = {
        q["k"]: (q["created"], q["v"], q["extra"]) for q in catalog.upsert(
            old, new, "k", "created", keep=("created",)
        ).collect()
    }
    assert got == {"a": (1, "x", None), "b": (2, "z", 1), "c": (6, "q", 1)}
    files = spark.createDataFrame(
        [("f", bytearray(b"abc"), 2), ("f", bytearray(b"zzz"), 3)], "path string, content binary, order int"
    )
    m = catalog.manifest(files).first()
    assert (m["size"], m["sha256"]) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    fires = spark.createDataFrame([("H", DAY, 1), ("H", NIGHT, 2)], "source_sat string, acq_ts timestamp, v int")
    cleared = catalog.replace_scenes(fires, fires.limit(0), fires.filter("v = 1"))
    assert [q["v"] for q in cleared.collect()] == [2]
    ts = spark.createDataFrame([(1, DAY), (2, DAY + dt.timedelta(minutes=61)), (3, None)], "k int, acq_ts timestamp")
    assert {q["k"] for q in catalog.retained(ts).collect()} == {2, 3}
    cur = spark.createDataFrame(
        [("s1", "failed", 1), ("s2", "ok", 2), ("s3", "failed", 3)], "source_id string, status string, n int"
    )
    prev = spark.createDataFrame([("s1", "ok", 9)], "source_id string, status string, n int")
    assert {
        q["source_id"]: (q["n"], q["recovered"]) for q in catalog.last_good(cur, prev).collect()
    } == {"s1": (9, True), "s2": (2, False), "s3": (3, False)}
    lanes = catalog.transfer_lanes(
        spark.createDataFrame([("07", f"f{k}") for k in range(5)] + [("03", "g")], "band string, name string"), 2, 2
    )
    assert {q["name"]: (q["lane"], q["batch"]) for q in lanes.collect()} == {
        "f0": (0, 0), "f2": (0, 0), "f4": (0, 1), "f1": (1, 0), "f3": (1, 0), "g": (0, 0)
    }
    assert catalog.unprocessed(fires, fires.filter("v = 1")).first()["v"] == 2
    one = catalog.by_priority(
        spark.createDataFrame([("a", 2, "far"), ("a", 1, "near"), ("b", 2, "far")], "k string, p int, s string"), ["k"],
        "p"
    )
    assert {(q["k"], q["s"]) for q in one.collect()} == {("a", "near"), ("b", "far")}


def test_reference_acceptance(spark):
    rows = [
        ("VIIRS", "nominal", ""), ("VIIRS", "low", "0"), ("MODIS", "55", "0.0"), ("MODIS", "10", None),
        ("MODIS", "abc", "0"), ("VIIRS", "h", "2")
    ]
    refs = spark.createDataFrame(
        [(k, s, 110.0, 30.0, DAY, c, t, k) for k, (s, c, t) in enumerate(rows)],
        "id long, sensor string, lon double, lat double, acq_ts timestamp, confidence string, fire_type string, ingest_order long"
    )
    ok = catalog.accepted_references(refs, (109, 29, 111, 31), F.lit(DAY), 1)
    assert {q["id"] for q in ok.collect()} == {0, 2}
    assert {q["id"] for q in catalog.distinct_references(refs).collect()} == {0, 2}


# ------------------------------------------------------------------ sources and sinks


def test_segments_round_trip(spark, tmp_path):
    head = {
        "columns": 0, "lines": 0, "sub_lon": 140.7, "cfac": 20466275, "lfac": 20466275, "coff": 2.5, "loff": 2.5,
        "height_km": 42164.0, "equatorial_km": 6378.137, "polar_km": 6356.7523, "band_number": 7,
        "wavelength_um": 3.8853, "error_count": 65535, "outside_count": 65534, "slope": -0.0037, "intercept": 7.5,
        "c0": -0.479, "c1": 1.0007, "c2": -1.8e-7, "total_segments": 2, "segment_number": 1, "first_line": 1
    }
    counts = np.arange(24, dtype=np.uint16).reshape(4, 6)
    counts[0, 0] = 65535
    got, back = hsd.read_segment(hsd.write_segment(head, counts))
    assert (back == counts).all() and got == head | {"lines": 4, "columns": 6}
    for s, first in ((1, 1), (2, 5)):
        (tmp_path / f"HS_H09_20260101_1010_B07_FLDK_R20_S{s:02d}02.DAT.bz2").write_bytes(
            hsd.write_segment(head | {"segment_number": s, "first_line": first}, counts)
        )
    (tmp_path / "notes.txt").write_text("x")
    assert hsd.segment_files(spark, str(tmp_path)).count() == 2
    lines = hsd.segment_lines(spark, str(tmp_path), ["07"], {"lineStart": 2, "lineEnd": 6, "colStart": 2, "colEnd": 4})
    assert sorted((q["line"], q["counts"]) for q in lines.collect())[0] == (2, [7, 8, 9]) and lines.count() == 5
    px = hsd.segment_pixels(hsd.segment_lines(spark, str(tmp_path)), "bt")
    assert px.count() == 48 and px.filter("value is null").count() == 2 and px.first()["scene_id"] == "202601011010"
    with pytest.raises(ValueError):
        hsd.segment_pixels(lines, "other")
    with pytest.raises(ValueError):
        hsd.read_segment(bz2.compress(bz2.decompress(hsd.write_segment(head, counts))[:-4]))


def test_navigation_and_resampling(spark):
    p = R.Projection(140.7, 20466275, 20466275, 2750.5, 2750.5)
    frame = spark.createDataFrame([(110.0, 30.0), (140.7, 0.0), (-40.0, 0.0)], "lon double, lat double")
    c, ln, v = R.to_column_line("lon", "lat", p)
    x, y = R.to_lon_lat("c", "l", p)
    got = frame.withColumns({"c": c, "l": ln, "v": v}).withColumns({"x": x, "y": y}).collect()
    assert [
        q["v"] for q in got
    ] == [
        True, True, False
    ] and got[0]["x"] == pytest.approx(110, abs=1e-6) and got[0]["y"] == pytest.approx(30, abs=1e-6) and got[1]["c"] == pytest.approx(2750.5)
    crop = R.crop_bounds(p, 5500, 5500, (109.0, 29.0, 111.0, 31.0), 5)
    assert crop["lineStart"] < got[0]["l"] < crop["lineEnd"] and crop["colStart"] < got[0]["c"] < crop["colEnd"]
    source = spark.createDataFrame(
        [(int(round(got[0]["l"])), int(round(got[0]["c"])), 5.0)], "line int, column int, value double"
    )
    assert {
        q["lon"]: q["value"] for q in hsd.resample(source, frame, p, crop).collect()
    } == {110.0: 5.0, 140.7: None, -40.0: None}


def test_grib_round_trip(spark, tmp_path):
    grid_ = np.round(np.random.default_rng(0).normal(280, 9, (4, 5)), 2)
    data = b"xx" + grib.write_message(grid_, 40.0, 100.0, 0.25, 0.25) + grib.write_message(
        np.full((2, 2), 3.0), -10.0, -5.0, 1.0, 1.0, parameter=9
    )
    a, b = grib.read_messages(data)
    assert np.abs(a["values"].reshape(4, 5) - grid_).max() < 0.01 and (
        a["lat"], a["lon"], a["dx"], a["surface_value"]
    ) == (40.0, 100.0, 0.25, 2.0)
    assert b["values"].tolist() == pytest.approx([3.0] * 4) and (b["lat"], b["lon"], b["parameter"]) == (-10.0, -5.0, 9)
    (tmp_path / "g.grib").write_bytes(data)
    rows = grib.grid_values(spark, str(tmp_path)).collect()
    assert len(rows) == 24 and rows[6]["lat"] == pytest.approx(39.75) and rows[6]["lon"] == pytest.approx(100.25) and rows[6]["value"] == pytest.approx(
        grid_[1, 1], abs=0.01
    )
    with pytest.raises(ValueError):
        grib.read_messages(data.replace(b"\xff\x00\x00", b"\x00\x00\x00", 1).replace(b"\x06\xff", b"\x06\x00"))


def test_readers(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {
            "type": "Feature",
            "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]], [[0, 0], [1, 1]]]},
            "properties": {"name": "p"}
        },
        {
            "type": "Feature",
            "geometry": {
                "type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]], [[[5, 5], [6, 5], [6, 6]]]]
            },
            "properties": {}
        },
        {
            "type": "Feature", "geometry": {"type": "Point", "coordinates": [110, 30]},
            "properties": {"radiusKm": 2, "acqTimeUtc": "2026-01-01T04:00:00Z"}
        },
        {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, "properties": {}},
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(fc))
    assert sorted(len(q["rings"]) for q in readers.polygons(spark, str(tmp_path / "a.geojson")).collect()) == [1, 1, 1]
    assert readers.points(spark, str(tmp_path / "a.geojson")).count() == 3
    assert [
        q["acq_ts"].hour for q in readers.candidates(spark, str(tmp_path / "a.geojson")).collect()
    ] == [DAY.astimezone().hour]
    (tmp_path / "s.csv").write_text("LON,lat,radius_km\n100,30,1.5\nx,30,1\n")
    point, polygon = readers.thermal_sources(spark, [str(tmp_path / "a.geojson"), str(tmp_path / "s.csv")])
    assert {(q["lon"], q["radius_km"]) for q in point.collect()} == {
        (110.0, 2.0), (1.0, None), (3.0, None), (100.0, 1.5)
    } and polygon.count() == 3
    with pytest.raises(ValueError):
        readers.thermal_sources(spark, [])
    (tmp_path / "fires").mkdir()
    (tmp_path / "fires" / "MODIS_7d.csv").write_text(
        "﻿latitude,longitude,scan,track,acq_date,acq_time,confidence,frp\n30,110,1,1,2026-01-01,5,55,3.5\n30,bad,1,1,2026-01-01,5,55,3\n"
    )
    (f,) = readers.active_fires(spark, str(tmp_path / "fires")).collect()
    assert (f["sensor"], f["lon"], f["frp"], f["id"]) == (
        "MODIS", 110.0, 3.5, "MODIS-202601010005-110.000000-30.000000"
    )
    (tmp_path / "plants.csv").write_text(
        "country,name,gppd_idnr,capacity_mw,latitude,longitude,primary_fuel\nCHN,b,2,100,30,110,Solar\nchn,a,1,5,30,110,solar\nUSA,c,3,5,30,110,Solar\nCHN,d,4,5,30,110,Coal\n"
    )
    assert [
        (q["name"], q["radius_km"]) for q in readers.solar_plants(spark, str(tmp_path / "plants.csv")).collect()
    ] == [("a", 0.25), ("b", 0.954)]


def test_rasters(spark, tmp_path):
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    x[1, 2] = np.nan
    (tmp_path / "a.bin").write_bytes(x.tobytes())
    got = {
        (q["row"], q["col"]): q["value"] for q in readers.float_raster(
            spark, str(tmp_path / "a.bin"), 3, 2, "s", "B07"
        ).collect()
    }
    assert got[(0, 2)] == 2.0 and got[(1, 2)] is None and len(got) == 6
    (tmp_path / "a.json").write_text("[1, 2, 3, 4]")
    assert {
        (q["row"], q["col"]): q["value"] for q in readers.json_raster(spark, str(tmp_path / "a.json"), 2, 2).collect()
    }[(1, 0)] == 3.0
    np.savez(tmp_path / "a.npz", data=np.eye(2))
    assert readers.numpy_raster(spark, str(tmp_path / "a.npz"), (2, 2)).filter("value = 1").count() == 2
    for bad in (
        lambda: readers.float_raster(spark, str(tmp_path / "a.bin"), 4, 2, "s", "b"),
        lambda: readers.json_raster(spark, str(tmp_path / "a.json"), 3, 2),
        lambda: readers.numpy_raster(spark, str(tmp_path / "a.npz"), (3, 3))
    ):
        with pytest.raises(Exception, match="raster"):
            bad().count()


def test_sinks(spark, tmp_path):
    fires = spark.createDataFrame(
        [("s1", 1, 100.0, 30.0, 4.0, None, (1, "x"))],
        "scene_id string, fire_id int, lon double, lat double, score double, frp double, diagnostics struct<n:int,tier:string>"
    )
    (row,) = sinks.feature_collection(fires, sinks.point_geometry()).collect()
    feature = json.loads(row["json"])["features"][0]
    assert feature["geometry"] == {
        "type": "Point", "coordinates": [100.0, 30.0]
    } and feature["properties"]["tier"] == "x" and feature["properties"]["frp"] is None
    assert json.loads(
        sinks.feature_collection(fires.limit(0), sinks.point_geometry()).first()["json"]
    )["features"] == []
    path = str(tmp_path / "t")
    both = fires.unionByName(fires.withColumn("scene_id", F.lit("s2")))
    sinks.write_scene(both, path)
    sinks.write_scene(both.filter("scene_id = 's1'").withColumn("score", F.lit(9.0)), path, ["s1", "s2"])
    assert [(q["scene_id"], q["score"]) for q in spark.read.parquet(path).collect()] == [("s1", 9.0)]
    sinks.publish(both, str(tmp_path / "p"))
    sinks.publish(fires, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    px = spark.createDataFrame(
        [(0, 0, True, False), (1, 1, False, True)], "row int, col int, clear boolean, cloud boolean"
    )
    import io

    z = np.load(
        io.BytesIO(
            sinks.grid_file(
                px, spark.createDataFrame([(1, 0, 2.5)], "row int, col int, score double"), 2, 2, 10, 20, "t"
            )
        )
    )
    assert z[
        "observation_valid"
    ].tolist() == [[1, 0], [0, 0]] and z["cloud_mask"][1, 1] == 1 and z["fire_score"][1, 0] == 2.5 and z["line_start"] == 10


# ------------------------------------------------------------------ whole flows and streams


def test_scene_from_pixels_to_areas(spark):
    hot = {
        (4, 4): {"b07": 340.0, "b13": 292.0, "b14": 290.0}, (4, 5): {"b07": 338.0, "b13": 292.0, "b14": 290.0},
        (12, 12): {"b07": 339.0, "b13": 292.0, "b14": 290.0}
    }
    frame = grid(spark, 17, change=hot)
    refs = spark.createDataFrame([("r", "VIIRS", 100.04, 30.04, DAY, "n", 5.0, 0.4, 0.4)], REF)
    out = scene.detect(frame, references=refs, c=scene.SceneConfig(thresholds=T, west_model=FOREST))
    assert out.fires.count() == 3 and out.areas.count() == 1 and out.areas.first()["cluster_status"] == "confirmed"
    kept = {(q["row"], q["col"]): q for q in out.selected.collect()}
    assert len(kept) == 2 and all(q["score_source"] == "west-model" for q in kept.values()) and out.state.count() > 0
    assert scene.replay(frame, frame.select("acq_ts").distinct(), scene.SceneConfig(thresholds=T)).fires.count() == 0
    sources = spark.createDataFrame([(100.12, 30.12, 0.5)], "lon double, lat double, radius_km double")
    assert scene.detect(frame, sources, c=scene.SceneConfig(thresholds=T)).fires.count() == 2


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("s1", 1, 100.01, 30.01, 300.0, 20.0, 1.0, 5), ("s2", 2, 100.01, 30.01, 310.0, 20.0, 1.0, 6)]
    schema = "scene_id string, fire_id long, center_lon double, center_lat double, max_bt07_k double, max_t713_k double, cand_area double, slot_ord int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    double = lambda b: b.withColumn("max_bt07_k", F.col("max_bt07_k") * 2)
    for k in (1, 2):  # a replay changes nothing
        scenes.run_scenes(stream, double, str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination()
    assert sorted(q["max_bt07_k"] for q in spark.read.parquet(str(tmp_path / "out")).collect()) == [600.0, 620.0]
    scenes.run_scenes(
        stream, lambda b: b.select("no_such"), str(tmp_path / "out"), str(tmp_path / "c3")
    ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    scenes.roll_state(stream, str(tmp_path / "state"), str(tmp_path / "c4"), keep=1).awaitTermination()
    assert [q["slot_ord"] for q in scenes.latest_state(spark, str(tmp_path / "state")).collect()] == [6]
    late = [(t0 + dt.timedelta(minutes=m), float(m)) for m in (0, 3, 12, 300)]
    spark.createDataFrame(late, "ts timestamp, value double").write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "ev"))
    out = []
    scenes.slot_counts(events).writeStream.outputMode("append").foreachBatch(
        lambda b, _: out.extend(b.collect())
    ).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c5")
    ).start().awaitTermination()
    assert sorted(q["n"] for q in out) == [1, 2]  # the last slot stays open under the watermark
    seen = []
    scenes.distinct_events(events, ["value"]).writeStream.foreachBatch(
        lambda b, _: seen.extend(b.collect())
    ).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c6")
    ).start().awaitTermination()
    assert len(seen) == 4


def test_queries_are_registered_with_their_sql():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 55


def test_serving_and_schemas(spark):
    from emberframe.functions import serving
    from emberframe.sources import schema

    assert [
        value(spark, serving.symbol_size(F.lit(x).cast("double"))) for x in (0.1, 2.0, 3.0, 9.0, None)
    ] == [7.0, 10.0, 12.0, 14.0, None]
    assert [value(spark, serving.next_forecast_hour(F.lit(h))) for h in (0, 69, 72)] == [3, 72, 0]
    assert value(spark, serving.frame_time(F.lit(DAY), F.lit(-5), F.lit(None).cast("long"), F.lit(10))) == 10
    assert serving.merged_config({"a": 1, "ftp": {"x": 1}}, {"ftp": {"y": 2}}) == {
        "a": 1, "ftp": {"x": 1, "y": 2}, "variables": {}
    }
    grid_ = spark.createDataFrame([(100.0, 30.0, 1.0), (100.5, 30.0, 2.0)], "lon double, lat double, t double")
    points = spark.createDataFrame([(1, 100.3, 30.1), (2, 10.0, 10.0)], "key long, lon double, lat double")
    assert {q["key"]: q["grid_t"] for q in serving.value_at(points, grid_, 0.5, 0.5).collect()} == {1: 2.0, 2: None}
    assert all(schema.empty(spark, r).count() == 0 for r in schema.DDL)
    got = schema.conformed(points.withColumn("extra", F.lit(1)), "thermal_point")
    assert got.columns == ["lon", "lat", "radius_km", "key", "extra"] and got.first()["radius_km"] is None


def test_latest_cycle_and_expiry(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, cycle int")
    assert [q["cycle"] for q in catalog.latest_available(wanted, wanted.filter("cycle < 3"), "cycle").collect()] == [2]
    assert catalog.latest_available(wanted, wanted.limit(0), "cycle").count() == 0
    rows = spark.createDataFrame(
        [(1, DAY, NIGHT, "x/1"), (2, None, DAY, "x/2"), (3, None, DAY, "y/3"), (4, NIGHT, DAY, "x/4")],
        "k int, acq_ts timestamp, download_time timestamp, path string"
    )
    assert {q["k"] for q in catalog.expired(rows, F.lit(NIGHT), prefix=("path", "x/")).collect()} == {1, 2}
    assert {q["k"] for q in catalog.staleness(rows, F.lit(NIGHT), 20).filter("stale").collect()} == {1}
    assert {q["k"] for q in catalog.recent(rows, F.lit(NIGHT), 20, lookback=1).collect()} == {4}
    ids = catalog.scene_ids(
        rows.withColumn("scene_id", F.lit(0)),
        spark.createDataFrame([(7, DAY), (9, DAY)], "scene_id int, acq_ts timestamp")
    )
    assert {q["k"]: q["scene_id"] for q in ids.collect()} == {1: 9, 2: None, 3: None, 4: None}
