"""Streams that keep state by key, against the operators over whole tables."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from emberframe.operators import spatial, temporal
from emberframe.streaming import state

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
CANDIDATE = "fire_id long, center_lon double, center_lat double, slot_ord int, max_bt07_k double, max_t713_k double, cand_area double"
FIRE = "fire_id long, lon double, lat double, acq_ts timestamp"
REF = "id string, sensor string, lon double, lat double, acq_ts timestamp, confidence string, frp double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKS)
    yield spark
    spark.conf.set(key, before)


def batches(spark, folder, schema, parts):
    """A stream that reads the parts in order, one a batch."""
    folder.mkdir(exist_ok=True)
    for k, rows in enumerate(parts):
        made = folder.parent / f"{folder.name}-{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(made))
        (file,) = made.glob("*.parquet")
        os.utime(file.rename(folder / f"{k}.parquet"), (1e9 + k, 1e9 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, checkpoint, mode="append"):
    seen = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: seen.append(b.collect())).option(
        "checkpointLocation", str(checkpoint)
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen, query


def candidates(slots, n=30, seed=3):
    rng = random.Random(seed)
    rows = []
    for s in slots:
        rows.append([
            (1000 * s + k, 100 + rng.randrange(5) * 0.05 + 0.01, 30 + rng.randrange(3) * 0.05 + 0.01, s, 300.0 + rng.randrange(90),
             float(rng.randrange(40)), float(rng.randrange(1, 9))) for k in range(n)
        ])
    return rows


def test_grid_features_are_those_of_the_whole_state(rocks, tmp_path):
    parts = candidates([10, 11, 12, 14, 15, 16])
    parts[2] += [(99_001, None, 30.01, 12, 310.0, None, None), (99_002, 100.01, 30.01, 12, None, None, None)]
    seen, query = run(state.grid_features(batches(rocks, tmp_path / "in", CANDIDATE, parts)), tmp_path / "c")
    rows = [r for b in seen for r in b]
    whole = rocks.createDataFrame([r for p in parts for r in p if r[1]], CANDIDATE)
    grid = temporal.grid_state(whole)
    cell = lambda r, *v: (r["glon"], r["glat"], r["slot_ord"], *(r[n] for n in v))
    names = ("max_bt07_k", "max_t713_k", "n_cand", "max_area")
    assert {cell(r, *names) for r in rows} == {cell(r, *names) for r in grid.collect()}
    wanted = [f"{state.NAMES[v]}_m{-k}" for v in names for k in state.PAST]
    lags = {r["fire_id"]: [r[n] for n in wanted] for r in temporal.lag_features(whole, grid, "fire_id", state.PAST).collect()}
    assert len(rows) == len(lags) and {r["fire_id"]: [r[n] for n in wanted] for r in rows} == lags
    assert any(any(v) for v in lags.values())


def test_slots_are_freed_and_replaced(rocks, tmp_path):
    one = lambda k, slot, t, lon=100.01: (k, lon, 30.01, slot, t, 1.0, 1.0)
    parts = [
        [one(1, 100, 300.0), one(2, 100, 301.0), one(9, 100, 333.0, 101.01)], [one(3, 100, 290.0)], [one(4, 101, 310.0)],
        [one(5, 106, 320.0)], [one(6, 120, 330.0)], [one(7, 100, 340.0)], [one(8, 121, 331.0)]
    ]
    df = state.grid_features(batches(rocks, tmp_path / "in", CANDIDATE, parts), keep=4, late_minutes=30, lags=(-1, -6))
    seen, query = run(df, tmp_path / "c")
    got = {r["fire_id"]: r for b in seen for r in b}
    assert got[1]["max_bt07_k"] == 301.0 and got[1]["n_cand"] == 2
    assert (got[3]["max_bt07_k"], got[3]["n_cand"]) == (290.0, 1)  # the slot came again
    assert got[4]["temp_bt07_m1"] == 290.0 and got[4]["temp_n_m1"] == 1
    assert got[5]["temp_bt07_m6"] == 290.0  # at slot 106 the watermark is still that of slot 101
    assert got[6]["temp_bt07_m1"] == 0 and 7 not in got and got[8]["temp_bt07_m1"] == 330.0
    added, _ = run(
        state.grid_features(rocks.readStream.schema(CANDIDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), replace=False),
        tmp_path / "d"
    )
    assert {r["fire_id"]: (r["max_bt07_k"], r["n_cand"]) for b in added for r in b}[3] == (301.0, 3)
    rows = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert rows <= 8, rows  # of nine slots, those of two are left, with their timers


def fires_and_references(n=120, seed=5):
    rng = random.Random(seed)
    fires = [(k, 179.9 + rng.random() * 0.2 - 360 * (k % 2), 60 + rng.random() * 0.3, T0 + dt.timedelta(minutes=rng.randrange(600))) for k in range(n)]
    fires = [(k, lon if -180 <= lon <= 180 else (lon - 360 if lon > 180 else lon + 360), lat, at) for k, lon, lat, at in fires]
    refs = []
    for k, (_, lon, lat, at) in enumerate(fires[: n // 2]):
        for c in range(rng.randrange(3)):
            moved = lon + rng.uniform(-0.09, 0.09)
            moved = moved - 360 if moved > 180 else moved + 360 if moved < -180 else moved
            refs.append((f"r{k}-{c}", "VIIRS", moved, lat + rng.uniform(-0.04, 0.04), at + dt.timedelta(minutes=rng.uniform(-200, 200)), "n", 1.0))
    refs += [("tie-b", *refs[0][1:]), ("tie-a", *refs[0][1:])]
    return fires, refs


def test_fires_with_and_without_detections(spark, tmp_path):
    fires, refs = fires_and_references()
    fires += [(900, None, 60.0, T0), (901, 10.0, None, T0)]
    last = T0 + dt.timedelta(days=3)
    deal = lambda rows, at: [[r for r in rows if a <= (r[at] - T0).total_seconds() / 3600 < b] for a, b in ((-9, 3), (3, 6), (6, 20))]
    f = batches(spark, tmp_path / "f", FIRE, deal(fires, 3) + [[(999, 0.0, 0.0, last)]])
    r = batches(spark, tmp_path / "r", REF, deal(refs, 4) + [[("end", "VIIRS", 50.0, 0.0, last, "n", 1.0)]])
    seen, query = run(state.fuse_stream(f, r, late_minutes=240), tmp_path / "c")
    rows = [q for b in seen for q in b]
    assert len({q["fire_id"] for q in rows}) == len(rows)
    want = spatial.nearest_reference(spark.createDataFrame(fires, FIRE), spark.createDataFrame(refs, REF))
    names = [c for c in want.columns]
    key = lambda d: sorted(str([q[n] for n in names]) for q in d)
    assert key(rows) == key(want.collect())
    confirmed = sum(q["official_confirmed"] for q in rows)
    assert 20 < confirmed < len(rows) - 10
    borders = [q for q in rows if q["official_confirmed"] and abs(q["lon"]) > 179.95]
    assert borders


def test_stream_equals_whole_tables(spark, tmp_path):
    """All fires and detections of the registered queries, dealt by time."""
    from emberframe.plans import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    fires = queries.spots(spark, d).select(F.col("fire_id").cast("long").alias("fire_id"), "lon", "lat", "acq_ts")
    refs = queries.refs(spark, d).select(
        F.col("id").cast("string").alias("id"), "sensor", "lon", "lat", "acq_ts", F.lit("n").alias("confidence"), "frp"
    )
    want = spatial.nearest_reference(fires, refs)
    last = max(fires.agg(F.max("acq_ts")).first()[0], refs.agg(F.max("acq_ts")).first()[0]) + dt.timedelta(days=9)
    for name, df, end in (
        ("f", fires, [(-1, 0.0, 0.0, last)]), ("r", refs, [("end", "V", 50.0, 0.0, last, "n", 1.0)])
    ):
        df.write.parquet(str(tmp_path / name))
        spark.createDataFrame(end, df.schema).write.parquet(str(tmp_path / f"{name}-end"))
        (tmp_path / name / "_SUCCESS").unlink()
        for file in (tmp_path / name).glob("*.parquet"):
            os.utime(file, (1e9, 1e9))
        for k, file in enumerate((tmp_path / f"{name}-end").glob("*.parquet")):
            os.utime(file.rename(tmp_path / name / f"end-{k}.parquet"), (2e9, 2e9))
    n = {x: len(list((tmp_path / x).glob("part*.parquet"))) for x in ("f", "r")}
    read = lambda x, s: spark.readStream.schema(s).option("maxFilesPerTrigger", n[x]).parquet(str(tmp_path / x))
    seen, _ = run(state.fuse_stream(read("f", fires.schema), read("r", refs.schema)), tmp_path / "c")
    key = lambda rows: sorted(str([q[c] for c in want.columns]) for q in rows)
    assert key([q for b in seen for q in b]) == key(want.collect())
