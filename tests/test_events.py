"""Fire events scene by scene, against the events of all scenes at once and of all pairs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from emberframe.operators import clusters, events, graphs

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def km(a, b):
    (x, y), (u, v) = [[math.radians(q) for q in p] for p in (a, b)]
    return 2 * 6371.0 * math.asin(math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2))


def moving(n=12, slots=20, seed=4):
    """Fires that move, stop, start again and run into each other, near the date line."""
    rng = random.Random(seed)
    at = [[rng.uniform(0, 0.5), rng.uniform(0, 0.3)] for _ in range(n)]
    rows = []
    for s in range(slots):
        for k, p in enumerate(at):
            p[0] += rng.uniform(-0.03, 0.03)
            p[1] += rng.uniform(-0.03, 0.03)
            if rng.random() < 0.6:
                lon = 179.8 + p[0]
                rows.append((rng.randrange(10**9), lon if lon <= 180 else lon - 360, 50 + p[1], T0 + dt.timedelta(minutes=10 * s + rng.randrange(3)), rng.random()))
    return rows


def brute(rows, reach=4.0, minutes=25.0):
    top = list(range(len(rows)))

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            if abs((rows[a][3] - rows[b][3]).total_seconds()) <= minutes * 60 and km(rows[a][1:3], rows[b][1:3]) <= reach:
                top[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    return {
        min(r[0] for r in g): (min(r[3] for r in g), max(r[3] for r in g), len({r[3] for r in g}), len(g), max(r[4] for r in g))
        for g in groups.values()
    }


def told(df):
    return {
        r["event_id"]: (r["first_seen"].astimezone(dt.timezone.utc), r["last_seen"].astimezone(dt.timezone.utc), r["persistence_count"], r["fire_count"], r["max_score"])
        for r in df.collect()
    }


@pytest.mark.parametrize("text", [False, True])
def test_events_scene_by_scene(spark, text):
    rows = moving(slots=8 if text else 14)
    if text:
        rows = [(f"f{i:010d}", *r) for i, *r in rows]
    schema = f"fire_id {'string' if text else 'long'}, lon double, lat double, acq_ts timestamp, score double"
    df = spark.createDataFrame(rows, schema)
    want = brute(rows)
    assert 3 < len(want) < len(rows)
    extra = spark.createDataFrame([rows[0], (None, *rows[0][1:]), (rows[0][0], None, None, None, None)], schema)
    assert told(events.fire_events(df.unionByName(extra.filter("lon is not null")), 4.0, 25.0)) == want
    state, log = events.start(df), None
    most = 0
    slots = sorted({(r[3] - T0).total_seconds() // 600 for r in rows})
    for n, s in enumerate(slots):
        part = [r for r in rows if (r[3] - T0).total_seconds() // 600 == s]
        state, changes = events.advance(state, spark.createDataFrame(part, schema), 4.0, 25.0)
        changes = changes.withColumn("batch", F.lit(n))
        log = changes if log is None else log.unionByName(changes)
        most = max(most, state.open.count())
        if n == 5:  # a scene that comes again changes nothing
            again, none = events.advance(state, spark.createDataFrame(part, schema), 4.0, 25.0)
            assert none.count() == 0 and again.open.count() == state.open.count()
    assert told(events.current_events(log)) == want
    assert log.filter("merged_into is not null").count() > 0 and most < len(rows) / 2
    assert events.advance(events.start(df), df.limit(0))[1].count() == 0


def test_events_of_late_scenes(spark):
    rows = moving(n=8, slots=9, seed=7)
    schema = "fire_id long, lon double, lat double, acq_ts timestamp, score double"
    order = [0, 1, 3, 2, 5, 4, 6, 8, 7]
    state, log = events.start(spark.createDataFrame(rows, schema)), None
    for n, s in enumerate(order):
        part = spark.createDataFrame([r for r in rows if (r[3] - T0).total_seconds() // 600 == s], schema)
        state, changes = events.advance(state, part, 4.0, 25.0, late_minutes=25)
        changes = changes.withColumn("batch", F.lit(n))
        log = changes if log is None else log.unionByName(changes)
    assert told(events.current_events(log)) == brute(rows)


@pytest.mark.parametrize("minutes", [None, 30.0])
def test_chains_are_those_of_all_pairs(spark, minutes):
    rng = random.Random(2)
    rows = [(k, rng.uniform(-180, 180), rng.choice([-89.99, 89.995, 0.0]) , T0) for k in range(20)]
    for k in range(20, 200):
        lon, lat = rng.uniform(179.9, 180.1), 70 + rng.uniform(0, 0.15)
        rows.append((k, lon if lon <= 180 else lon - 360, lat, T0 + dt.timedelta(minutes=rng.choice([0, 0, 29.5, 30, 31, 90, 3000]))))
    rows += [(k, 10.0, 10.0, T0) for k in range(200, 400)]  # one place, many times
    rows += [(500, None, 1.0, T0), (501, 1.0, None, T0)] + ([(502, 10.0, 10.0, None)] if minutes else [])
    df = spark.createDataFrame(rows, "id long, lon double, lat double, acq_ts timestamp")
    edges = clusters.chain_edges(df, 1.5, minutes)
    assert edges.count() < 1500  # the many of one place are no pairs
    got = {r["id"]: r["component"] for r in graphs.connected_components(df.select("id"), edges).collect()}
    top = {r[0]: r[0] for r in rows}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a in rows:
        for b in rows:
            if a[0] < b[0] and None not in (*a[:3], *b[:3]) and km(a[1:3], b[1:3]) <= 1.5:
                if minutes is None or (a[3] and b[3] and abs((a[3] - b[3]).total_seconds()) <= minutes * 60):
                    x, y = find(a[0]), find(b[0])
                    top[max(x, y)] = min(x, y)
    assert got == {r[0]: find(r[0]) for r in rows}


def test_events_of_scenes_that_follow_each_other_by_half_an_hour(spark, tmp_path):
    """Scene 39 of the first fifth of users is 30 minutes from scene 0 of the last: they stay apart, as in the SQL."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from emberframe.plans import queries

    ids, users = [0, 1, 97500, 97501, 97502], [4, 4, 5, 5, None]
    pq.write_table(
        pa.table({
            "event_id": ids, "user_id": pa.array(users, pa.int64()), "event_type": ["view"] * 5, "value": [400.0] * 5
        }),
        tmp_path / "events.parquet"
    )
    got = sorted(tuple(r) for r in queries.QUERIES["fire_events"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL["fire_events"]).fetchall())
    assert [r[0] for r in got] == [0, 97500]
