"""Queries over whole tables, on small tables of their own."""

import datetime as dt
import math

from emberframe.operators import spatial
from emberframe.plans import queries


def tables(folder, events=400, orders=300, suppliers=30):
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = dt.datetime(2026, 1, 1)
    pq.write_table(
        pa.table(
            {
                "event_id": list(range(events)), "ts": [at] * events, "user_id": [1] * events,
                "event_type": ["view"] * events, "value": [float(k * 37 % 400) for k in range(events)]
            }
        ),
        folder / "events.parquet"
    )
    pq.write_table(pa.table({"o_orderkey": list(range(1, orders + 1))}), folder / "orders.parquet")
    pq.write_table(pa.table({"s_suppkey": list(range(1, suppliers + 1))}), folder / "supplier.parquet")
    return str(folder)


def km(a, b):
    (x, y), (u, v) = [[math.radians(q) for q in p] for p in (a, b)]
    return 2 * 6371.0 * math.asin(
        math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)
    )


def test_nearest_of_all_references(spark, tmp_path):
    d = tables(tmp_path)
    places = [(104.5 + k * 37 % 9973 / 9973, 30 + k * 91 % 9967 / 9967) for k in range(1, 301)]
    spots = {s["fire_id"]: (s["lon"], s["lat"]) for s in queries.spots(spark, d).collect()}
    got = {q["fire_id"]: q["km"] for q in queries.QUERIES["nearest_distance"](spark, d).collect()}
    assert spots and got.keys() == spots.keys()
    assert all(abs(got[k] - min(km(p, q) for q in places)) <= 0.0011 for k, p in spots.items())


def test_every_supplier_is_a_source(spark, tmp_path):
    d = tables(tmp_path)
    sources = [((104.5 + k % 50 * 0.02, 30 + k % 47 * 0.02), (1 + k % 3) * 0.4) for k in range(1, 31)]
    assert queries.heat(spark, d).count() == 30
    spots = {s["fire_id"]: (s["lon"], s["lat"]) for s in queries.spots(spark, d).collect()}
    want = {k for k, p in spots.items() if all(km(p, q) > r for q, r in sources)}
    assert {
        q["fire_id"] for q in queries.QUERIES["static_source_anti"](spark, d).collect()
    } == want and 0 < len(want) < len(spots)


def test_all_windows_and_lags(spark, tmp_path):
    from pyspark.sql import functions as F

    d = tables(tmp_path, events=8 * 2500)
    lags = queries.QUERIES["lag_features"](spark, d)
    assert {"bt07_m6", "bt07_m3", "bt07_m2", "bt07_m1", "bt07_p1", "bt07_p2", "bt07_p3"} <= set(lags.columns)
    r = lags.agg(F.max("persist"), F.max("persist_all"), F.max("bt07_m6")).first()
    assert r[0] == 3 and r[1] > 3 and r[2] > 0


def test_metrics_of_all_windows(spark, tmp_path):
    d = tables(tmp_path, events=200, orders=40)
    assert [
        q["time_window_hours"] for q in queries.QUERIES["eval_match_metrics"](spark, d).collect()
    ] == [1.0, 3.0, 6.0]


def test_wide_sources_are_searched_to_their_radius(spark):
    points = spark.createDataFrame([(1, 110.8, 30.0), (2, 112.0, 30.0)], "key long, lon double, lat double")
    sources = spark.createDataFrame([(110.0, 30.0, 100.0)], "lon double, lat double, radius_km double")
    assert [q["key"] for q in spatial.near_sources(points, sources, "key").collect()] == [1]


def test_a_place_is_looked_up_once_among_few_references(spark, monkeypatch):
    rows = [(k, 100 + k % 5 * 0.02, 30.0) for k in range(500)] + [(500, None, 30.0)]
    points = spark.createDataFrame(rows, "key long, lon double, lat double")
    places = [(100 + k * 37 % 997 / 9970, 30 + k * 91 % 991 / 9910) for k in range(2000)]
    refs = spark.createDataFrame(places, "lon double, lat double")
    rings, join = [], spatial.distance_join

    def counted(left, right, km_, *args, **named):
        rings.append((left.count(), km_))
        return join(left, right, km_, *args, **named)

    monkeypatch.setattr(spatial, "distance_join", counted)
    got = {q["key"]: q["distance_km"] for q in spatial.nearest_distance(points, refs, "key").collect()}
    assert len(got) == 501 and got[500] is None
    assert all(abs(got[k] - min(km((x, y), q) for q in places)) < 1e-9 for k, x, y in rows[:500])
    assert rings[0][0] == 5 and rings[0][1] < 2


def test_polygons_with_the_same_rings_are_cut_once(spark, tmp_path, monkeypatch):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tables(tmp_path, events=2500)
    n = 899 * 3
    pq.write_table(
        pa.table({"s_suppkey": list(range(n, 0, -1)), "s_name": [f"s{k}" for k in range(n)]}), tmp_path / "supplier.parquet"
    )
    cut, cover = [], spatial.cover
    monkeypatch.setattr(spatial, "cover", lambda p, *a: cut.append(p.count()) or cover(p, *a))
    got = sorted((tuple(r) for r in queries.QUERIES["polygon_names"](spark, d).collect()), key=str)
    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL["polygon_names"]).fetchall(), key=str)
    assert cut == [899] and len({r[1] for r in got}) > 100


def test_a_payload_is_parsed_once(spark, tmp_path):
    d = tables(tmp_path)
    plan = queries.QUERIES["forecast_payloads"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1 and plan.count("from_json") == 4  # payload, times, a series, units


def test_chains_of_close_and_scattered_points(spark, monkeypatch):
    """Components as by comparing all pairs; where points lie close, few rows are compared: the cells' first points."""
    import random

    from emberframe.operators import clusters

    draw, t0 = random.Random(5), dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    rows = [
        (k, 100 + draw.random() * w, 30 + draw.random() * w, t0 + dt.timedelta(minutes=draw.randrange(0, m, 10)), k % 2)
        for k, (w, m) in enumerate([(0.5, 600)] * 350 + [(0.05, 30)] * 250)
    ]
    rows += [(0, 99.0, 29.0, t0, 0), (1000, None, 30.0, t0, 0)]
    top = {r[0]: r[0] for r in rows}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a in rows[:-1]:
        for b in rows[:-1]:
            if a[4] == b[4] and abs((a[3] - b[3]).total_seconds()) <= 1800 and km(a[1:3], b[1:3]) <= 2.5:
                p, q = find(a[0]), find(b[0])
                top[max(p, q)] = min(p, q)
    points = spark.createDataFrame(rows, "id long, lon double, lat double, acq_ts timestamp, kind int")
    met, join = [], clusters.distance_join
    monkeypatch.setattr(clusters, "distance_join", lambda a, b, *r, **n: met.append(b.count()) or join(a, b, *r, **n))
    got = {q["id"]: q["component"] for q in clusters.chain_components(points, 2.5, 30.0, ("kind",)).collect()}
    assert got == {k: find(k) for k in top} and 20 < len(set(got.values())) < 500
    assert max(met) < 450


def test_evaluation_keeps_no_lists_of_members(spark, tmp_path, monkeypatch):
    from emberframe.operators import evaluation

    d = tables(tmp_path, orders=50)
    seen, kept = {}, evaluation.kept
    monkeypatch.setattr(evaluation, "kept", lambda df, name: seen.setdefault(name, df.columns) and kept(df, name))
    c = queries.spots(spark, d).selectExpr("fire_id as id", "lon", "lat", "acq_ts")
    evaluation.evaluate(c, queries.refs(spark, d), windows=(1,))
    assert "lon" in seen["clusters"] and "member_ids" not in seen["clusters"]
