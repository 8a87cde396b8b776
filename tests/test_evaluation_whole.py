"""The validation against official detections, all three windows, against plain Python on the same tables."""

import datetime as dt
import math
import random
import statistics

from emberframe.operators import evaluation

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def km(a, b):
    (x, y), (u, v) = [[math.radians(q) for q in p] for p in (a, b)]
    return 2 * 6371.0 * math.asin(math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2))


def tables(seed=1):
    """Candidates (id, lon, lat, at) and detections (id, sensor, lon, lat, at, frp), some of them far in time or place."""
    rng = random.Random(seed)
    cands = [(k, rng.uniform(100, 100.6), rng.uniform(30, 30.6), T0 + dt.timedelta(minutes=rng.randrange(60))) for k in range(40)]
    refs = []
    for k in range(90):
        _, lon, lat, at = rng.choice(cands)
        refs.append((
            f"r{k:03d}", rng.choice("AB"), lon + rng.uniform(-0.06, 0.06), lat + rng.uniform(-0.05, 0.05),
            at + dt.timedelta(minutes=rng.choice([0, 10, 45, 100, 170, 250, 340, 500])), rng.choice([None, 0.0, -3.0, 7.5, 40.0])
        ))
    refs += [("r990", "A", *refs[0][2:]), ("r991", "C", 101.5, 31.5, T0, 1.0)]
    return cands, refs


def brute(cands, refs, hours, reach=5.0, cluster_km=2.5, minutes=30.0):
    near = [r for r in refs if any(abs((r[4] - c[3]).total_seconds()) <= hours * 3600 for c in cands)]
    top = {r[0]: r[0] for r in near}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a in near:
        for b in near:
            if a[0] < b[0] and abs((a[4] - b[4]).total_seconds()) <= minutes * 60 and km(a[2:4], b[2:4]) <= cluster_km:
                x, y = find(a[0]), find(b[0])
                top[max(x, y)] = min(x, y)
    groups = {}
    for r in near:
        groups.setdefault(find(r[0]), []).append(r)
    clusters = []
    for name, g in groups.items():
        w = [max(r[5] or 0.0, 0.0) + 1 for r in g]
        mean = lambda k: sum(r[k] * v for r, v in zip(g, w)) / sum(w)  # noqa: B023,E731
        at = sum((r[4] - T0).total_seconds() * v for r, v in zip(g, w)) / sum(w)
        clusters.append((name, mean(2), mean(3), T0 + dt.timedelta(seconds=at)))
    pairs = []
    for c in cands:
        for r in clusters:
            d, t = km(c[1:3], r[1:3]), abs((c[3] - r[3]).total_seconds()) / 3600
            if d <= reach and t <= hours:
                pairs.append((d, t, c[0], r[0]))
    used_c, used_r, matches = set(), set(), []
    for d, t, c, r in sorted(pairs):
        if c not in used_c and r not in used_r:
            used_c.add(c)
            used_r.add(r)
            matches.append((c, r, round(d, 3), round(t, 3)))
    least = [min(km(c[1:3], r[1:3]) for r in clusters) for c in cands] if clusters else []
    n, fp, fn = len(matches), len(cands) - len(matches), len(clusters) - len(matches)
    box = lambda rows, p: {
        f"{p}_{m}_{name}": round(f(r[k] for r in rows), 6) for m, f in (("min", min), ("max", max)) for k, name in ((1, "lon"), (2, "lat"))
    }
    return matches, {
        "candidate_count": len(cands), "reference_count": len(clusters), "true_positive": n, "false_positive": fp,
        "false_negative": fn, "precision": round(n / max(n + fp, 1), 4), "recall": round(n / max(n + fn, 1), 4),
        "commission_rate": round(1 - n / max(n + fp, 1), 4), "omission_rate": round(1 - n / max(n + fn, 1), 4),
        "distance_min": round(min(least), 3), "distance_median": round(statistics.median(least), 3), "distance_max": round(max(least), 3),
        "status": "provisional", "time_window_hours": float(hours), "spatial_match_km": reach
    } | box(cands, "candidate") | box(clusters, "reference")


def frames(spark, cands, refs):
    return (
        spark.createDataFrame(cands, "id long, lon double, lat double, acq_ts timestamp"),
        spark.createDataFrame(refs, "id string, sensor string, lon double, lat double, acq_ts timestamp, frp double")
    )


def test_metrics_of_every_window(spark):
    cands, refs = tables()
    got = {r["time_window_hours"]: r.asDict() for r in evaluation.evaluate(*frames(spark, cands, refs)).collect()}
    assert sorted(got) == [1.0, 3.0, 6.0]
    for hours in (1, 3, 6):
        matches, want = brute(cands, refs, hours)
        row = got[float(hours)]
        assert row.keys() == want.keys() and len(matches) > 5
        for name, v in want.items():
            assert row[name] == v or abs(row[name] - v) <= 0.0011 if isinstance(v, float) else row[name] == v, (hours, name, row[name], v)


def test_tags_of_matches(spark):
    from emberframe.operators.clusters import reference_clusters

    cands, refs = tables(4)
    c, r = frames(spark, cands, refs)
    clusters = reference_clusters(r)
    m = evaluation.match(c, clusters, 5.0, 6.0, rounds=2).cache()
    have = {(q["id"], q["r_id"]) for q in m.collect()}
    assert have == set(brute_matches(cands, refs)) and len(have) > 10
    tags = evaluation.tagged(c, clusters, m).collect()
    assert {int(t["id"]) for t in tags if t["tag"] == "true-positive"} == {a for a, _ in have}
    assert {t["id"] for t in tags if t["tag"] == "matched-reference"} == {b for _, b in have}
    assert sum(t["tag"].startswith("apparent") for t in tags) == len(cands) + clusters.count() - 2 * len(have)


def brute_matches(cands, refs):
    """Matches within six hours of clusters of all detections."""
    far = [*cands, (-1, 0.0, 0.0, T0 + dt.timedelta(hours=6))]  # makes every detection near some candidate in time
    matches, _ = brute(far, refs, 6.0)
    return [(c, r) for c, r, *_ in matches]
