"""Points in polygons by quadtree cells, against the test of every edge."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from emberframe.functions.geo import point_in_polygon
from emberframe.operators import cover, spatial

RINGS = "array<array<struct<x: double, y: double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def coast(n, x, y, r, seed):
    """A ragged ring of n vertices."""
    rng = random.Random(seed)
    out, away = [], 1.0
    for k in range(n):
        away = min(max(away + rng.uniform(-0.03, 0.03), 0.5), 1.4)
        out.append((x + r * away * math.cos(2 * math.pi * k / n), y + r * away * math.sin(2 * math.pi * k / n)))
    return ring(out)


POLYGONS = [
    (1, [coast(6000, 100, 35, 12, 1), coast(900, 102, 36, 2, 2), coast(40, 95, 33, 1, 3), coast(30, 150, 35, 3, 9)]),
    (2, [ring([(90, 20), (110, 20), (110, 50), (90, 50), (90, 20)])]),
    (3, [ring([(100, 30), (130, 31), (100, 30.0001)])]), (4, [ring([(101, 33), (101, 33)])]), (5, []),
    (6, [ring([(95, 30), (105, 30), (100, 40), (95, 40), (105, 30)])]), (7, [ring([(-180, -90), (180, -90), (180, 90), (-180, 90)])]),
    (8, [coast(200, 99.99, 35.01, 1e-5, 4)]), (9, [coast(50, 170, 0, 30, 5)]),
]


def places():
    rng = random.Random(0)
    out = [(rng.uniform(80, 135), rng.uniform(15, 55)) for _ in range(4000)]
    out += [(p["x"], p["y"]) for _, rings in POLYGONS for r in rings for p in r[::25]]  # on vertices
    for _, rings in POLYGONS[:2]:  # and beside them
        out += [(p["x"] + rng.uniform(-1e-3, 1e-3), p["y"] + rng.uniform(-1e-3, 1e-3)) for p in rings[0][::4]]
    size = 360 / 2**10
    out += [(i * size - 180 + 279 * size * 2, j * size - 180 + 300 * size * 2) for i in range(40) for j in range(40)]  # on corners of cells
    return [(k, x, y) for k, (x, y) in enumerate(out)] + [(10**6, None, 30.0), (10**6 + 1, 100.0, None)]


def test_cells_give_what_every_edge_gives(spark):
    polygons = spark.createDataFrame(POLYGONS, f"polygon_id int, rings {RINGS}")
    points = spark.createDataFrame(places(), "key long, lon double, lat double").repartition(4)
    got = spatial.within_polygons(points, polygons, "key").collect()
    want = points.crossJoin(polygons).filter(point_in_polygon(F.col("rings"), "lon", "lat")).select("key", "polygon_id").collect()
    assert len(want) > 3000 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_interior_cells_test_no_edge(spark):
    """Interior cells have no edges to test, boundary cells a small part; most points fall in interior cells."""
    numbered = spark.createDataFrame([(1, POLYGONS[0][1])], f"polygon long, rings {RINGS}")
    cells = cover.cover(numbered).cache()
    assert cells.filter("interior and edges is not null").count() == 0
    n = cells.filter("not interior").select(F.avg(F.size(F.flatten("edges")))).first()[0]
    assert n < 6970 / 10
    hits = cover.covered(spark.createDataFrame(places(), "key long, lon double, lat double").filter("key < 4000"), cells, "key")
    inside, all_ = hits.filter("interior").count(), hits.count()
    assert inside > 0.7 * all_ > 100
    kinds = {r["level"]: r["n"] for r in cells.filter("interior").groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert len(kinds) >= 3  # wider cells in the middle
    area = sum(n * (360 / 2**k) ** 2 for k, n in kinds.items())
    x, y = np.array([(p["x"], p["y"]) for p in POLYGONS[0][1][0]]).T
    whole = abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))) / 2
    assert 0.6 * whole < area < whole


def test_cells_as_wide_as_asked(spark):
    numbered = spark.createDataFrame([(1, POLYGONS[1][1])], f"polygon long, rings {RINGS}")
    assert cover.cover(numbered, 0.1).filter("not interior").select(F.min("level")).first()[0] >= math.log2(3600)
    assert cover.cover(numbered.limit(0)).count() == 0
    points = spark.createDataFrame([(1, 100.0, 30.0)], "key long, lon double, lat double")
    assert spatial.within_polygons(points, numbered.select(F.col("polygon").alias("polygon_id"), "rings").limit(0), "key").count() == 0
