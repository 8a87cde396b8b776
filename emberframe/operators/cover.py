"""Polygons as quadtree cells: inside them no vertex is looked at, on their boundary only the edges of the cell's row.

A cell of level k is 360 / 2**k degrees wide and high. A polygon is cut into cells a small part of its extent; those that an edge
may touch are boundary cells and carry the edges that a ray from a point of theirs can cross; of the others, those whose centre
is inside are interior, and four that make up a wider cell become that one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells across a polygon's extent, at least half as many.
ACROSS = 64
#: The finest level: cells of about a metre.
FINEST = 25
EDGES = "array<array<struct<ax: double, ay: double, bx: double, by: double>>>"
COVER = f"polygon bigint, level int, x int, y int, interior boolean, edges {EDGES}"


def _edges(ring: list[dict]) -> np.ndarray:
    """(ax, ay, bx, by) of a ring's edges, each point with the one before."""
    p = np.array([(q["x"], q["y"]) for q in ring], dtype=float).reshape(-1, 2)
    return np.concatenate([p, np.roll(p, 1, axis=0)], axis=1)


def _touched(edges: np.ndarray, size: float, x0: int, y0: int, n: int, m: int) -> np.ndarray:
    """Which of n x m cells, from (x0, y0) on, an edge comes near: by the part of it that lies in each row of cells."""
    out = np.zeros((m, n), dtype=bool)
    margin = 1e-9 * max(1.0, np.abs(edges).max(initial=0)) / size
    e = (edges + 180) / size - np.array([x0, y0, x0, y0])
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first, last = np.floor(low - margin).astype(int), np.floor(high + margin).astype(int)
    which = np.repeat(np.arange(len(e)), last - first + 1)
    row = np.arange(len(which)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[which]
    ax, ay, bx, by = e[which].T
    flat = np.abs(by - ay) < 1e-12
    slope = np.where(flat, 0.0, (bx - ax) / np.where(flat, 1.0, by - ay))
    at = lambda y: ax + slope * (np.clip(y, low[which], high[which]) - ay)
    ends = np.stack([at(row), at(row + 1)])
    ends = np.where(flat, np.stack([ax, bx]), ends)
    left = np.clip(np.floor(ends.min(0) - margin).astype(int), 0, n - 1)
    right = np.clip(np.floor(ends.max(0) + margin).astype(int), 0, n - 1)
    row = np.clip(row, 0, m - 1)
    marks = np.zeros((m, n + 1), dtype=int)
    np.add.at(marks, (row, left), 1)
    np.add.at(marks, (row, right + 1), -1)
    out |= marks.cumsum(1)[:, :n] > 0
    return out


def _inside(edges: np.ndarray, x: np.ndarray, y: float) -> np.ndarray:
    """Whether the points (x, y) are inside a ring, by the even-odd rule."""
    ax, ay, bx, by = edges[(edges[:, 1] > y) != (edges[:, 3] > y)].T
    crossings = np.sort((bx - ax) * (y - ay) / (by - ay) + ax)
    return (len(crossings) - np.searchsorted(crossings, x, side="right")) % 2 == 1


def cells_of(rings: list[list[dict]], widest: float | None = None) -> Iterator[tuple[int, int, int, bool, list | None]]:
    """(level, x, y, interior, edges) of the cells that cover a polygon: its first ring without the others."""
    every = [_edges(r) for r in rings if r]
    if not rings or not rings[0]:
        return
    box = every[0]
    low, high = box[:, :2].min(0), box[:, :2].max(0)
    if not np.isfinite(box).all():
        return
    extent = max(*(high - low), 1e-9)
    level = math.floor(math.log2(360 * ACROSS / extent))
    if widest:
        level = max(level, math.ceil(math.log2(360 / widest)))
    level = min(max(level, 0), FINEST)
    size = 360 / 2**level
    x0, y0 = (int(v) for v in np.floor((low + 180) / size))
    n, m = (int(v) for v in np.floor((high + 180) / size) - (x0, y0) + 1)
    near = np.zeros((m, n), dtype=bool)
    for edges in every:
        # holes may lie outside of the outer ring's box
        held = edges[(edges[:, [1, 3]].max(1) >= low[1]) & (edges[:, [1, 3]].min(1) <= high[1])]
        held = held[(held[:, [0, 2]].max(1) >= low[0]) & (held[:, [0, 2]].min(1) <= high[0])]
        if len(held):
            near |= _touched(held, size, x0, y0, n, m)
    inside = np.zeros((m, n), dtype=bool)
    centre = (np.arange(n) + x0 + 0.5) * size - 180
    for j in range(m):
        y = (j + y0 + 0.5) * size - 180
        inside[j] = _inside(every[0], centre, y)
        for hole in every[1:]:
            inside[j] &= ~_inside(hole, centre, y)
    for j, i in zip(*np.nonzero(near)):
        left, bottom = (i + x0) * size - 180 - 1e-9, (j + y0) * size - 180
        kept = []
        for edges in every:
            y = edges[:, [1, 3]]
            some = (y.max(1) >= bottom - 1e-9) & (y.min(1) <= bottom + size + 1e-9) & (edges[:, [0, 2]].max(1) >= left - 1e-9 * abs(left))
            kept.append([dict(zip(("ax", "ay", "bx", "by"), e)) for e in edges[some].tolist()])
        yield level, int(i + x0), int(j + y0), False, kept
    whole = {(int(i + x0), int(j + y0)) for j, i in zip(*np.nonzero(inside & ~near))}
    while whole:
        wider = {(x // 2, y // 2) for x, y in whole}
        full = {
            (x, y) for x, y in wider if level > 0 and all((2 * x + a, 2 * y + b) in whole for a in (0, 1) for b in (0, 1))
        }
        for x, y in whole:
            if (x // 2, y // 2) not in full:
                yield level, x, y, True, None
        whole, level = full, level - 1


def cover(polygons: DataFrame, widest: float | None = None) -> DataFrame:
    """(polygon, level, x, y, interior, edges) of polygons (polygon: long, rings): cells that hold all of their points. A polygon
    is covered by one task; ``widest`` bounds the width of a boundary cell in degrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("polygon", pa.int64()), ("level", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("interior", pa.bool_()),
            ("edges", pa.list_(pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")]))))
        ])
        for batch in batches:
            for key, rings in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(key, *c) for c in cells_of(rings.as_py() or [], widest)]
                for first in range(0, len(rows), 512):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[first : first + 512]), schema.types)], schema=schema)

    return polygons.select("polygon", "rings").mapInArrow(run, COVER)


def crossed_oddly(edges: Column, lon: Column, lat: Column) -> Column:
    """Whether a ray to the east crosses an odd number of edges; half-open in latitude, as ``geo.ring_crossings``."""
    crossed = F.filter(
        edges,
        lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (
            lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.when(
                e["by"] == e["ay"], F.lit(1e-12)
            ).otherwise(e["by"] - e["ay"]) + e["ax"]
        )
    )
    return F.size(crossed) % 2 == 1


def covered(points: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """(key, polygon, interior) of the points (key, lon, lat) in the polygons of ``cells``; ``interior`` says that no edge was
    looked at. A point is looked up once for each level that there is, at most ``FINEST`` + 1."""
    levels = cells.agg(F.collect_set("level").alias("_levels"))  # one row
    q = points.select(key, "lon", "lat").dropna(subset=["lon", "lat"]).crossJoin(F.broadcast(levels)).withColumn(
        "level", F.explode("_levels")
    ).drop("_levels")
    size = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    at = lambda c: F.floor((F.col(c) + 180) / size).cast("int")
    q = q.withColumn("x", at("lon")).withColumn("y", at("lat"))
    hit = q.join(cells, ["level", "x", "y"])
    outer = crossed_oddly(F.col("edges")[0], F.col("lon"), F.col("lat"))
    holes = F.slice("edges", 2, F.greatest(F.size("edges") - 1, F.lit(0)))
    in_hole = F.exists(holes, lambda e: crossed_oddly(e, F.col("lon"), F.col("lat")))
    return hit.filter(F.when(F.col("interior"), True).otherwise(outer & ~in_hole)).select(key, "polygon", "interior")
