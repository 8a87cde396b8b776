"""Centroid clustering (Lloyd's rounds) by ball-tree filtering, in exact integers.

Every task grows metric trees over the vectors of its partition, once; they are written to the shared folder. A node of a
tree is a ball: radius, count and the integer sum of its vectors. In a round a ball at distance d of its centre from a
centroid holds vectors at distances from d - r to d + r, by the triangle inequality: centroids beyond the reach of the nearest
one are left out for all of the ball, and where one is left, the ball's count and sum go to it without a look at its
vectors. Otherwise the search descends, down to leaves, where distances to what is left are exact. A task gives one sum per
centroid and dimension, so a round shuffles and collects what centroids times dimensions bound, whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.shared import discard, materialize
from emberframe.llm.vectors import finite_rows, scaled

#: Vectors of a tree, and of a leaf whose vectors differ.
TREE, LEAF = 4096, 32
#: Largest integer component: squared distances of 64 components fit in a long.
MOST = 2.0**27

_TREE = (
    "ids array<bigint>, points binary, first array<int>, last array<int>, left array<int>, radius array<double>, "
    "sums binary"
)


class Tree:
    """A ball tree: ``points`` in the order of the leaves; node k has the points first[k] to last[k], their integer sum, and a
    radius around sum / count; its children are left[k] and left[k] + 1, or left[k] is -1."""

    def __init__(self, points, first, last, left, radius, sums):
        self.points, self.first, self.last, self.left, self.radius, self.sums = points, first, last, left, radius, sums

    @property
    def centres(self) -> np.ndarray:
        return self.sums / (self.last - self.first)[:, None]


def grow_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """(tree, order of the rows in it). Balls are halved along the line between two of their farthest vectors; a ball of
    equal vectors is a leaf of any size."""
    order = np.arange(len(x))
    first, last, left, radius, sums = [0], [len(x)], [], [], []
    k = 0
    while k < len(first):
        low, high = first[k], last[k]
        part = x[order[low:high]]
        total = part.sum(0)
        away = part - total / (high - low)
        square = (away * away).sum(1)
        radius.append(float(np.sqrt(square.max())) * (1 + 1e-12))
        sums.append(total)
        if high - low <= leaf or square.max() <= 1e-6 or (part == part[0]).all():
            left.append(-1)
        else:
            end = away[square.argmax()]
            other = away[((away - end) ** 2).sum(1).argmax()]
            middle = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(away @ (other - end), middle)]
            left.append(len(first))
            first += [low, low + middle]
            last += [low + middle, high]
        k += 1
    whole = [np.array(v) for v in (first, last, left, radius)]
    return Tree(x[order], *whole, np.array(sums)), order


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors from integer centres."""
    size = max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0))
    if 4.0 * x.shape[1] * float(size) ** 2 < 2.0**53:  # every product and sum is an integer that a double holds
        a, b = x.astype(float), centres.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def assigned(tree: Tree, centres: np.ndarray) -> Iterator[tuple[int, int, int, int | np.ndarray]]:
    """(node, first, last, centroid) for balls that go to one centroid whole, and with an array of centroids for the vectors of
    a leaf. Ties go to the smaller number."""
    unlike = np.sort(np.unique(centres, axis=0, return_index=True)[1])  # of equal centroids the first takes all
    middle, some = tree.centres, centres[unlike].astype(float)
    away = middle[:, None, :] - some if middle.size * len(some) < 1 << 22 else None
    apart = np.sqrt((away * away).sum(2)) if away is not None else np.stack(
        [np.sqrt(((middle - c) ** 2).sum(1)) for c in some], axis=1
    )
    todo = [(0, np.arange(len(unlike)))]
    while todo:
        k, left = todo.pop()
        d = apart[k, left]
        near = d.min()
        left = left[d - tree.radius[k] <= near + tree.radius[k] + 1e-9 * (1 + near)]
        low, high = int(tree.first[k]), int(tree.last[k])
        if len(left) == 1:
            yield k, low, high, int(unlike[left[0]])
        elif tree.left[k] < 0:
            number = unlike[left]
            yield k, low, high, number[squared(tree.points[low:high], centres[number]).argmin(1)]
        else:
            todo += [(int(tree.left[k]), left), (int(tree.left[k]) + 1, left)]


def _trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, Tree]]:
    for batch in batches:
        for r in range(len(batch)):
            row = {n: batch.column(n)[r] for n in batch.schema.names}
            read = lambda n, kind: np.frombuffer(row[n].as_buffer(), dtype=kind).reshape(-1, width)  # noqa: B023,E731
            lists = [np.asarray(row[n].values) for n in ("first", "last", "left", "radius")]
            yield row["ids"].values, Tree(read("points", np.int32).astype(np.int64), *lists, read("sums", np.int64))


def _grown(width: int, scale: int, tree: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []

        def row(n: int) -> pa.RecordBatch:
            nonlocal ids, parts
            x = np.concatenate(parts)
            made, order = grow_tree(x[:n], leaf)
            own, ids, parts = [ids[k] for k in order], ids[n:], [x[n:]]
            columns = [
                [own], [made.points.astype(np.int32).tobytes()], [made.first], [made.last], [made.left],
                [made.radius], [made.sums.astype(np.int64).tobytes()]
            ]
            kinds = [
                pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64()), pa.binary()
            ]
            names = [c.split()[0] for c in _TREE.split(", ")]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for rows, x in finite_rows(batch.column(1)):
                if x.shape[1] == width and len(rows):
                    ids += batch.column(0).take(pa.array(rows)).to_pylist()
                    parts.append(scaled(x, scale, MOST))
            while len(ids) >= tree:
                yield row(tree)
        if ids:
            yield row(len(ids))

    return run


def _heads(width: int, k: int, salt: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, width):
            name = [hashlib.sha256(f"{salt}:{'' if v is None else v}".encode()).hexdigest() for v in ids.to_pylist()]
            # ties of a hash are decided by the vectors, so all of the last hash's rows are sent, each vector once
            last = sorted(name)[:k][-1]
            seen = {(n, tuple(tree.points[j].tolist())): 0 for j, n in enumerate(name) if n <= last}
            for j, n in enumerate(name):
                if n <= last:
                    seen[n, tuple(tree.points[j].tolist())] += 1
            rows = [(n, list(x)) for (n, x), times in seen.items() for _ in range(min(times, k))]
            yield pa.record_batch(
                [pa.array([n for n, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.list_(pa.int64()))],
                names=["name", "x"]
            )

    return run


def _sums(width: int, centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), width + 1), dtype=np.int64)  # the last column counts
        for _, tree in _trees(batches, width):
            for node, low, high, to in assigned(tree, centres):
                if isinstance(to, int):
                    total[to, :width] += tree.sums[node]
                    total[to, width] += high - low
                else:
                    np.add.at(total[:, :width], to, tree.points[low:high])
                    total[:, width] += np.bincount(to, minlength=len(centres))
        cluster, place = np.nonzero(total)
        yield pa.record_batch(
            [pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(total[cluster, place], pa.int64())],
            names=["cluster", "place", "value"]
        )

    return run


def _members(width: int, centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, width):
            cluster = np.empty(len(tree.points), dtype=np.int32)
            for _, low, high, to in assigned(tree, centres):
                cluster[low:high] = to
            distance = ((tree.points - centres[cluster]) ** 2).sum(1)
            yield pa.record_batch([ids, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2",
    tree: int = TREE, leaf: int = LEAF, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared, from the final centroid), cluster_inertia, inertia and
    centroid_sha256, of the final centroid's components joined by commas.

    Kept are vectors of exactly ``width`` components, none null or non-finite; each component x becomes floor(scale * x).
    Centroids start as the ``k`` vectors with the smallest sha256 of ``salt``:id; rows with a null id have an empty id there,
    and equal hashes (repeated ids) are ordered by their vectors. With fewer than ``k`` vectors, as many centroids. Each
    round moves every centroid with vectors to floor(sum / count). Repeated rows are vectors of their own; without kept
    vectors the result is empty. Other columns are not returned. A component beyond 2**27 after scaling is an error. The
    driver holds the centroids and one sum per centroid and dimension.
    """
    rows = vectors.select(
        vectors[vec_id].cast("long").alias("id"), vectors[embedding].cast("array<double>").alias("e")
    )
    trees = materialize(rows.mapInArrow(_grown(width, scale, tree, leaf), _TREE), "trees")
    first = trees.select("ids", "points", "first", "last", "left", "radius", "sums").mapInArrow(
        _heads(width, k, salt), "name string, x array<bigint>"
    ).orderBy("name", "x").limit(k).collect()
    centres = np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, width)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], result)
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(width, centres), "cluster int, place int, value long")
        found = np.zeros((len(centres), width + 1), dtype=object)
        for r in sums.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():
            found[r["cluster"], r["place"]] = r["value"]
        centres = np.array(
            [[s // q[-1] for s in q[:-1]] if q[-1] else c.tolist() for q, c in zip(found, centres)], dtype=np.int64
        )
    members = materialize(
        trees.mapInArrow(_members(width, centres), "id long, cluster int, distance long"), "members"
    )
    discard(trees)
    inertia = {
        r["cluster"]: r["inertia"]
        for r in members.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    }
    facts = [
        (c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for c in sorted(inertia)
    ]
    # one row per centroid
    facts_ = vectors.sparkSession.createDataFrame(
        facts, "of int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return members.join(F.broadcast(facts_), F.col("cluster") == F.col("of")).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
