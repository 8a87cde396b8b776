"""Exact metric range join of embeddings: which vectors have a cosine of at least a threshold.

On unit vectors, cosine >= c is a distance of at most e = sqrt(2 - 2 c). Pivots partition the vectors: each belongs to
the cell of its nearest pivot. By the triangle inequality, a vector within e of a vector of cell j lies within e of the
side of j's pivot: (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)) <= e, where i is its own cell. So it is copied to the
cells j that satisfy this, and cells join independently. A pair of two cells is looked for in the lower one only.

A cell is cut into blocks of its own vectors and chunks of all its vectors; a task compares one block with one chunk by a
matrix product in single precision, and pairs near the threshold are decided in double precision. Tasks give the number
of links of each vector and a spanning forest of the links they saw, never the pairs; equal vectors are one from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.components import components
from emberframe.llm.shared import materialize
from emberframe.llm.vectors import finite_rows, packed

#: Vectors of a cell's own in a task, and vectors that they are compared with.
BLOCK, CHUNK = 2048, 16384


def unit(column: pa.Array) -> list[bytes | None]:
    """The vectors brought to length 1, as bytes in double precision; None for those that are null, empty or zero, or hold null
    or non-finite components."""
    out: list[bytes | None] = [None] * len(column)
    for rows, x in finite_rows(column):
        top = np.abs(x).max(1, initial=0)
        rows, x = rows[top > 0], x[top > 0] / top[top > 0, None]  # else squares may overflow or vanish
        x /= np.sqrt((x * x).sum(1))[:, None]
        for r, b in zip(rows.tolist(), packed(x)):
            out[r] = b
    return out


def _stack(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, their widths); shorter ones are filled up with zeros, which changes no distance between equal widths."""
    rows = [np.frombuffer(b.as_buffer(), dtype=float) for b in column]
    width = np.array([len(r) for r in rows], dtype=np.int64)
    if len(rows) and (width == width[0]).all():
        return np.array(rows), width
    x = np.zeros((len(rows), width.max(initial=0)))
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    return x, width


def _to(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` with zeros up to ``width`` components."""
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors whose hashes are lowest. There are at most twice the square root of all vectors, so the driver and every
    task hold 16 * dimension * sqrt(vectors) bytes: 8 MB for 60 million vectors of 64 components."""
    rows = vectors.orderBy(F.xxhash64("vector"), "id").limit(n).select("vector").collect()
    return _stack(pa.array([r["vector"] for r in rows], pa.binary()))[0]


def copies(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each vector, rows, cells): the lower cells to which the rows are copied."""
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = _to(x, width), _to(pivots, width)
    square = np.maximum(0, 2 - 2 * (x @ pivots.T))
    home = square.argmin(1)
    between = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[home]
    # equal pivots bound nothing: the vector is copied
    near = square - square[np.arange(len(x)), home][:, None] <= 2 * between * reach + 1e-9
    near &= np.arange(len(pivots)) < home[:, None]
    rows, cells = np.nonzero(near)
    return home, rows, cells


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        p, q = top(u), top(v)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def compare(
    own: np.ndarray, own_ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, own_home: np.ndarray,
    threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (own, other) of links; among a cell's own vectors, only those with own id < other id."""
    single, found = own.astype(np.float32), []
    for first in range(0, len(other), 4096):
        part = other[first : first + 4096]
        i, j = np.nonzero(single @ part.astype(np.float32).T >= threshold - 1e-4)
        j = j + first
        keep = ~own_home[j] | (own_ids[i] < other_ids[j])
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            linked = (own[a] * other[b]).sum(1) >= threshold
            found.append((a[linked], b[linked]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK, chunk: int = CHUNK, pivots: int | None = None,
    vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id (the least id reachable by links) and kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. So do rows with a null id:
    their component_id is null and they are kept. Rows that repeat an id are one vector, that of the least bytes if they
    differ. Vectors of different widths have no cosine and are not linked; each width links within itself. Other columns are
    not returned.
    """
    reach = float(np.sqrt(2 - 2 * threshold))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(
                [batch.column(0), pa.array(unit(batch.column(1)), pa.binary())], names=["id", "vector"]
            )

    rows = vectors.select(
        vectors[vec_id].cast("long").alias("id"), vectors[embedding].cast("array<double>").alias("e")
    ).mapInArrow(prepare, "id long, vector binary")
    rows = materialize(rows, "vectors")
    single = rows.filter("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    classes = single.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.col("rep").alias("id"), "n", "vector"), "classes")
    total = classes.count()
    if total == 0:
        return rows.select(
            F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
            F.lit(True).alias("kept")
        )
    # a vector meets every pivot, then its cell: with more pivots than the square root, meeting them costs more than it saves
    centres = choose_pivots(classes, pivots or max(1, min(-(-total // block), 2 * math.isqrt(total))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.slice(first, 2048)
                home, r, cells = copies(_stack(part.column(2))[0], centres, reach)
                every = np.concatenate([np.arange(len(part)), r])
                cell = np.concatenate([home, cells]).astype(np.int32)
                at_home = np.arange(len(every)) < len(part)
                yield pa.record_batch(
                    [pa.array(cell), pa.array(at_home), *(c.take(pa.array(every)) for c in part.columns)],
                    names=["cell", "home", "id", "n", "vector"]
                )

    placed = materialize(classes.mapInArrow(place, "cell int, home boolean, id long, n long, vector binary"), "cells")
    # blocks of a cell's own vectors, chunks of all its vectors: a row per cell
    sizes = placed.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("own"), F.count("*").alias("all"))
    sizes = sizes.select(
        "cell", F.ceil(F.col("own") / block).cast("int").alias("blocks"),
        F.ceil(F.col("all") / chunk).cast("int").alias("chunks")
    ).filter("blocks > 0")
    spread = placed.join(sizes, "cell")
    block_of = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    chunk_of = F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")).cast("int")
    as_own = spread.filter("home").select(
        "cell", block_of.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(True).alias("own"), "home", "id", "n", "vector"
    )
    as_other = spread.select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk_of.alias("chunk"),
        F.lit(False).alias("own"), "home", "id", "n", "vector"
    )

    def join(table: pa.Table) -> pa.Table:
        mine = np.asarray(table["own"])
        ids, n, home = np.asarray(table["id"]), np.asarray(table["n"]), np.asarray(table["home"])
        x, width = _stack(table["vector"].combine_chunks())
        own, other = np.flatnonzero(mine), np.flatnonzero(~mine)
        a = b = np.empty(0, dtype=np.int64)
        if len(own) and len(other):
            a, b = compare(x[own], ids[own], x[other], ids[other], home[other], threshold)
            alike = width[own[a]] == width[other[b]]
            a, b = a[alike], b[alike]
        counts = np.bincount(
            own[a], weights=n[other[b]], minlength=len(ids)
        ) + np.bincount(other[b], weights=n[own[a]], minlength=len(ids))
        at = np.flatnonzero(counts)
        forest = np.array(_forest(ids[own[a]], ids[other[b]]), dtype=np.int64).reshape(-1, 2)
        return pa.table([
            pa.array(np.concatenate([ids[at], forest[:, 0]])),
            pa.array([None] * len(at) + forest[:, 1].tolist(), pa.int64()),
            pa.array(np.concatenate([counts[at].astype(np.int64), np.zeros(len(forest), dtype=np.int64)])),
        ], names=["a", "b", "links"])

    found = as_own.unionByName(as_other).groupBy("cell", "block", "chunk").applyInArrow(
        join, "a long, b long, links long"
    )
    found = materialize(found, "links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    edges = found.filter("b is not null").select("a", "b")
    # a class of equal vectors: all of them, or as far as the threshold lets a vector meet itself
    named = single.join(classes.select("vector", F.col("id").alias("rep"), "n"), "vector").select("id", "rep", "n")
    named = named.join(links, named["rep"] == links["a"], "left").drop("a")
    found_top = components(edges)
    named = named.join(found_top, named["rep"] == found_top["node"], "left")
    named = named.select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("top")
    )
    out = rows.select("id").join(named.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    top = F.coalesce("top", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        top.alias("component_id"), F.coalesce(top == F.col("id"), F.lit(True)).alias("kept")
    )
