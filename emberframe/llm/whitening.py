"""Whitening of embeddings: principal components of all distinct vectors, by a randomised range finder.

A basis of a few more random directions than components is multiplied by the covariance in passes over all centred rows
(subspace iteration); in it, the covariance is a small matrix, whose eigenvectors are the best the basis holds
(Rayleigh-Ritz). Where their residuals stay above the tolerance after some passes, the basis is doubled, up to full dimension,
where the result is that of the whole covariance. Components are integers, so centring is exact: the integer part of the mean is
taken off in 64 bits and only its fraction in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.shared import materialize
from emberframe.llm.vectors import finite_rows, packed, scaled

#: Rows of a matrix product.
ROWS = 8192
#: Largest scaled component.
MOST = 2.0**40


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` distinct vectors of ``width`` integers with the sums ``sums``; ``vectors`` has the components as columns,
    ``values`` their eigenvalues, ``trace`` the total variance, ``error`` the largest entry of the whitened covariance minus
    the identity."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n."""
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - sums)**2, exact; None where that does not fit in a long."""
        y, rest = x - self.whole, self.rest
        most = float(np.abs(y).max(initial=0)) * x.shape[1] * max(self.n, float(np.abs(y).max(initial=0)))
        if most >= 2.0**62:
            y, rest = y.astype(object), rest.astype(object)
        square, cross = (y * y).sum(1).tolist(), (y * rest).sum(1).tolist()
        last = sum(int(r) ** 2 for r in rest)
        exact = [self.n * self.n * a - 2 * self.n * b + last for a, b in zip(square, cross)]
        return [v if v < 2**63 else None for v in exact]


def _integers(column: pa.Array, width: int, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows, x in finite_rows(column):
        if len(rows) and width in (0, x.shape[1]):
            yield rows, scaled(x, scale, MOST) + shift


def _distinct(scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _integers(batch.column(0), 0, scale, shift):
                # four bytes where the vector allows it
                low = x - shift
                short = np.abs(low).max(1) < 2**31 if x.shape[1] else np.zeros(0, dtype=bool)
                for part in (low[short].astype(np.int32), low[~short]):
                    yield pa.record_batch(
                        [pa.array([x.shape[1]] * len(part), pa.int32()), pa.array(packed(part), pa.binary())],
                        names=["width", "x"]
                    )

    return run


def _matrices(batches: Iterator[pa.RecordBatch], width: int, shift: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for first in range(0, len(batch), ROWS):
            raw = batch.column(0)[first : first + ROWS].to_pylist()
            for kind in (np.int32, np.int64):
                size = width * np.dtype(kind).itemsize
                joined = b"".join(r for r in raw if len(r) == size)
                if joined:
                    yield np.frombuffer(joined, dtype=kind).reshape(-1, width).astype(np.int64) + shift


def _summed(
    fit: DataFrame, width: int, shift: int, size: int, kind: str, add: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum over all rows of the ``size`` values that ``add`` gives for a matrix of rows: one list a task, added up by
    place, ``size`` values to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64 if kind == "long" else float)
        for x in _matrices(batches, width, shift):
            total += add(x)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["place", "value"])

    out = np.zeros(size, dtype=object if kind == "long" else float)
    sums = fit.select("x").mapInArrow(run, f"place int, value {kind}").groupBy("place")
    for r in sums.agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def fit_whitening(
    vectors: DataFrame, components: int = 16, oversample: int = 16, passes: int = 3, tolerance: float = 1e-13,
    scale: int = 64, shift: int = 1_000_000, seed: int = 13, embedding: str = "embedding"
) -> Whitening | None:
    """The first principal components of the distinct vectors of integers floor(scale * c) + shift.

    Rows whose vector is null, empty or holds null or non-finite components are left out. Where vectors have several
    widths, the width that most distinct vectors have counts (of equals the smaller), and the others are left out. None
    without a vector. There are fewer components where the vectors span fewer dimensions, none where all are equal. The
    driver and every task hold a few matrices of width times basis, at most width squared.
    """
    rows = vectors.select(vectors[embedding].cast("array<double>").alias("e"))
    # a vector that many rows have is one row of a task before it is shuffled
    fit = materialize(
        rows.mapInArrow(_distinct(scale, shift), "width int, x binary").groupBy("width", "x").agg(F.lit(1).alias("one")),
        "fit"
    )
    common = fit.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not common:
        return None
    width, n = common[0]["width"], common[0]["n"]
    fit = fit.filter(F.col("width") == width)
    sums = _summed(fit, width, shift, width, "long", lambda x: x.sum(0))
    model = Whitening(n, tuple(int(s) for s in sums), np.zeros((width, 0)), np.zeros(0), 0.0)

    def multiplied(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """(covariance times basis, trace of the covariance)."""

        def add(x: np.ndarray) -> np.ndarray:
            y = model.centred(x)
            return np.concatenate([(y.T @ (y @ basis)).ravel(), [(y * y).sum()]])

        total = _summed(fit, width, shift, basis.size + 1, "double", add) / n
        return total[:-1].reshape(basis.shape), float(total[-1])

    draw = np.random.default_rng(seed)
    size = min(width, components + oversample)
    basis = np.linalg.qr(draw.normal(size=(width, size)))[0]
    k, done = 0, False
    while not done:
        image, trace = multiplied(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found = basis @ turn
        wanted = min(components, size)
        residual = np.sqrt(((image @ turn - found * values)[:, :wanted] ** 2).sum(0))
        k += 1
        done = size == width or bool((residual <= tolerance * max(values[0], 0)).all())
        if not done:
            if k % passes == 0:
                size = min(width, 2 * size)
            more = draw.normal(size=(width, size - image.shape[1]))
            basis = np.linalg.qr(np.concatenate([image, more], axis=1))[0]
    rank = int((values[:wanted] > 64 * width * np.finfo(float).eps * max(values[0], 0)).sum())
    found, values = found[:, :rank], values[:rank].copy()
    top = np.abs(found).argmax(0)
    found = found * np.sign(found[top, np.arange(rank)])
    model = Whitening(n, model.sums, found, values, trace)
    if not rank:
        return model

    def spread(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return (w.T @ w).ravel()

    covariance = _summed(fit, width, shift, rank * rank, "double", spread).reshape(rank, rank) / n
    return Whitening(n, model.sums, found, values, trace, float(np.abs(covariance - np.eye(rank)).max()))


def whiten_vectors(
    vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, vec_id: str = "vec_id",
    embedding: str = "embedding", **options
) -> DataFrame:
    """One row per kept row and component: vec_id, component (from 1), n, deviation, whitened, explained and identity_error.

    Rows are kept, and the model is fitted, as in ``fit_whitening``; repeated rows are kept each, but count once in the fit. A
    null id stays null. ``deviation`` is null where it does not fit in a long. An empty table, or one whose vectors are all
    equal, gives an empty result. Other columns are not returned.
    """
    result = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    model = fit_whitening(vectors, components, scale=scale, shift=shift, embedding=embedding, **options)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], result)
    width, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _integers(batch.column(1), width, scale, shift):
                for first in range(0, len(rows), ROWS):
                    at, part = rows[first : first + ROWS], x[first : first + ROWS]
                    every = pa.array(np.repeat(np.arange(len(at)), k))
                    whitened = model.whitened(part).ravel()
                    yield pa.record_batch(
                        [
                            batch.column(0).take(pa.array(at)).take(every),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                            pa.array(np.full(len(at) * k, model.n)),
                            pa.array(model.deviations(part), pa.int64()).take(every), pa.array(whitened),
                            pa.array(np.tile(model.values / model.trace, len(at))),
                            pa.array(np.full(len(at) * k, model.error))
                        ],
                        names=[c.split()[0] for c in result.split(", ")]
                    )

    return vectors.select(
        vectors[vec_id].cast("long").alias("id"), vectors[embedding].cast("array<double>").alias("e")
    ).mapInArrow(run, result)
