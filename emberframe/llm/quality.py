"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade > k) = logistic(w . x - t_k): one weight vector shared by all grades, thresholds t_0 < t_1 < ... The features are
the presence of hashed words, word beginnings (5 bytes) and word endings (2 bytes) in the whole text, the length's
magnitude and the share of words that repeat the word before. The weights are
found by accelerated proximal gradient with an L1 penalty, so most are exactly 0 and long clean texts gather no noise.
The fit sees at most ``SAMPLE`` labelled rows (those whose ids hash lowest); scoring reads every text once, without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.shared import materialize, small_batches
from emberframe.llm.words import slices, span_hashes, text_bytes, word_spans

#: Bound of the labelled rows that a fit may use.
SAMPLE = 6000
#: Bound of the features, over all rows, that a fit may use: 4 bytes each on the driver.
FEATURES = 1 << 25
#: Bits of a feature's number.
BITS = 20
#: Shares of words equal to the word before, each a feature.
REPEATED = (0.02, 0.05, 0.1, 0.2, 0.4)
SCORES = "doc_id long, score double, expected_grade double, tail_probability double"


def text_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, row) of every word's three features, of the row's length (log2 of its words) and, by steps, of
    the share of words that repeat the word before."""
    starts, ends, counts = word_spans(raw, offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    kinds = ((starts, ends), (starts, np.minimum(starts + 5, ends)), (np.maximum(ends - 2, starts), ends))
    salt = (0x0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    numbers = [
        ((span_hashes(raw, s, e) ^ np.uint64(x)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS) for (s, e),
        x in zip(kinds, salt)
    ]
    h = span_hashes(raw, starts, ends)
    again = np.bincount(
        row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(counts)
    ) / np.maximum(counts, 1)
    rows = [row] * 3 + [np.arange(len(counts))]
    numbers.append(np.log2(counts + 1).astype(np.int64))
    for k, share in enumerate(REPEATED):
        rows.append(np.flatnonzero(again >= share))
        numbers.append(np.full(len(rows[-1]), 64 + k))
    return np.concatenate([x.astype(np.int64) for x in numbers]), np.concatenate(rows)


def _distinct(number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort((row << BITS) | number)
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both & ((1 << BITS) - 1), both >> BITS


@dataclass
class OrdinalModel:
    """Weights by feature number and ordered thresholds; ``grades`` is one more than the thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and threshold k (columns)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -500, 500)))

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        number, row = text_features(raw, offsets)
        told = self.weights[number] != 0
        number, row = _distinct(number[told], row[told])
        return np.bincount(
            row, weights=self.weights[number], minlength=len(offsets) - 1
        ).astype(float)  # without features, int


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, l1: float = 1e-3, least_rows: int = 8, steps: int = 90
) -> OrdinalModel:
    """Fit on rows of feature numbers. With no row, or rows of one grade, the weights are 0 and the thresholds are the
    smoothed log-odds of the grades."""
    levels = int(grades.max()) if len(grades) else 1
    n = max(1, len(rows))
    tail = np.array(
        [(np.sum(grades > k) + 0.5) / (len(grades) + 1) for k in range(levels)]
    ) if len(grades) else np.array([0.5])
    thresholds = -np.log(tail / (1 - tail))
    model = OrdinalModel(np.zeros(1 << BITS), thresholds)
    if len(set(grades.tolist())) < 2:
        return model
    number = np.concatenate(rows)
    size = np.array([len(r) for r in rows])
    often = np.bincount(number, minlength=1 << BITS) >= least_rows
    keep = often[number]
    row = np.repeat(np.arange(len(rows)), size)[keep]
    columns = np.flatnonzero(np.bincount(number[keep], minlength=1 << BITS))
    if not len(columns):
        return model
    renumber = np.zeros(1 << BITS, dtype=np.int32)
    renumber[columns] = np.arange(len(columns))
    number = renumber[number[keep]]
    by_column = np.argsort(number, kind="stable")
    row_of = row[by_column].astype(np.int32)
    column_at = np.searchsorted(number[by_column], np.arange(len(columns)))
    filled = np.flatnonzero(np.bincount(row, minlength=len(rows)))
    row_at = np.searchsorted(row, filled)
    above = grades[:, None] > np.arange(levels)

    def value(w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray]:
        eta = np.zeros(len(rows))
        eta[filled] = np.add.reduceat(w[number], row_at)
        z = eta[:, None] - t
        return float(np.sum(np.logaddexp(0, z) - above * z)) / n, z

    # rows reach far from the origin (hundreds of features): the step is found by backtracking
    w, momentum, t, step = np.zeros(len(columns)), np.zeros(len(columns)), thresholds.copy(), 1.0
    t_momentum, k = t.copy(), 1.0
    for _ in range(steps):
        here, z = value(momentum, t_momentum)
        slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - above) / n
        g, g_t = np.add.reduceat(slope.sum(1)[row_of], column_at), -slope.sum(0)
        while True:
            new = momentum - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_t = np.sort(t_momentum - step * g_t)
            d, d_t = new - momentum, new_t - t_momentum
            if value(new, new_t)[0] <= here + g @ d + g_t @ d_t + (
                d @ d + d_t @ d_t
            ) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        k_new = (1 + np.sqrt(1 + 4 * k * k)) / 2
        momentum, t_momentum = new + (k - 1) / k_new * (new - w), np.sort(new_t + (k - 1) / k_new * (new_t - t))
        w, t, k = new, new_t, k_new
    model.weights[columns] = w
    model.thresholds = t
    return model


def train_quality(
    docs: DataFrame, labels: DataFrame, grade: Column, sample: int = SAMPLE, features: int = FEATURES,
    doc_id: str = "doc_id", text: str = "text", **options
) -> OrdinalModel:
    """Fit on the texts of at most ``sample`` rows of ``labels``, those whose ids hash lowest, and of these on the first
    that have ``features`` features together; ``grade`` (an expression over ``labels``) is an integer from 0. Rows with a
    null id or grade do not take part; of several rows with one id the lowest grade counts, and of several texts with one
    id one. The driver gets the feature numbers of the sample, never a text."""
    rated = labels.select(F.col(doc_id).cast("long").alias("doc_id"), grade.cast("int").alias("grade")).dropna()
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(
        F.xxhash64("doc_id"), "doc_id"
    ).limit(sample)
    texts = small_batches(docs).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).join(F.broadcast(rated), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                number, row = _distinct(*text_features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                ends = np.searchsorted(row, np.arange(1, j - i + 1))
                values = [p.astype(np.int32).tobytes() for p in np.split(number, ends[:-1])]
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(values, pa.binary())],
                    names=["doc_id", "grade", "features"]
                )

    told = texts.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, features binary")
    told = materialize(
        told.groupBy("doc_id").agg(F.min(F.struct("features", "grade")).alias("r")).select("doc_id", "r.*"), "sample"
    )
    upto = F.sum(F.length("features") / 4).over(
        Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    )  # at most ``sample`` rows
    few = told.select("doc_id", upto.alias("upto"), "features").filter(F.col("upto") <= features).select("doc_id")
    found = told.join(few, "doc_id").toPandas().sort_values("doc_id")
    return fit_ordinal(
        [np.frombuffer(b, dtype=np.int32) for b in found["features"]], found["grade"].to_numpy(dtype=np.int64),
        **options
    )


def score_quality(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the linear score, the expected grade and the probability of the best grade.

    A null or empty text has score 0, that is, the prior of a text without any telling feature. A null id is kept. Other
    columns are not returned. The weights (8 MB, a fixed size) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                score = m.scores(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                tails = m.tails(score)
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array(tails.sum(1)), pa.array(tails[:, -1])],
                    names=["doc_id", "score", "expected_grade", "tail_probability"]
                )

    return small_batches(docs).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, SCORES)


def select_quality(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, whose probability of the best grade is at least
    ``least_tail``. Rows are judged one by one in the scan's own task, so nothing is shuffled or joined, and null ids,
    repeated rows and any other columns are carried through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(at))
            for i, j in slices(offsets, 1 << 20):
                good = m.tails(
                    m.scores(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                )[:, -1] >= least_tail
                yield batch.slice(i, j - i).filter(pa.array(good))

    return small_batches(docs).mapInArrow(run, docs.schema)
