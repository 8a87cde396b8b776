"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

A document's set is that of its distinct word shingles. Each random permutation (multiplication by an odd number modulo
2**64) gives two signature values, the least and the greatest image, so a signature of 2 K values takes K hash
evaluations a shingle; either value agrees for two sets with probability equal to their similarity. Values are banded:
documents that agree in a whole band share a bucket. With 32 bands of 5 values, a pair of similarity 0.8 shares no
bucket with probability 3e-6.

Equal sets are one class from the start, so copies never meet in pairs. Buckets with the same members count once. Sets that
buckets join are compared in blocks by matrix products, which gives a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.linking import link_groups, spanning_edges
from emberframe.llm.shared import materialize, small_batches
from emberframe.llm.words import mix, shingle_sets, slices, text_bytes, word_hashes

SIGNATURES = "doc_id long, text_hash long, n_shingles long, print_a long, print_b long, bands array<long>"


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(0xB1A5).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minmax_signatures(values: np.ndarray, counts: np.ndarray, permutations: int, tile: int = 1 << 15) -> np.ndarray:
    """Rows of 2 * ``permutations`` values, minima before maxima, for the sets of ``values`` (all counts above 0)."""
    factor = multipliers(permutations)
    ends = np.cumsum(counts)
    out = np.empty((len(counts), 2 * permutations), dtype=np.uint64)
    x = mix(values)
    first = 0
    while first < len(counts):
        low = ends[first] - counts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + tile, side="right")))
        part, at = x[low : ends[last - 1]], ends[first:last] - counts[first:last] - low
        for k in range(permutations):
            image = part * factor[k]
            out[first:last, k] = np.minimum.reduceat(image, at)
            out[first:last, permutations + k] = np.maximum.reduceat(image, at)
        first = last
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; a band holds minima or maxima, never both of one permutation."""
    n, width = signatures.shape
    salt = multipliers(width + 1)[-rows:]
    grouped = signatures.reshape(n, width // rows, rows)
    total = (grouped * salt).sum(2, dtype=np.uint64) + np.arange(
        width // rows, dtype=np.uint64
    ) * np.uint64(0x9E3779B97F4A7C15)
    return mix(total)


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                values, n = shingle_sets(
                    *word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), size
                )
                a, b = _prints(values, n)
                keys = band_keys(
                    minmax_signatures(values, n[n > 0], bands * rows // 2), rows
                ) if n.any() else np.empty((0, bands), dtype=np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                yield pa.record_batch([
                    batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n.astype(np.int64)),
                    pa.array(a), pa.array(b),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                ], names=["doc_id", "text_hash", "n_shingles", "print_a", "print_b", "bands"])

    return materialize(docs.mapInArrow(run, SIGNATURES), "signatures")


def _prints(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set: equal sets have equal ones."""
    a, b = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = np.cumsum(n)[full] - n[full]
        a[full] = np.add.reduceat(mix(values ^ np.uint64(0x1234567)), at)
        b[full] = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0x7654321)), at)
    return a.view(np.int64), b.view(np.int64)


def _with_sets(docs: DataFrame, classes: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (rep, and keys of type long) with ``shingles``, the set of the class: its ordered hashes in 8
    bytes each, from the text of the class's document. Texts are shuffled once, at every size, and a set is made when it is
    sent. Rows of ``docs`` that repeat id and text send it once, unless Spark has split them to several tasks."""
    keys = [c for c in wanted.columns if c != "rep"]
    to = wanted.join(classes.select("rep", "doc", F.col("text_hash").alias("hash")), "rep")
    on = (F.col("doc_id") == F.col("doc")) & (F.col("text_hash") == F.col("hash"))
    sent = docs.filter(
        "doc_id is not null"
    ).join(to.hint("merge"), on).select("rep", *keys, "text")  # rows of one text are neighbours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, set()
        for batch in batches:
            keep = []
            for k, told in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]))):
                if told[0] != now:
                    now, seen = told[0], set()
                if told not in seen:
                    seen.add(told)
                    keep.append(k)
            if not keep:
                continue
            batch = batch.take(pa.array(keep))
            rep = np.asarray(batch.column(0))
            first = np.flatnonzero(np.append(True, rep[1:] != rep[:-1]))
            raw, offsets = text_bytes(batch.column(len(keys) + 1).take(pa.array(first)))
            for i, j in slices(offsets, 1 << 20):
                values, n = shingle_sets(
                    *word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), size
                )
                data, ends = values.tobytes(), 8 * np.cumsum(n)
                low, high = first[i], first[j] if j < len(first) else len(rep)
                of = np.repeat(np.arange(j - i), np.diff(np.append(first[i:j], high)))
                sets = pa.array(
                    [data[ends[k] - 8 * n[k] : ends[k]] for k in range(j - i)], pa.binary()
                ).take(pa.array(of))
                yield pa.record_batch(
                    [*(c.slice(low, high - low) for c in batch.columns[:-1]), sets], names=["rep", *keys, "shingles"]
                )

    return sent.mapInArrow(run, ", ".join(f"{c} long" for c in ("rep", *keys)) + ", shingles binary")


def linked_sets(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets (rep, shingles) of a table. Intersections of all pairs come from
    products of incidence matrices, some thousand shingles at a time; shingles of one set alone are left out."""
    ids = np.asarray(table["rep"])
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["shingles"].combine_chunks()]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    column = (np.cumsum(new & several) - 1)[several]
    row = row[several]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 if len(column) else 0, 4096))
    for low, high in zip(edges, [*edges[1:], len(column)]):
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[row[low:high], column[low:high] % 4096] = 1
        shared += part @ part.T
    union = size[:, None] + size - shared
    return spanning_edges((shared > 0) & (100 * shared >= percent * union), ids)


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, doc_id: str = "doc_id",
    text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least id reachable by links) and kept.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets of ``size`` words
    (fewer words: the whole sequence is one shingle). A null, empty or blank text has no shingle and no link. Rows that
    repeat an id are judged by their own texts each, and the id stands for any of them. A row with a null id is linked
    with nothing: its component_id is null and it is kept. An empty table gives an empty result. Other columns are not
    returned. ``rows`` must divide ``bands * rows / 2``.
    """
    text_ = docs[text].cast("string")
    docs = small_batches(docs).select(
        docs[doc_id].cast("long").alias("doc_id"), text_.alias("text"), F.xxhash64(text_).alias("text_hash")
    )
    signed = _signatures(docs, size, bands, rows)
    named = signed.filter("doc_id is not null and n_shingles > 0")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    classes = named.groupBy(
        "print_a", "print_b", F.col("n_shingles").alias("n")
    ).agg(one, F.first("bands").alias("bands"))
    classes = classes.select(
        "print_a", "print_b", "n", F.col("one.doc_id").alias("doc"), "one.text_hash", "bands",
        F.monotonically_increasing_id().alias("rep")
    )
    classes = materialize(classes, "classes")  # numbered once, in files

    placed = classes.select("rep", F.explode("bands").alias("key"))
    buckets = placed.groupBy("key").agg(
        F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.sum(F.xxhash64("rep", F.lit(1)) % 1_000_000_007).alias("s")
    )
    buckets = buckets.filter("k > 1").groupBy("k", "x", "s").agg(F.min("key").alias("key"))
    members = materialize(placed.join(buckets.select("key"), "key").select("key", "rep").distinct(), "members")
    found = link_groups(
        members, lambda wanted: _with_sets(docs, classes, size, wanted), lambda table: linked_sets(table, percent)
    )

    rep = classes.select(
        "print_a", "print_b", F.col("n").alias("n_shingles"), "rep", "doc"
    ).join(found, F.col("rep") == F.col("node"), "left")
    rep = rep.withColumn("group", F.coalesce("component", "rep")).select(
        "print_a", "print_b", "n_shingles", "group", "doc"
    )
    least = rep.groupBy("group").agg(F.min("doc").alias("least"))
    rep = rep.join(least, "group").drop("group", "doc")
    out = signed.select("doc_id", "n_shingles", "print_a", "print_b").join(
        rep, ["print_a", "print_b", "n_shingles"], "left"
    )
    top = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", top.alias("component_id"), F.coalesce(F.col("doc_id") == top, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that a document with a lesser id stands for. Of rows
    that repeat an id, all go where one of their texts has such a document."""
    marked = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("doc_id")
    kept = docs.toDF(*names).join(
        materialize(marked, "dropped"), F.col(names[at]).cast("long") == F.col("_gone"), "left_anti"
    )
    return kept.toDF(*docs.columns)
