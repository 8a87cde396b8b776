"""Packing documents into windows of a fixed number of tokens by non-negative least squares.

A document's tokens are its ids and one end id. It is cut into whole windows, a middle whose length is a multiple of
``grain``, and a tail shorter than that. The middles' lengths form a small histogram (window / grain numbers, whatever
the number of documents). Shallow combinations of lengths that fill a window exactly are enumerated; repeat counts that
best explain the histogram come from non-negative least squares, are rounded down, and a greedy pass repeats what still
fits. Residual middles and all tails form one stream that is cut at window ends, so every sequence but the stream's rest
is full; the rest is cut into lengths that are powers of two, which need no padding.

Which middle takes which place follows from its rank among the middles of its length. Ranks are counted within buckets
of rows and shifted by the sums of the buckets before, so a frequent length is never sorted in one task.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.shared import materialize, small_batches
from emberframe.llm.words import slices, text_bytes

WINDOW, GRAIN, DEPTH, END = 2048, 32, 4, 1
#: Words kept with their ids by a worker.
KEPT_WORDS = 300_000
_tokenizers: dict[str, tuple] = {}
CUT = "row long, doc_id long, doc_tokens long, middle_start long, middle long, blocks array<long>, middle_crc long, middle_ids binary, tail_ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(parts: int, depth: int) -> np.ndarray:
    """All multisets of up to ``depth`` numbers from 1 to ``parts`` with sum ``parts``: a row per number (from 1), a
    column per multiset."""
    found = [
        c for k in range(1, depth + 1) for c in itertools.combinations_with_replacement(
            range(1, parts + 1), k - 1
        ) if (rest := parts - sum(c)) >= (c[-1] if c else 1) for c in [(*c, rest)]
    ]
    table = np.zeros((parts, len(found)))
    for j, c in enumerate(found):
        for x in c:
            table[x - 1, j] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b| (active sets: the most promising column joins, columns driven to 0 leave)."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if gain.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[gain.argmax()] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            falling = z <= 0
            ratio = x[at][falling] / np.maximum(x[at][falling] - z[falling], 1e-300)
            x[at] += ratio.min() * (z - x[at])
            gone = at[(x[at] <= 1e-12)]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def repeat_counts(histogram: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeats of each): whole numbers, never using more of a length than ``histogram`` holds."""
    table = combinations(len(histogram), depth)
    left = histogram.astype(np.int64).copy()
    uses = [np.flatnonzero(table[:, j]) for j in range(table.shape[1])]
    times = [table[u, j].astype(np.int64) for j, u in enumerate(uses)]
    repeats = np.zeros(table.shape[1], dtype=np.int64)
    solved = np.floor(nnls(table, histogram.astype(float)) + 1e-6).astype(np.int64)
    for most in (solved, np.full(len(repeats), np.iinfo(np.int64).max)):  # as solved, then greedily
        for j in np.argsort(-solved, kind="stable"):
            n = min(int(most[j]), int((left[uses[j]] // times[j]).min()))
            if n > 0:
                repeats[j] += n
                left[uses[j]] -= n * times[j]
    return table, repeats


class _Ids(dict):
    """Ids (32 bits, little-endian) by word. White space is dropped and ends a token, so a text's ids are its words'.

    A word of letters is one unit to the tokenizer, whose last token is marked, so many such words are encoded as one text
    and told apart again; a full stop or comma after it is a unit of its own. Other words are encoded one by one.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.keys())
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = words
        plain, other, stopped = [], [".", ","], []
        for w in new:
            s = w.decode()
            if _letters(s):
                plain.append(s)
            elif s[-1] in ".," and _letters(s[:-1]):
                stopped.append(s)
                if w[:-1] not in self and w[:-1] not in new:
                    plain.append(s[:-1])
            else:
                other.append(s)
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            ids = np.array(
                self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4"
            )
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # another tokenizer: its units are not what they should be
                other += some
                continue
            data, at = ids.tobytes(), 0
            for s, e in zip(some, (4 * ends).tolist()):
                self[s.encode()] = data[at:e]
                at = e
        for i in range(0, len(other), 20_000):
            some = other[i : i + 20_000]
            for s, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self[s.encode()] = np.array(e.ids, dtype="<u4").tobytes()
        for s in stopped:
            self[s.encode()] = self[s[:-1].encode()] + self[s[-1].encode()]


def _letters(s: str) -> bool:
    """Letters only, in the form that the tokenizer brings texts to."""
    return s.isalpha() and is_normalized("NFC", s) and s == s.lower()


def _ids(path: str) -> _Ids:
    if path not in _tokenizers:
        _tokenizers[path] = _Ids(path)
    return _tokenizers[path]


def encode_words(texts: list[bytes], ids: _Ids, end: int) -> Iterator[bytes]:
    """Each text's ids and the end id, 32 bits each."""
    # the tokenizer lower-cases; doing it first keeps fewer words, but would make special tokens of other spellings
    words = [(t if b"<|" in t else t.lower()).split() for t in texts]
    ids.learn(set().union(*words))
    mark = np.array([end], dtype="<u4").tobytes()
    for w in words:
        yield b"".join(map(ids.__getitem__, w)) + mark


def _cut(docs: DataFrame, path: str, end: int, window: int, grain: int) -> DataFrame:
    """A row per document: the checksums of its whole windows and its middle, the ids of its middle and its tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            data = raw.tobytes()
            for i, j in slices(offsets, 1 << 20):
                out = []
                for found in encode_words([data[offsets[k] : offsets[k + 1]] for k in range(i, j)], ids, end):
                    n = len(found) // 4
                    whole, middle = n // window * window, n % window // grain * grain
                    blocks = [zlib.crc32(found[4 * b : 4 * (b + window)]) for b in range(0, whole, window)]
                    part, tail = found[4 * whole : 4 * (whole + middle)], found[4 * (whole + middle) :]
                    out.append((n, whole, middle, blocks, zlib.crc32(part), part, tail))
                columns = list(zip(*out))
                yield pa.record_batch([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                    *(pa.array(columns[k], pa.int64()) for k in range(3)),
                    pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.int64()),
                    # most vocabularies fit 16 bits: the upper half of each id is kept apart and packs well
                    pa.array([_split(x) for x in columns[5]], pa.binary()), pa.array(columns[6], pa.binary()),
                ], names=CUT.replace(" long", "").replace(
                    " array<long>", ""
                ).replace(" binary", "").split(", "))

    rows = small_batches(docs).select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long"), docs["text"].cast("string")
    )
    return materialize(rows.mapInArrow(run, CUT), "pack")


def _split(ids: bytes) -> bytes:
    """16-bit ids, or all 32 bits behind a mark where an id needs them."""
    a = np.frombuffer(ids, dtype="<u4")
    return b"\0" + a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else b"\1" + ids


def _joined(kept: bytes) -> bytes:
    return np.frombuffer(kept[1:], dtype="<u2" if kept[0] == 0 else "<u4").astype("<u4").tobytes()


def _ranked(df: DataFrame, keys: list[str], order: list[str], amount, name: str, buckets: int) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before, by ``keys``: within buckets of rows, plus the buckets
    before. No task sorts more than a bucket, and a key has a row per bucket."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")).withColumn("amount", amount)
    sums = df.groupBy(*keys, "bucket").agg(F.sum("amount").alias("all"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("ahead", F.coalesce(F.sum("amount").over(within), F.lit(0)))
    return df.join(sums, [*keys, "bucket"]).withColumn(
        name, F.col("base") + F.col("ahead")
    ).drop("base", "ahead", "bucket", "amount")


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, end: int = END
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of its end id alone. A null id is kept; repeated rows are documents of their own.
    An empty table gives no pieces. Other columns of ``docs`` are not read. ``window`` is a power of two and a multiple
    of ``grain``; the tokenizer must drop ASCII white space and never join words across it.
    """
    spark = docs.sparkSession
    cut = _cut(docs, tokenizer, end, window, grain)
    totals = cut.agg(F.sum(F.size("blocks")).alias("b"), F.count("*").alias("n")).first()
    n_blocks, n_rows = int(totals["b"] or 0), int(totals["n"])
    buckets = max(16, n_rows // 50_000)
    plain = cut.select("row", "doc_id", "doc_tokens")

    # whole windows
    with_blocks = cut.select("row", "doc_id", "doc_tokens", "blocks").filter(F.size("blocks") > 0)
    numbered = _ranked(with_blocks, [], ["row"], F.size("blocks"), "base_id", buckets)
    pieces = numbered.select("doc_id", "doc_tokens", "base_id", F.posexplode("blocks").alias("k", "ids_crc32"))
    pieces = pieces.select(
        "doc_id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        "ids_crc32", "doc_tokens", (F.col("base_id") + F.col("k")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset")
    )

    # middles: the places of each length, in a fixed order (at most depth * combinations rows)
    middles = cut.select("row", "doc_id", "doc_tokens", "middle_start", "middle", "middle_crc").filter("middle > 0")
    histogram = np.zeros(window // grain, dtype=np.int64)
    for length, n in middles.groupBy("middle").count().collect():
        histogram[length // grain - 1] = n
    table, repeats = repeat_counts(histogram, depth)
    places, used, sequence = [], np.zeros(len(histogram), dtype=np.int64), n_blocks
    for j in np.flatnonzero(repeats):
        at, n = 0, int(repeats[j])
        for k in np.flatnonzero(table[:, j]):
            for _ in range(int(table[k, j])):
                places.append((int((k + 1) * grain), int(used[k]), int(used[k]) + n, sequence, at))
                used[k] += n
                at += (int(k) + 1) * grain
        sequence += n
    places = spark.createDataFrame(places, "middle long, low long, high long, first_id long, offset long")
    ranked = _ranked(middles, ["middle"], ["row"], F.lit(1), "rank", buckets)
    placed = ranked.join(F.broadcast(places), "middle", "left").filter("low is null or (rank >= low and rank < high)")
    placed = placed.filter("low is not null").select(
        "doc_id", F.col("middle_start").alias("start"), F.col("middle").alias("length"),
        F.col("middle_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("first_id") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )
    limits = spark.createDataFrame(
        [(int((k + 1) * grain), int(used[k])) for k in range(len(used))], "middle long, limit long"
    )
    over = materialize(ranked.join(F.broadcast(limits), "middle").filter("rank >= limit").select("row"), "over")

    # the stream: residual middles and all tails
    rest = cut.select("row", "middle_start", "middle_ids").join(over, "row")
    stream = rest.select(
        "row", F.col("middle_start").alias("start"), "middle_ids", F.lit(None).cast("binary").alias("tail_ids")
    )
    tails = cut.select(
        "row", (F.col("middle_start") + F.col("middle")).alias("start"), F.lit(None).cast("binary").alias("middle_ids"),
        "tail_ids"
    ).filter(F.length("tail_ids") > 0)
    whole_rest = rest.select("row").limit(1)
    stream = tails.unionByName(stream) if whole_rest.count() else tails
    length = F.when(F.col("tail_ids").isNotNull(), F.length("tail_ids") / 4).otherwise(
        F.when(
            F.substring("middle_ids", 1, 1) == F.lit(b"\0"), (F.length("middle_ids") - 1) / 2
        ).otherwise((F.length("middle_ids") - 1) / 4)
    )
    stream = _ranked(
        stream.withColumn("length", length.cast("long")), [], ["row", "start"], F.col("length"), "at", buckets
    ).join(plain, "row")
    total = int(
        (tails.agg(F.sum(F.length("tail_ids") / 4)).first()[0] or 0)
        + (histogram - used) @ (np.arange(1, len(histogram) + 1) * grain)
    )
    edges = [total // window * window]  # the stream's full windows end here; then come powers of two, the largest first
    for bit in reversed(range(window.bit_length())):
        if (total - total // window * window) >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    first_id = sequence

    def cut_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, start, at, middle, tail in zip(*(c.to_pylist() for c in batch.columns)):
                ids = tail if tail is not None else _joined(middle)
                done, size = 0, len(ids) // 4
                while done < size:
                    here = at + done
                    if here < edges[0]:
                        number, begin, stop = here // window, here // window * window, (here // window + 1) * window
                    else:
                        k = int(np.searchsorted(edges, here, side="right")) - 1
                        number, begin, stop = edges[0] // window + k, edges[k], edges[k + 1]
                    take = min(size - done, stop - here)
                    out.append(
                        (
                            doc_id, start + done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), n,
                            first_id + number, here - begin
                        )
                    )
                    done += take
            columns = list(zip(*out)) or [[]] * 7
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in columns], names=PIECES.replace(" long", "").split(", ")
            )

    streamed = stream.select(
        "doc_id", "doc_tokens", "start", "at", "middle_ids", "tail_ids"
    ).mapInArrow(cut_stream, PIECES)
    return pieces.unionByName(placed).unionByName(streamed)
