"""Exact removal of repeated passages by a column-wise construction over many texts.

A byte goes when it lies in a string of ``length`` bytes that also starts anywhere else. Inserting one symbol of every
whole document a round takes as many rounds as the longest document has bytes, and each round passes over everything
inserted so far; that is quadratic and was given up for whole texts (see README). The construction is kept, on segments:

1. Every window of ``length`` bytes is assigned to its anchor: the position of the least hash of its ``gram``-byte grams.
   Equal windows have equal anchors at equal offsets, and the windows of one anchor are consecutive, so a document falls
   into segments, one per anchor, each holding a run of windows. Segments whose anchor occurs once hold no repeat.
2. Segments that are equal as a whole are counted, not compared. Of each, one is a representative.
3. The representatives of an anchor are aligned at it. Column by column, one symbol of each segment is inserted: the
   order of the segments by their reversed prefixes (the positional Burrows-Wheeler transform) and the column in which
   each one's common suffix with its predecessor begins are updated from the column before. Neighbours whose common part
   reaches back ``length`` columns hold a repeated window. Columns are visited in sequence and only the last is kept, so
   a round costs the number of segments, and the number of rounds is bounded by 2 * length, whatever a document's length.
4. An anchor with more than ``crowd`` different segments would fill one task: its windows are hashed and counted by hash
   instead, which spreads them over all tasks.

Passages can be measured in words as well: each text is then handled as the sequence of its words' 32-bit codes, in which a
passage of n words is a string of 4 n bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.shared import materialize, small_batches
from emberframe.llm.words import mix, powers, slices, text_bytes, word_hashes, word_spans

LENGTH, GRAM, CROWD = 400, 24, 4096
#: Bytes of text whose grams are hashed at once.
CHUNK = 1 << 18
#: Bytes of a word's code.
CODE = 4
_CASED = np.random.default_rng(0xCA5E).integers(0, 2**64, 256, dtype=np.uint64)
SEGMENTS = "doc_id long, text_hash long, anchor long, segment long, start long, windows int, at int, done int"


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    n = len(v) - width + 1
    if n <= 0:
        return np.empty(0, dtype=v.dtype)
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _running(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_CASED[raw] * power[: len(raw)], out=total[1:])
    return total, inverse


def anchored_segments(
    raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> dict[str, np.ndarray]:
    """The segments of consecutive rows of text: row, start (in the row), windows, anchor's place in the segment (at),
    anchor hash, segment hash, and whether the segment is one of several equal ones of its row."""
    n, sizes = len(raw), np.diff(offsets)
    long = sizes >= length
    empty = {k: np.empty(0, dtype=np.int64) for k in ("row", "start", "windows", "at", "anchor", "segment", "again")}
    if not long.any():
        return empty
    total, inverse = _running(raw)
    grams = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | place, length - gram + 1)
    mark = np.zeros(n + 1, dtype=np.int8)
    np.add.at(mark, offsets[:-1][long], 1)
    np.add.at(mark, offsets[1:][long] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8) > 0)
    anchor_at = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (anchor_at[1:] != anchor_at[:-1])]))
    windows = np.diff(np.append(first, len(p)))
    start, anchor_at = p[first], anchor_at[first]
    row = np.searchsorted(offsets, start, side="right") - 1
    ends = start + windows - 1 + length
    at = anchor_at - start
    whole = mix(
        (total[ends] - total[start]) * inverse[start]
    ) ^ (at.astype(np.uint64) << np.uint64(32)) ^ windows.astype(np.uint64)
    anchor, segment = grams[anchor_at].view(np.int64), mix(whole).view(np.int64)
    key = mix(anchor.view(np.uint64) ^ mix(segment.view(np.uint64) + row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=np.int64)  # 0: alone in its row; 1: the first of several; 2: a later one
    again[order[1:][same]] = 2
    heads = order[:-1][same]
    again[heads[again[heads] == 0]] = 1
    return {
        "row": row, "start": start - offsets[row], "windows": windows, "at": at, "anchor": anchor, "segment": segment,
        "again": again
    }


def coded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the codes of each row's words (lower-cased A-Z), some rows at a time. Two words share a code
    with probability 2**-32."""
    parts, counts = [], []
    for i, j in slices(offsets, CHUNK):
        h, n = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((h >> np.uint64(32)).astype("<u4").view(np.uint8))
        counts.append(n)
    ends = CODE * np.cumsum(np.concatenate([[0], *counts]).astype(np.int64))
    return np.concatenate([np.empty(0, dtype=np.uint8), *parts]), ends


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, byte from, byte to): runs of rows, or parts of a long row that overlap by length - 1."""
    for i, j in slices(offsets, CHUNK):
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= 2 * CHUNK:
            yield i, j, low, high
            continue
        for part in range(low, high - length + 1, CHUNK):
            yield i, j, part, min(high, part + CHUNK + length - 1)


def _segments(docs: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """All segments of the texts, or with ``words`` of their codes. ``done`` is 1 where a row's own repeats already decide
    (no anchor is given then), else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            if words:
                raw, offsets = coded(raw, offsets)
            for i, j, low, high in _pieces(offsets, length):
                inside = np.array([0, high - low]) if (low, high) != (
                    offsets[i], offsets[j]
                ) else offsets[i : j + 1] - low
                s = anchored_segments(raw[low:high], inside, length, gram)
                row, start = s["row"] + i, s["start"] + (low - offsets[i] if len(inside) == 2 else 0)
                for done in (0, 1):
                    k = np.flatnonzero(s["again"] >= 1 if done else s["again"] <= 1)
                    if not len(k):
                        continue
                    r, st, w = row[k], start[k], s["windows"][k]
                    at, anchor, segment = s["at"][k], s["anchor"][k], s["segment"][k]
                    if done:  # neighbouring runs of windows become one
                        o = np.lexsort((st, r))
                        r, st, w = r[o], st[o], w[o]
                        head = np.flatnonzero(
                            np.concatenate([[True], (r[1:] != r[:-1]) | (st[1:] != st[:-1] + w[:-1])])
                        )
                        last = np.append(head[1:], len(r)) - 1
                        w = st[last] + w[last] - st[head]
                        r, st, at, anchor, segment = r[head], st[head], np.zeros(
                            len(head), dtype=np.int64
                        ), np.zeros(len(head), dtype=np.int64), np.zeros(len(head), dtype=np.int64)
                    rows = pa.array(r)
                    yield pa.record_batch([
                        batch.column(0).take(rows), batch.column(2).take(rows), pa.array(anchor), pa.array(segment),
                        pa.array(st), pa.array(w.astype(np.int32)), pa.array(at.astype(np.int32)),
                        pa.array(np.full(len(r), done, dtype=np.int32)),
                    ], names=SEGMENTS.replace(" long", "").replace(" int", "").split(", "))

    return materialize(docs.select("doc_id", "text", "text_hash").mapInArrow(run, SEGMENTS), "segments")


def columnwise_repeats(
    texts: list[bytes], at: np.ndarray, group: np.ndarray, length: int = LENGTH
) -> list[list[tuple[int, int]]]:
    """For segments aligned at their anchors: runs [from, to) of the window starts, within each segment, at which another
    segment of the same group has the same ``length`` bytes in the same columns."""
    n = len(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    left, right = int(at.max()), int((size - at).max())
    columns = np.full((left + right, n), 256, dtype=np.uint16)  # a symbol of its own outside of a segment
    for i, t in enumerate(texts):
        columns[left - at[i] : left - at[i] + len(t), i] = np.frombuffer(t, dtype=np.uint8)
    rank = np.unique(group, return_inverse=True)[1].astype(np.uint64) << np.uint64(40)
    order = np.argsort(rank, kind="stable")
    begin = np.zeros(n, dtype=np.int64)  # the column in which the common suffix with the predecessor begins
    position = np.arange(n, dtype=np.uint64)
    hit = np.zeros((n, int((size - length + 1).max()) + 2), dtype=bool)
    for c in range(left + right):
        symbol = columns[c, order]
        key = rank[order] | (symbol.astype(np.uint64) << np.uint64(24)) | position
        key.sort()
        old = (key & np.uint64(0xFFFFFF)).astype(np.int64)
        alike = np.zeros(n, dtype=bool)  # has a predecessor with the same symbol in its group
        alike[1:] = (key[1:] >> np.uint64(24)) == (key[:-1] >> np.uint64(24))
        alike &= (key >> np.uint64(24) & np.uint64(0xFFFF)) != 256
        new = np.full(n, c + 1, dtype=np.int64)
        here = np.flatnonzero(alike)
        if len(here):
            low, high = old[here - 1] + 1, old[here]
            value = begin[high]
            far = np.flatnonzero(high > low)
            if len(far):  # the greatest of the columns between the two old places
                bounds = np.column_stack([low[far], high[far] + 1]).ravel()
                value[far] = np.maximum.reduceat(np.append(begin, 0), bounds)[::2]
            new[here] = value
        order, begin = order[old], new
        reach = np.flatnonzero(alike & (begin <= c + 1 - length))
        if len(reach):
            for k in (order[reach], order[reach - 1]):
                hit[k, c + 1 - length - left + at[k]] = True
    edges = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    rows, starts = np.nonzero(edges == 1)
    _, stops = np.nonzero(edges == -1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for r, a, b in zip(rows.tolist(), starts.tolist(), stops.tolist()):
        out[r].append((a, b))
    return out


FOUND = "anchor long, segment long, runs array<struct<low:int,high:int>>"


def _runs(values: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array(
        [[{"low": a, "high": b} for a, b in v] for v in values],
        pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    )


def _compare(texts: DataFrame, length: int, batch_bytes: int = 8 << 20) -> DataFrame:
    """Repeated windows among the segments (anchor, segment, at, data) of each anchor: whole anchors are gathered up to
    ``batch_bytes`` and handled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                anchor, segment, at, data = zip(*rows)
                runs = columnwise_repeats(
                    list(data), np.array(at, dtype=np.int64), np.array(anchor, dtype=np.int64), length
                )
                keep = [i for i, r in enumerate(runs) if r]
                yield pa.record_batch(
                    [
                        pa.array([anchor[i] for i in keep], pa.int64()),
                        pa.array([segment[i] for i in keep], pa.int64()), _runs([runs[i] for i in keep])
                    ],
                    names=["anchor", "segment", "runs"]
                )

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > batch_bytes and row[0] != held[-1][0]:
                    yield from flush(held)
                    held, size = [], 0
                if held and held[-1][:2] == row[:2]:
                    continue  # from a repeated row
                held.append(row)
                size += len(row[3])
        yield from flush(held)

    return texts.repartition("anchor").sortWithinPartitions("anchor", "segment").select(
        "anchor", "segment", "at", "data"
    ).mapInArrow(run, FOUND)


def _count_windows(texts: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors: windows are hashed, and hashes that occur in two segments are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, segment, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                total, inverse = _running(np.frombuffer(data, dtype=np.uint8))
                n = len(data) - length + 1
                h = mix((total[length:] - total[:-length]) * inverse[:n])
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, anchor)), pa.array(np.full(n, segment)),
                        pa.array(np.arange(n, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32) - at),
                        pa.array(h.view(np.int64))
                    ],
                    names=["anchor", "segment", "k", "column", "window"]
                )

    windows = texts.select("anchor", "segment", "at", "data").mapInArrow(
        run, "anchor long, segment long, k int, column int, window long"
    )
    several = windows.groupBy("anchor", "column", "window").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    hits = windows.join(several, ["anchor", "column", "window"])
    return hits.groupBy("anchor", "segment").agg(
        F.transform(
            F.array_sort(F.collect_set("k")), lambda k: F.struct(k.alias("low"), (k + 1).cast("int").alias("high"))
        ).alias("runs")
    )


def _intervals(docs: DataFrame, length: int, gram: int, crowd: int, words: bool = False) -> DataFrame:
    """(doc_id, text_hash, spans): the removed bytes' [low, high) of each text that has any, in order, disjoint; with
    ``words`` those of its codes."""
    segments = _segments(docs, length, gram, words)
    open_ = segments.filter("done = 0")
    kinds = open_.groupBy("anchor", "segment").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "windows", "at")).alias("one")
    )
    crowds = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("uses")).filter("uses > 1")
    kinds = materialize(kinds.join(crowds, "anchor").select("anchor", "segment", "n", "kinds", "one.*"), "kinds")

    # the texts of representatives that share an anchor with others
    wanted = kinds.filter("kinds > 1").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("anchor", "segment", "kinds", "start", "windows", "at")).alias("parts")
    )
    texts = _join_docs(docs, materialize(wanted, "wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, parts in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_buffer()
                if words:
                    data = pa.py_buffer(coded(raw := np.frombuffer(data, dtype=np.uint8), np.array([0, len(raw)]))[0])
                out += [
                    (
                        p["anchor"], p["segment"], p["kinds"], p["at"],
                        data[p["start"] : p["start"] + p["windows"] - 1 + length].to_pybytes()
                    ) for p in parts
                ]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.record_batch(
                [
                    pa.array(c, t) for c,
                    t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))
                ],
                names=["anchor", "segment", "kinds", "at", "data"]
            )

    texts = texts.select("text", "parts").mapInArrow(cut, "anchor long, segment long, kinds long, at int, data binary")
    texts = materialize(texts, "texts")
    found = _compare(texts.filter(F.col("kinds") <= crowd), length)
    if texts.filter(F.col("kinds") > crowd).limit(1).count():
        found = found.unionByName(
            _count_windows(texts.filter(F.col("kinds") > crowd).dropDuplicates(["anchor", "segment"]), length)
        )

    whole = F.array(F.struct(F.lit(0).alias("low"), F.col("windows").alias("high")))
    told = kinds.filter("n > 1").select("anchor", "segment", whole.alias("runs"))
    told = told.unionByName(
        found.join(kinds.filter("n > 1").select("anchor", "segment"), ["anchor", "segment"], "left_anti")
    )
    hits = open_.join(materialize(told, "told"), ["anchor", "segment"]).select(
        "doc_id", "text_hash", "start", F.explode("runs").alias("run")
    )
    hits = hits.select(
        "doc_id", "text_hash", (F.col("start") + F.col("run.low")).alias("low"),
        (F.col("start") + F.col("run.high") - 1 + length).alias("high")
    )
    own = segments.filter("done = 1").select(
        "doc_id", "text_hash", F.col("start").alias("low"),
        (F.col("start") + F.col("windows") - 1 + length).alias("high")
    )
    spans = F.array_sort(F.collect_set(F.struct("low", "high")))
    return materialize(hits.unionByName(own).groupBy("doc_id", "text_hash").agg(spans.alias("spans")), "spans")


def _join_docs(docs: DataFrame, extra: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` with the columns of ``extra`` (doc_id, text_hash, ...), which has a row for every text with a repeat: it
    grows with the input, so both sides are shuffled at every size."""
    extra = extra.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    on = docs["doc_id"].eqNullSafe(extra["_id"]) & docs["text_hash"].eqNullSafe(extra["_hash"])
    return docs.join(extra.hint("merge"), on, how).drop("_id", "_hash")


def _word_runs(data: bytes, spans: list[list[int]]) -> list[list[int]]:
    """The bytes of a text from the first to the last whole word of each span of its codes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
    return [[int(starts[-(-low // CODE)]), int(ends[high // CODE - 1])] for low, high in spans]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(docs)
    text_ = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(
        docs[doc_id].cast("long").alias("doc_id"), text_.alias("text"), F.xxhash64(text_).alias("text_hash")
    )


def _merged(spans: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted((x["low"], x["high"]) for x in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([s[0], s[1]])
    return out


def _kept(data: bytes, spans: list[list[int]]) -> bytes:
    at, parts = 0, []
    for low, high in spans:
        parts.append(data[at:low])
        at = high
    return b"".join([*parts, data[at:]])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, doc_id: str = "doc_id",
    text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.

    Texts are UTF-8 bytes, a null is empty; matches never cross texts. Rows that repeat an id with the same text are
    texts of their own, so each is a repeat of the other. A null id is kept as null. An empty table gives an empty
    result. Other columns are not returned.
    """
    keyed = _keyed(docs, doc_id, text)
    joined = _join_docs(keyed, _intervals(keyed, length, gram, crowd), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, found in zip(batch.column(1), batch.column(2).to_pylist()):
                data = t.as_buffer().to_pybytes()
                spans = _merged(found)
                out.append(
                    (
                        len(data), sum(b - a for a, b in spans), len(spans),
                        hashlib.sha256(_kept(data, spans)).hexdigest()
                    )
                )
            columns = list(zip(*out)) or [[]] * 4
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return joined.mapInArrow(run, RESULT)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, words: int | None = None, gram: int = GRAM, crowd: int = CROWD,
    doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars"
) -> DataFrame:
    """The rows of ``docs`` with their columns, ``text`` without its repeated passages and ``n_chars`` (where there is such
    a column) counted anew.

    A passage is a string of ``length`` bytes or, where ``words`` is given, of so many words, whatever the white space
    between them and the case of A-Z; it goes from its first word to its last. Of a character of which only some bytes
    went, the rest goes too. A null text stays null, an emptied text stays as an empty row. Rows that repeat an id with
    the same text are texts of their own, so each is a repeat of the other; rows with a null id count as any other. An
    empty table stays empty, and columns may have any names.
    """
    keyed = _keyed(docs, doc_id, text)
    spans = _intervals(keyed, length, gram, crowd) if words is None else _intervals(
        keyed, CODE * words, gram, crowd, True
    )
    hashed = docs.select(
        *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs[doc_id].cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("text_hash")
    )
    joined = _join_docs(hashed, spans, "left")
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = joined.select(*names).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, found in zip(batch.column(at), batch.column(len(names)).to_pylist()):
                if not found or not t.is_valid:
                    kept.append(t.as_py())
                    continue
                data, runs = t.as_buffer().to_pybytes(), _merged(found)
                kept.append(_kept(data, runs if words is None else _word_runs(data, runs)).decode(errors="ignore"))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(kept, batch.column(at).type)
            yield pa.record_batch(columns, names=names)

    out = joined.select(*names, "spans").mapInArrow(run, schema)
    out = out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    if n_chars in docs.columns:
        out = out.withColumn(
            n_chars,
            F.when(
                F.col(text).isNotNull(), F.length(text)
            ).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType)
        )
    return out
