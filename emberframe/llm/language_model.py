"""Language-model scores by deleted interpolation of maximum-likelihood estimates.

P(w | h) = a_b c(h, w) / c(h) + u_b c(w) / N + z_b / (V + 1), where b is the magnitude of c(h) and the weights of each b
sum to 1. Part of the training texts is held out while the weights are learned: the counts of the others give the three
estimates of each held-out pair, pairs are counted by b and by the estimates' ratios (a histogram of bounded size), and
expectation-maximisation on these counts finds the weights. The scores then use the counts of all training texts.

No count table is ever broadcast or collected. Texts are kept in batches of some MB (one row each). A batch asks for the
counts of its distinct words and pairs, ordered by hash and cut by hash range; the ranges are shuffled, each adds up what
the batches counted and answers every batch in its own order; a batch's answers, joined to its text, are all it needs.
A word or pair that fills the corpus is one entry per batch, so no key is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.shared import materialize
from emberframe.llm.words import mix, slices, text_bytes, word_hashes

#: Bytes of text in a batch.
BATCH = 8 << 20
#: Bytes of text per range of hashes: a range's entries are handled at once.
RANGE = 8 << 20
#: Magnitudes of a context's count that have weights of their own; steps of half an octave of the estimates' ratios, and
#: the binary logarithm of the first. The least ratio is (V + 1) / N, the greatest V + 1: both lie within for any corpus.
LEVELS, RATIOS, LOWEST = 40, 192, -44
#: The part of the training texts on which the weights are learned.
TRAIN, TUNE, HELD = 0, 1, 2
_END, _START = np.uint64(0xE17D) << np.uint64(40), np.uint64(0x57A7) << np.uint64(40)
TEXTS = "batch long, tuning boolean, ids array<long>, roles binary, sizes binary, text binary"
ASKED = "batch long, part long, keys binary, est binary, tune binary"
TOLD = "batch long, part long, est binary, tune binary, totals array<long>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pack(a: np.ndarray) -> bytes:
    """Compressed by byte planes."""
    return zstandard.compress(
        np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1
    ) if len(a) else b""


def _unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=kind)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(
        np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(width, -1).T
    ).view(kind).ravel()


def _texts(docs: DataFrame, role: Column, batch_bytes: int) -> DataFrame:
    """The texts in batches; those that tune the weights are in batches of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            roles = np.asarray(whole.column(2))
            for tuning in (True, False):
                some = whole.take(pa.array(np.flatnonzero((roles == TUNE) == tuning)))
                raw, offsets = text_bytes(some.column(1))
                kinds = np.asarray(some.column(2)).astype(np.uint8)
                for i, j in slices(offsets, batch_bytes):
                    sizes = np.diff(offsets[i : j + 1]).astype(np.int64)
                    yield pa.record_batch([
                        pa.array([uuid.uuid4().int >> 65]), pa.array([tuning]),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), some.column(0).slice(i, j - i)),
                        pa.array([kinds[i:j].tobytes()]), pa.array([sizes.tobytes()]),
                        pa.array([zstandard.compress(raw[offsets[i] : offsets[j]].tobytes(), 1)]),
                    ], names=["batch", "tuning", "ids", "roles", "sizes", "text"])

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), role.cast("int").alias("role"))
    return materialize(rows.mapInArrow(run, TEXTS), "texts")


def _tokens(text: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, contexts, tokens per text): each text's words and its end, each after the token before or the start."""
    raw = np.frombuffer(zstandard.decompress(text), dtype=np.uint8) if text else np.empty(0, dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype=np.int64))])
    h, n = word_hashes(raw, offsets)
    token = np.full(len(h) + len(n), _END, dtype=np.uint64)
    token[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.cumsum(n + 1) - n - 1] = _START
    return token, context, n + 1


def _keys(token: np.ndarray, context: np.ndarray, texts: int) -> np.ndarray:
    """63-bit keys of all words, all pairs and one start per text; the lowest bit tells a pair from a word."""
    word, pair = np.uint64(1), mix(context * np.uint64(0x9E3779B97F4A7C15) + token * np.uint64(0xC2B2AE3D27D4EB4F))
    start = np.full(texts, (_START >> np.uint64(1)) | word)
    return np.concatenate([(token >> np.uint64(1)) | word, (pair >> np.uint64(1)) & ~word, start])


def _ask(texts: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tuning, roles, sizes, text in zip(*(c.to_pylist() for c in batch.columns)):
                token, context, n = _tokens(text, sizes)
                counted = np.frombuffer(roles, dtype=np.uint8) != HELD
                flag = np.concatenate([np.repeat(counted, n), np.repeat(counted, n), counted]).astype(np.uint64)
                key = (_keys(token, context, len(n)) << np.uint64(1)) | flag
                key.sort()
                head = np.flatnonzero(np.concatenate([[True], key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1)]))
                count = np.add.reduceat(key & np.uint64(1), head).astype(np.uint32)
                key = key[head] >> np.uint64(1)
                part = (key >> np.uint64(63 - bits)).astype(np.int64)
                cut = np.flatnonzero(part[1:] != part[:-1]) + 1  # a row per range that the batch has a key of
                rows = list(zip(part[np.append(0, cut)].tolist(), np.split(key, cut), np.split(count, cut)))
                none = [b""] * len(rows)
                counts = [_pack(c) for _, _, c in rows]
                yield pa.record_batch([
                    pa.array([number] * len(rows)), pa.array([p for p, _, _ in rows], pa.int64()),
                    pa.array([_pack(np.diff(k, prepend=np.uint64(0))) for _, k, _ in rows], pa.binary()),
                    pa.array(none if tuning else counts, pa.binary()),
                    pa.array(counts if tuning else none, pa.binary()),
                ], names=["batch", "part", "keys", "est", "tune"])

    return texts.select("batch", "tuning", "roles", "sizes", "text").mapInArrow(run, ASKED)


def _answer(table: pa.Table) -> pa.Table:
    """The sums of one range of hashes, for each batch in the order of its own keys; and, as batch -1, the totals: tokens
    and distinct words of all training texts, then of those that are not held out for tuning."""
    table = table.sort_by("batch")
    keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()]
    sizes = [len(k) for k in keys]
    joined = np.concatenate(keys)
    sums = []
    order = np.argsort(joined)
    ordered = joined[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    head, group = np.flatnonzero(first), np.cumsum(first) - 1
    words = (ordered[head] & np.uint64(1) == 1) & (ordered[head] != (_START >> np.uint64(1)) | np.uint64(1))
    back = np.empty(len(order), dtype=np.int64)
    back[order] = group
    for name in ("est", "tune"):
        own = np.concatenate(
            [
                _unpack(c, np.uint32) if c else np.zeros(n, dtype=np.uint32) for c,
                n in zip(table[name].to_pylist(), sizes)
            ]
        )
        sums.append(np.add.reduceat(own[order].astype(np.int64), head))
    totals = [int(x) for v in (sums[0] + sums[1], sums[0]) for x in (v[words].sum(), (v[words] > 0).sum())]
    told = [np.split(s.astype(np.uint64)[back], np.cumsum(sizes)[:-1]) for s in sums]
    part = table["part"][0].as_py()
    rows = [
        (b, part, _pack(e), _pack(t), None) for b, e, t in zip(table["batch"].to_pylist(), *told)
    ] + [(-1, part, b"", b"", totals)]
    columns = list(zip(*rows))
    return pa.table(
        [
            pa.array(c, t) for c,
            t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))
        ],
        names=["batch", "part", "est", "tune", "totals"]
    )


def _estimates(batch: dict, told: pa.Table, which: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(c(h, w), c(h), c(w), tokens per text) for every token of a batch, by the sum of the named counts."""
    token, context, n = _tokens(batch["text"], batch["sizes"])
    key = _keys(token, context, len(n))
    order = np.argsort(key)
    ordered = key[order]
    index = np.empty(len(key), dtype=np.int64)
    index[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])) - 1
    told = told.sort_by("part")
    count = sum(
        np.concatenate([_unpack(c, np.uint64) for c in told[name].to_pylist()]).astype(np.int64) for name in which
    )
    t = len(token)
    word, pair = count[index[:t]], count[index[t : 2 * t]]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(n) - n] = count[index[2 * t :]]
    return pair, before, word, n


def _level(before: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2 of its count), at most LEVELS - 1."""
    return np.minimum(np.frexp(before.astype(float))[1], LEVELS - 1)


def _ratio(x: np.ndarray) -> np.ndarray:
    """0 for 0, else from 1 by steps of half an octave, with a ratio of 2**LOWEST at 1."""
    with np.errstate(divide="ignore"):
        step = np.rint(2 * (np.log2(x) - LOWEST)) + 1
    return np.where(x > 0, np.clip(step, 1, RATIOS - 1), 0).astype(np.int64)


def _value(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** ((step - 1) / 2 + LOWEST), 0.0)


def learn_weights(
    levels: np.ndarray, pairs: np.ndarray, words: np.ndarray, counts: np.ndarray, steps: int = 100
) -> np.ndarray:
    """Weights (pair, word, uniform) of each level by expectation-maximisation. The estimates are given relative to the
    uniform one. A level without counts has the weights of the level below it; the lowest starts from thirds."""
    out = np.empty((LEVELS, 3))
    last = np.full(3, 1 / 3)
    for level in range(LEVELS):
        at = levels == level
        if at.any():
            p = np.column_stack([_value(pairs[at]), _value(words[at]), np.ones(at.sum())])
            w = np.full(3, 1 / 3)
            for _ in range(steps):
                share = p * w
                share /= share.sum(1, keepdims=True)
                w = counts[at] @ share + 1e-3
                w /= w.sum()
            last = w
        out[level] = last
    return out


def score_texts(
    docs: DataFrame, held_out: Column, tuning: Column, batch_bytes: int = BATCH, range_bytes: int = RANGE,
    doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those that are not ``held_out``; of them, those with ``tuning`` teach the weights. A null text is
    empty: its one token is the end. A null id is kept; repeated rows each count. Without training texts, or for an empty
    table, every count is 0 and only the uniform estimate is left. Other columns are not returned.
    """
    docs = docs.select(
        docs[doc_id].alias("doc_id"), docs[text].alias("text"),
        F.when(held_out, HELD).when(tuning, TUNE).otherwise(TRAIN).alias("role")
    )
    texts = _texts(docs, F.col("role"), batch_bytes)
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0  # compressed to about half
    bits = max(
        1, (int(2 * size) // range_bytes).bit_length()
    )  # a range's entries stay as many, however large the corpus
    told = materialize(_ask(texts, bits).groupBy("part").applyInArrow(_answer, TOLD), "told")
    total = told.filter("batch = -1").select(*(F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(4))).first()
    tokens, words, est_tokens, est_words = (int(x or 0) for x in total)
    # answers come with the text of their batch; batches are a few MB, so a task holds one at a time
    answers = told.filter("batch >= 0").select("batch", "part", "est", "tune")

    def tune(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pair, before, word, _ = _estimates(left.to_pylist()[0], right, ("est",))
        p = pair / np.maximum(before, 1) * (est_words + 1)
        w = word / max(est_tokens, 1) * (est_words + 1)
        code = (_level(before) * RATIOS + _ratio(p)) * RATIOS + _ratio(w)
        n = np.bincount(code)
        at = np.flatnonzero(n)
        return pa.table([pa.array(at), pa.array(n[at].astype(np.int64))], names=["code", "n"])

    tuned = texts.filter("tuning").groupBy("batch").cogroup(
        answers.join(texts.filter("tuning").select("batch"), "batch", "left_semi").groupBy("batch")
    ).applyInArrow(tune, "code long, n long")
    found = np.array(
        [(r["code"], r["n"]) for r in tuned.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()],
        dtype=np.int64
    ).reshape(-1, 2)
    code = found[:, 0]
    weights = learn_weights(code // RATIOS**2, code // RATIOS % RATIOS, code % RATIOS, found[:, 1].astype(float))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.to_pylist()[0]
        pair, before, word, n = _estimates(batch, right, ("est", "tune"))
        at = np.cumsum(n) - n
        w = weights[_level(before)]
        p = w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (words + 1)
        base = np.log10((word + 1) / (tokens + words + 1))
        return pa.table([
            pa.array(batch["ids"], pa.int64()), pa.array(np.frombuffer(batch["roles"], dtype=np.uint8) == HELD),
            pa.array(n.astype(np.int64)), pa.array(np.add.reduceat((word > 0).astype(np.int64), at)),
            pa.array(np.full(len(n), tokens)), pa.array(np.add.reduceat(base, at)),
            pa.array(np.add.reduceat(np.log10(p), at)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, SCORED)
