"""Fingerprints of texts whose likeness follows the edit distance.

A random walk shared by all texts reads a text: at step j it shows the character it stands on, and a random bit of (j,
character) says whether it moves on. Where two texts differ by an edit, their walks soon stand on the same characters at the
same steps again, so that the edit distance becomes a Hamming distance of what they show (Chakraborty, Goldenberg and
Koucky, 2016). A fingerprint samples the steps: the first ``SAMPLES`` steps and as many, one in each of equal cells, of every
doubling after them until the walk leaves the text, a symbol of 6 bits each; it grows with the logarithm of a text and covers
all of it. A likeness is the share of steps, weighed by what their samples stand for, at which two walks show the same,
among those at which either is still in its text.

Near texts are found by bands of sampled steps (bit sampling) and confirmed on whole fingerprints.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.linking import link_buckets
from emberframe.llm.shared import discard, materialize, shuffle_partitions

#: Sampled steps of a doubling; bands, steps that a band shows, and steps drawn for it.
SAMPLES, BANDS, STEPS, DRAWS = 64, 24, 8, 48
#: Steps after which the walk's random bits repeat.
PERIOD = 1 << 14
#: Texts that are walked at once, for so many characters at a time, and how few are left when each goes on by itself.
LANES, STRETCH, FEW = 1024, 512, 24
#: Characters after which no further text joins those that are walked at once.
CHARACTERS = 1 << 22
#: Symbols, by their six bits; END is shown after a text.
SYMBOLS, END = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "."
_SYMBOL = np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)

_rng = np.random.default_rng(0xED17)


def _waits() -> list[bytes]:
    """For each of 256 classes of characters and each step: how many steps until the walk is on the next character."""
    moves = _rng.integers(0, 2, (256, PERIOD), dtype=np.uint8).astype(bool)
    moves[:, -1] |= ~moves.any(1)
    out = np.zeros((256, PERIOD), dtype=np.uint8)
    wait = np.full(256, 255)
    for j in range(2 * PERIOD - 1, -1, -1):  # twice around, for waits that go over the end
        wait = np.where(moves[:, j % PERIOD], 1, np.minimum(wait + 1, 255))
        out[:, j % PERIOD] = wait
    return [r.tobytes() for r in out]


_WAIT = _waits()
_WAITS = np.frombuffer(b"".join(_WAIT), dtype=np.uint8)
#: Sampled steps of the first doublings, more than any text that fits in a row needs.
_STEP = np.concatenate([
    np.arange(SAMPLES), *[
        SAMPLES * 2**s + np.arange(SAMPLES) * 2**s + _rng.integers(0, 2**s, SAMPLES) for s in range(30)
    ]
])


def _mixed(codes: np.ndarray) -> np.ndarray:
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def code_points(text: bytes) -> np.ndarray:
    """The characters of UTF-8 text; bytes that are none count as replacement characters."""
    return np.frombuffer(text.decode(errors="replace").encode("utf-32-le"), dtype=np.uint32)


def walk(codes: np.ndarray, start: int = 0) -> list[int]:
    """The step at which the walk comes to each character, and leaves the last, from step ``start`` on."""
    step, out = start, []
    for c in (_mixed(codes) >> np.uint64(56)).astype(np.uint8).tobytes():
        out.append(step)
        step += _WAIT[c][step & (PERIOD - 1)]
    out.append(step)
    return out


def walks(texts: list[np.ndarray], starts: list[int] | None = None) -> list[np.ndarray]:
    """``walk`` of each of some texts. All go on by a character at a time, the longest first in the row, until ``FEW`` are left;
    these end one after the other."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order], dtype=np.int64)
    together = int(lengths[FEW]) if len(order) > FEW else 0
    step = np.array([starts[k] if starts else 0 for k in order], dtype=np.int64)
    came = [np.empty(len(texts[k]) + 1, dtype=np.int64) for k in order]
    for first in range(0, together, STRETCH):
        inside = np.searchsorted(-lengths, -np.arange(first, min(first + STRETCH, together)))  # texts with a character there
        kinds = np.zeros((len(inside), inside[0]), dtype=np.int32)
        for lane in range(inside[0]):
            own = texts[order[lane]][first : first + len(inside)]
            kinds[: len(own), lane] = (_mixed(own) >> np.uint64(56)).astype(np.int32) * PERIOD
        at = np.zeros(kinds.shape, dtype=np.int64)
        for j, n in enumerate(inside.tolist()):
            now = step[:n]
            at[j, :n] = now
            now += _WAITS[kinds[j, :n] + (now & (PERIOD - 1))]
        for lane in range(inside[0]):
            part = came[lane][first : first + len(inside)]
            part[:] = at[: len(part), lane]
    out = [step] * len(texts)
    for lane, k in enumerate(order):
        done = min(together, len(texts[k]))
        came[lane][done:] = walk(texts[k][done:], int(step[lane]))
        out[k] = came[lane]
    return out


def fingerprint(codes: np.ndarray, steps: list[int] | np.ndarray) -> str:
    """The symbols shown at the sampled steps of a walk (see ``walk``), up to the end of the doubling in which it ends."""
    if not len(codes):
        return ""
    doublings = max(0, (int(steps[-1]) - 1) // SAMPLES).bit_length()
    sampled = _STEP[: SAMPLES * (1 + doublings)]
    at = np.searchsorted(np.asarray(steps), sampled, side="right") - 1
    inside = at < len(codes)
    symbol = _SYMBOL[((_mixed(codes[at[inside]]) >> np.uint64(48)) & np.uint64(63)).astype(np.int64)]
    out = np.full(len(sampled), ord(END), dtype=np.uint8)
    out[inside] = symbol
    return out.tobytes().decode()


def _weights(n: int) -> np.ndarray:
    """What each of n samples stands for: a step, or a cell of a doubling."""
    return 2.0 ** np.maximum(np.arange(n) // SAMPLES - 1, 0)


def likeness(a: str, b: str) -> float:
    """The weighed share of samples at which two fingerprints agree, from 0 to 1; 1 for two empty texts."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(v.ljust(n, END).encode(), dtype=np.uint8) for v in (a, b))
    counted = _weights(n) * ((x != ord(END)) | (y != ord(END)))
    return float(counted[x == y].sum() / counted.sum())


# ------------------------------------------------------------------ texts and their edits


def _spliced(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    half = len(codes) // 2
    return np.concatenate([codes[: len(codes) - half], after[:half]])


def _place(doc_id: int | None, text_hash: int, row: int) -> tuple[bool, int, int, int]:
    """Where a row stands: by id, rows without one last; equal ids by their texts' hashes, repeated rows by their number."""
    return doc_id is None, doc_id or 0, text_hash, row


_DEALT = (
    "part int, guest boolean, doc_id long, text_hash long, row long, is_text boolean, component long, packed binary"
)


def _dealt(heads: list[tuple]):
    """Rows (doc_id, text_hash, row, said, component, text) with their part. ``said`` rows tell a text's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, hashes, numbers, said, component = (batch.column(k).to_pylist() for k in range(5))
            for first in range(0, len(batch), 256):
                rows = []
                for k in range(first, min(first + 256, len(batch))):
                    place = _place(ids[k], hashes[k], numbers[k])
                    part = bisect.bisect_right(heads, place) - 1
                    text = None if said[k] else pack.compress(batch.column(5)[k].as_py() or b"")
                    row = (ids[k], hashes[k], numbers[k], not said[k], component[k], text)
                    rows.append((part, False, *row))
                    if heads[part] == place and not said[k]:  # the part before ends with this row's beginning
                        rows.append(((part - 1) % len(heads), True, *row))
                kinds = (
                    pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()
                )
                yield pa.record_batch(
                    [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)],
                    names=[c.split()[0] for c in _DEALT.split(", ")]
                )

    return run


_EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, component_id long, kept boolean"
)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, guest and place, what is said of a text before it: every row but a part's guest, which comes last,
    with the row after it."""
    unpack = zstandard.ZstdDecompressor()
    before: tuple | None = None
    out: list[tuple] = []

    def told() -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _EDITED.split(", ")])
        made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        out.clear()
        return made

    def texts() -> Iterator[list[tuple]]:
        """Some rows at a time: part, guest, doc_id, component and text."""
        component: int | None = None
        names, some = ("part", "guest", "doc_id", "is_text", "component", "packed"), []
        size = 0
        for batch in batches:
            for part, guest, doc_id, is_text, said, packed in zip(*(batch.column(n) for n in names)):
                if not is_text.as_py():
                    component = said.as_py()
                    continue
                codes = code_points(unpack.decompress(packed.as_buffer()))
                some.append((part.as_py(), guest.as_py(), doc_id.as_py(), component, codes))
                size += len(codes)
                if len(some) == LANES or size > CHARACTERS:
                    yield some
                    some, size = [], 0
        yield some

    for some in texts():
        steps = walks([row[-1] for row in some])
        pairs = []
        for (part, guest, doc_id, component, codes), own_steps in zip(some, steps):
            now = part, doc_id, component, codes, own_steps, fingerprint(codes, own_steps)
            if before is not None:
                if before[0] != part:
                    raise RuntimeError("a part has no row after its last: the table gave other rows when read again")
                pairs.append((before, now, _spliced(before[3], codes)))
            before = None if guest else now
        stays = [len(own[3]) - len(own[3]) // 2 for own, _, _ in pairs]
        # the edited text is walked from where it differs
        rest = walks(
            [edited[n:] for n, (_, _, edited) in zip(stays, pairs)], [int(own[4][n]) for n, (own, _, _) in zip(stays, pairs)]
        )
        for n, (own, after, edited), more in zip(stays, pairs, rest):
            _, own_id, top, codes, own_steps, own_print = own
            edited_print = fingerprint(edited, np.concatenate([own_steps[:n], more]))
            digest = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
            out.append((
                own_id, len(codes), digest, own_print, edited_print, likeness(own_print, edited_print),
                likeness(own_print, after[5]), top, top is None or top == own_id
            ))
        if len(out) >= 1000:
            yield told()
    if before is not None:
        raise RuntimeError("a part has no row after its last: the table gave other rows when read again")
    if out:
        yield told()


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    text_ = docs[text].cast("string")
    return docs.select(
        docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(text_).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"), text_.cast("binary").alias("text")
    )


def compare_edits(
    docs: DataFrame, threshold: float | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, the fingerprint of its text and of an edited text, how like its
    fingerprint is to the edited text's and to the next document's; with a ``threshold``, component_id and kept of
    ``near_texts`` too.

    The edited text's last floor(n_chars / 2) code points are the first as many, or all, of the next document's, by
    ascending id. Rows without an id come last, rows that repeat an id in the order of their texts' hashes; after the last
    comes the first, so a table of one row is its own next. A null text is empty, and an empty text is like an empty one
    (1). Other columns are not returned. Rows are numbered by their place, so ``docs`` must give the same rows in the same
    partitions when it is read again, as files do.

    Texts are shuffled once, compressed, into ranges of ids of equal size, in which they are sorted; the first row of a range is
    also sent to the range before it. Components, if any, come along in the same shuffle, each ahead of its text.
    """
    rows = _rows(docs, doc_id, text)
    ranged = rows.select(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("at"), "text_hash", "row"
    ).repartitionByRange(shuffle_partitions(docs.sparkSession), "none", "at", "text_hash", "row")
    heads = ranged.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min(F.struct("none", "at", "text_hash", "row")).alias("head")
    )
    bounds = sorted(tuple(r["head"]) for r in heads.collect())  # a row per partition
    if not bounds:
        out = docs.sparkSession.createDataFrame([], _EDITED)
        return out if threshold is not None else out.drop("component_id", "kept")
    told = rows.select(
        "doc_id", "text_hash", "row", F.lit(False).alias("said"), F.lit(None).cast("long").alias("component"), "text"
    )
    if threshold is not None:
        told = told.unionByName(materialize(_labelled(rows, threshold), "labelled").select(
            "doc_id", "text_hash", "row", F.lit(True).alias("said"), "component",
            F.lit(None).cast("binary").alias("text")
        ))
    dealt = told.mapInArrow(_dealt(bounds), _DEALT)
    dealt = dealt.repartitionById(len(bounds), "part").sortWithinPartitions(
        "part", "guest", F.col("doc_id").asc_nulls_last(), "text_hash", "row", "is_text"
    )
    out = dealt.mapInArrow(_edited, _EDITED)
    return out if threshold is not None else out.drop("component_id", "kept")


# ------------------------------------------------------------------ near texts


def _bands() -> list[np.ndarray]:
    """For each number of doublings: a list of samples for each band, drawn in proportion to the steps that they stand for."""
    draw = np.random.default_rng(0xBA4D)
    out = []
    for doublings in range(31):
        weight = _weights(SAMPLES * (1 + doublings))
        out.append(draw.choice(len(weight), (BANDS, DRAWS), p=weight / weight.sum()))
    return out


_BANDS = _bands()
#: A number for each band of each number of doublings.
_SALT = np.random.default_rng(0x5A17).integers(0, 1 << 64, (len(_BANDS), BANDS), dtype=np.uint64)


def band_keys(prints: list[str], threshold: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``prints``, bucket) of some fingerprints: a fingerprint's bands among texts of as many doublings; and of one
    more, if a text of so many can be as like as ``threshold``, for then its own steps are that share of the other's at least.

    A band shows the first ``STEPS`` samples of its list that are inside the text. Where the first of those inside either of
    two texts all agree, they are the first of both, so texts of a likeness s share a band with a probability of s**STEPS, and
    what is shown is never the mere end of a text. Eight symbols of a byte, mixed with the band and the last sample's place,
    are a bucket's 64 bits."""
    by_level: dict[int, list[int]] = {}
    for k, p in enumerate(prints):
        if p:
            by_level.setdefault(len(p) // SAMPLES - 1, []).append(k)
    places, keys = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
    for level, some in by_level.items():
        of, shown = np.array(some), np.frombuffer("".join(prints[k] for k in some).encode(), dtype=np.uint8)
        shown = shown.reshape(len(some), -1)
        long = (shown != ord(END)) @ _weights(shown.shape[1]) >= (threshold - 0.05) * SAMPLES * 2**level
        for doublings, which in ((level, np.full(len(some), True)), (level + 1, long)):
            padded = np.pad(
                shown[which], ((0, 0), (0, SAMPLES * (doublings - level))), constant_values=ord(END)
            )
            drawn = padded[:, _BANDS[doublings]]
            first = np.argsort(drawn == ord(END), axis=2, kind="stable")[..., :STEPS]
            words = np.ascontiguousarray(np.take_along_axis(drawn, first, axis=2)).view(np.uint64)[..., 0]
            keys.append(_mixed(_mixed(words) ^ _SALT[doublings] ^ first[..., -1].astype(np.uint64)).ravel())
            places.append(np.repeat(of[which], BANDS))
    return np.concatenate(places), np.concatenate(keys).view(np.int64)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, some, size = [], [], 0
        for k, text in enumerate(batch.column(3), 1):
            some.append(code_points(text.as_py() or b""))
            size += len(some[-1])
            if len(some) == LANES or size > CHARACTERS or k == len(batch):
                prints += map(fingerprint, some, walks(some))
                some, size = [], 0
        yield pa.record_batch(
            [*batch.columns[:3], pa.array(prints, pa.string())], names=["doc_id", "text_hash", "row", "fingerprint"]
        )


def _keyed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 1000):
                batch = whole.slice(first, 1000)
                place, keys = band_keys(batch.column(1).to_pylist(), threshold)
                yield pa.record_batch([pa.array(keys), batch.column(0).take(pa.array(place))], names=["key", "rep"])

    return run


def _alike(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = pa.array([likeness(x, y) >= threshold for x, y in pairs], pa.bool_())
            yield pa.record_batch([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _pairs_alike(threshold: float):
    """Of a table's fingerprints: what says which pairs of places are as like as ``threshold``, by ``likeness``."""

    def of(table: pa.Table):
        prints = table.column("fingerprint").to_pylist()
        n = max(map(len, prints))
        shown = np.frombuffer("".join(p.ljust(n, END) for p in prints).encode(), dtype=np.uint8).reshape(len(prints), n)
        inside = np.packbits(shown != ord(END), axis=1).view(np.uint64)  # a doubling's samples are 64 bits
        weight = _weights(n)[::SAMPLES]

        def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            same = np.packbits(shown[i] == shown[j], axis=1).view(np.uint64) & inside[i]
            agree, counted = (np.bitwise_count(x) @ weight for x in (same, inside[i] | inside[j]))
            return agree / counted >= threshold

        return alike

    return of


def _labelled(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (doc_id, text_hash, row, text) as (doc_id, text_hash, row, component); see ``near_texts``. A class of equal
    fingerprints goes by their hash of 64 bits; n classes share one with a probability of n^2 / 2^65, and then count as equal.

    Fingerprints are written once, buckets are shuffled once, and only fingerprints with a mate in a bucket are sent."""
    prints = rows.mapInArrow(_printed, "doc_id long, text_hash long, row long, fingerprint string")
    prints = materialize(prints.withColumn("rep", F.xxhash64("fingerprint")), "prints", compression="zstd")
    named = prints.filter("doc_id is not null and fingerprint <> ''")
    placed = named.select("rep", "fingerprint").mapInArrow(_keyed(threshold), "key long, rep long").repartition("key")
    several = placed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    members = placed.join(several.filter("low <> high").select("key"), "key").distinct()
    members = materialize(members, "members")
    sent = named.select("rep", "fingerprint").join(members.select("rep").distinct(), "rep")
    sent = materialize(sent.groupBy("rep").agg(F.first("fingerprint").alias("fingerprint")), "sent", compression="zstd")

    def confirm(pairs: DataFrame) -> DataFrame:
        x, y = (sent.select(F.col("rep").alias(c), F.col("fingerprint").alias(f"p{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "pa", "pb")
        return both.mapInArrow(_alike(threshold), "a long, b long")

    def send(cells: DataFrame) -> DataFrame:
        return cells.join(sent, "rep").select(*cells.columns, "fingerprint")

    found = link_buckets(members, confirm, send, _pairs_alike(threshold))
    discard(members, sent)
    of = named.groupBy("rep").agg(F.min("doc_id").alias("doc"))
    of = of.withColumn("group", F.col("rep")) if found is None else of.join(
        found, F.col("rep") == F.col("node"), "left"
    ).withColumn("group", F.coalesce("component", "rep"))
    least = of.groupBy("group").agg(F.min("doc").alias("least"))
    of = of.join(least, "group").select("rep", "least")
    top = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return prints.join(of, "rep", "left").select("doc_id", "text_hash", "row", top.alias("component"))


def near_texts(
    docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the least id reachable by links) and kept.

    Two texts are linked when they share a band and their fingerprints are at least ``threshold`` alike. Null and empty
    texts link with nothing, and neither do rows with a null id: their component_id is null and they are kept. Equal texts
    have equal fingerprints and are one from the start; rows that repeat an id are judged by their own texts each. Other
    columns are not returned. Buckets are not expanded into pairs: fingerprints meet their buckets' leaders, and what that
    leaves apart meets the rest of the bucket where its fingerprints are sent (``linking.link_buckets``).
    """
    return _labelled(_rows(docs, doc_id, text), threshold).select(
        "doc_id", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept")
    )
