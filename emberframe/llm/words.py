"""Words, shingles and hashes of whole texts, computed on the UTF-8 bytes of Arrow columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Since these are all ASCII, working
on bytes gives the same words as working on characters. Hashes have 64 bits: a word's bytes are mapped to random 64-bit
values, summed with powers of an odd base modulo 2**64 (differences of one running sum give every word) and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POSITION = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes hashed at once; small enough for a core's cache.
TILE = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64, from 0 to at least n."""
    size = 1 << max(TILE.bit_length(), int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        made = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size + 1, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[size] = (made[0], made[1])
    return _powers[size]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of at most 2**15 rows holding about ``limit`` bytes; a row is never split."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, first + (1 << 15))
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of all words; a word never crosses a row's end."""
    inside = _WORD[raw]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given spans, which are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + TILE, side="right")))
        high = ends[last - 1]
        power, inverse = powers(high - low)
        running = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * power[: high - low], out=running[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (running[e] - running[s]) * inverse[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per row)."""
    starts, ends, counts = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), counts


def tuple_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (rows are not told apart)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += h[k : k + n] * _POSITION[k]
    return mix(total)


def shingle_sets(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of 64 bits ordered by row and hash, number per row). A row with fewer words than ``size``
    has its whole sequence as its one shingle, a row without words has none. A row's set does not depend on the rows that
    come with it."""
    ends = np.cumsum(counts)
    begins = ends - counts
    long = counts >= size
    length = np.where(long, counts - size + 1, np.minimum(counts, 1))
    last = np.cumsum(length)
    first = last - length
    values = np.empty(int(length.sum()), dtype=np.uint64)
    # a shingle starts at each word but the last size-1 of its row
    mark = np.zeros(len(h) + 1, dtype=np.int32)
    np.add.at(mark, begins[long], 1)
    np.add.at(mark, ends[long] - size + 1, -1)
    short = np.flatnonzero((counts > 0) & ~long)
    whole = np.ones(len(values), dtype=bool)
    whole[first[short]] = False
    at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    values[whole] = tuple_hashes(h, size)[at] if len(at) else np.empty(0, dtype=np.uint64)
    for i in short.tolist():  # told apart from a longer run's hash by the number of words
        values[first[i]] = mix(tuple_hashes(h[begins[i] : ends[i]], int(counts[i])) + np.uint64(counts[i]))[0]
    new = np.ones(len(values), dtype=bool)
    for i, j in zip(first.tolist(), last.tolist()):
        if j > i + 1:
            values[i:j].sort()
    new[1:] = values[1:] != values[:-1]
    new[first[length > 0]] = True
    n = np.zeros(len(counts), dtype=np.int64)
    some = length > 0
    if some.any():
        n[some] = np.add.reduceat(new.astype(np.int64), first[some])
    return values[new], n
