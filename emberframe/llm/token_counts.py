"""Token counts: offset-mapped attribution of a document's tokens to its sections.

Each whole document is encoded once with a byte-level BPE. The tokens' bytes tile the text, so a running sum of token
lengths gives every token's span; a sorted interval join (binary search in the section starts) gives each token to one
section. A token that crosses a boundary goes, whole, where the rule's reference byte lies:

``first``   the token's first byte,
``middle``  its middle byte (the left one of two),
``last``    its last byte.

The counts of a document's sections therefore always add up to the document's count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberframe.llm.shared import small_batches
from emberframe.llm.words import slices, text_bytes

RULES = ("first", "middle", "last")
SCHEMA = "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"
_encoders: dict[str, tuple] = {}


def _encoder(vocabulary: str, pattern: str):
    """(encoder, length in bytes of each token), kept by this worker."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[vocabulary] = (
            tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
        )
    return _encoders[vocabulary]


def _attribute(ids: pa.Array, column: pa.Array, encoder, rule: str) -> pa.RecordBatch:
    encoding, lengths = encoder
    raw, offsets = text_bytes(column)
    encoded = [
        np.asarray(encoding.encode_to_numpy(t or "", disallowed_special=()), dtype=np.int64) for t in column.to_pylist()
    ]
    doc_tokens = np.array([len(e) for e in encoded], dtype=np.int64)
    size = lengths[np.concatenate([*encoded, np.empty(0, dtype=np.int64)])]
    token_end = np.cumsum(size)
    token_start = token_end - size
    # sections: a row's lines, each with its line end; an empty row has one empty section
    line = np.flatnonzero(raw == 0x0A) + 1
    line = line[~np.isin(line, offsets)]
    starts = np.sort(np.concatenate([offsets[:-1], line]), kind="stable")
    row = np.concatenate([np.arange(len(column)), np.searchsorted(offsets, line, side="right") - 1])
    row = row[np.argsort(np.concatenate([offsets[:-1], line]), kind="stable")]
    ends = np.append(starts[1:], len(raw))
    at = {"first": token_start, "last": token_end - 1, "middle": (token_start + token_end - 1) // 2}[rule]
    section = np.searchsorted(starts, at, side="right") - 1
    n = np.bincount(section, minlength=len(starts))
    crosses = (token_start < starts[section]) | (token_end > ends[section])
    crossing = np.bincount(section[crosses], minlength=len(starts))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first_char = chars[offsets[row]]
    number = np.arange(len(starts)) - np.searchsorted(row, row)
    return pa.record_batch([
        ids.take(pa.array(row)), pa.array(number), pa.array(chars[starts] - first_char),
        pa.array(chars[ends] - first_char),
        pa.array(n), pa.array(crossing), pa.array(doc_tokens[row]),
    ], names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])


def attribute_tokens(
    docs: DataFrame, vocabulary: str, pattern: str, rule: str = "first", text: str = "text", doc_id: str = "doc_id",
    chunk_bytes: int = 1 << 20
) -> DataFrame:
    """One row per section (line) of each document: its characters [start_char, end_char), the tokens allocated to it,
    those of them that reach into another section, and the whole document's tokens.

    A null or empty text has one empty section with no tokens. A null id is kept as null. Repeated rows give repeated
    results. Other columns of ``docs`` are not read and not returned. Narrow: no shuffle, memory bounded by
    ``chunk_bytes`` and the longest text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, chunk_bytes):
                yield _attribute(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), encoder, rule)

    return small_batches(docs).select(
        docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")
    ).mapInArrow(run, SCHEMA)
