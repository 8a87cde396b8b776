"""Geostationary standard-data segments: bz2 files of eleven header blocks and 16-bit counts."""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.names import segment_name
from emberframe.operators.tables import kept

# Fixed values: (block index, offset in the block, format, field) of the header fields that are used.
FIELDS = [
    (1, 5, "<H", "columns"), (1, 7, "<H", "lines"),
    (2, 3, "<d", "sub_lon"), (2, 11, "<i", "cfac"), (2, 15, "<i", "lfac"), (2, 19, "<f", "coff"), (2, 23, "<f", "loff"),
    (2, 27, "<d", "height_km"), (2, 35, "<d", "equatorial_km"), (2, 43, "<d", "polar_km"),
    (4, 3, "<H", "band_number"), (4, 5, "<d", "wavelength_um"), (4, 15, "<H", "error_count"),
    (4, 17, "<H", "outside_count"), (4, 19, "<d", "slope"), (4, 27, "<d", "intercept"), (4, 35, "<d", "c0"),
    (4, 43, "<d", "c1"), (4, 51, "<d", "c2"),
    (6, 3, "<B", "total_segments"), (6, 4, "<B", "segment_number"), (6, 5, "<H", "first_line"),
]
KINDS = {"<H": "int", "<B": "int", "<i": "int", "<f": "double", "<d": "double"}
BLOCKS = 11
HEADER = ", ".join(f"{name} {KINDS[kind]}" for *_, kind, name in FIELDS)
COUNTS = f"path string, {HEADER}, line int, first_column int, counts array<int>"


def read_header(raw: bytes) -> tuple[dict, int]:
    """(header fields, where the counts begin) of a decompressed segment, or of its beginning; an IndexError or struct.error
    where the beginning is too short."""
    places, at = [], 0
    for _ in range(BLOCKS):
        _, length = struct.unpack_from("<BH", raw, at)
        places.append(at)
        at += length
    head = {name: struct.unpack_from(kind, raw, places[block] + offset)[0] for block, offset, kind, name in FIELDS}
    return head, at


def read_segment(data: bytes) -> tuple[dict, np.ndarray]:
    """(header fields, counts[line, column]) of a compressed segment. The albedo coefficient of visible bands is where
    infrared ones have c0."""
    raw = bz2.decompress(data)
    head, at = read_header(raw)
    n = head["lines"] * head["columns"]
    if len(raw) - at < 2 * n:
        raise ValueError(f"the segment holds {(len(raw) - at) // 2} counts, its header says {n}")
    return head, np.frombuffer(raw, dtype="<u2", count=n, offset=at).reshape(head["lines"], head["columns"])


def write_segment(head: dict, counts: np.ndarray) -> bytes:
    """A compressed segment with these fields; the inverse of ``read_segment``."""
    sizes = [max([3, *(o + struct.calcsize(k) for b, o, k, _ in FIELDS if b == block)]) for block in range(BLOCKS)]
    head = head | {"lines": counts.shape[0], "columns": counts.shape[1]}
    blocks = [bytearray(s) for s in sizes]
    for k, b in enumerate(blocks):
        struct.pack_into("<BH", b, 0, k + 1, sizes[k])
    for block, offset, kind, name in FIELDS:
        struct.pack_into(kind, blocks[block], offset, head[name])
    return bz2.compress(b"".join(blocks) + counts.astype("<u2").tobytes())


def segment_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified, satellite, scene_id, band, segment, total) of the segment files below a folder."""
    files = spark.read.format("binaryFile").option(
        "recursiveFileLookup", "true"
    ).option("pathGlobFilter", "*.DAT.bz2").load(folder)
    named = files.select(
        "path", "length", F.col("modificationTime").alias("modified"),
        segment_name(F.element_at(F.split("path", "/"), -1)).alias("n")
    )
    return named.filter("n is not null").select("path", "length", "modified", "n.*")


def readable_segments(files: DataFrame) -> DataFrame:
    """(path, readable) of files (path, content): whether a segment decompresses to its end and has the counts that its
    header says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1):
                try:
                    read_segment(content.as_buffer().to_pybytes())
                    out.append(True)
                except (OSError, EOFError, ValueError, struct.error):
                    out.append(False)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.bool_())], names=["path", "readable"])

    return files.select("path", "content").mapInArrow(run, "path string, readable boolean")


def latest_scenes(
    spark: SparkSession, folder: str, bands: list[str], segments: list[int], n: int = 1, oldest_first: bool = False
) -> DataFrame:
    """``catalog.latest_scenes`` of the segment files below a folder, without scenes that have an unreadable segment.

    Scenes are read ``n`` at a time, in the order wanted, until ``n`` are readable; the driver holds the names of ``n`` scenes.
    """
    from emberframe.operators import catalog

    files = segment_files(spark, folder)
    order = F.asc("scene_id") if oldest_first else F.desc("scene_id")
    whole = catalog.latest_scenes(files, bands, segments, None).select("scene_id", F.col("files.path").alias("paths"))
    whole = kept(whole, "scenes")  # listed once
    good: list[str] = []
    last = None
    while len(good) < n:
        rest = whole if last is None else whole.filter(
            F.col("scene_id") > last if oldest_first else F.col("scene_id") < last
        )
        some = rest.orderBy(order).limit(n).collect()
        if not some:
            break
        last = some[-1]["scene_id"]
        read = spark.read.format("binaryFile").load([path for r in some for path in r["paths"]])
        bad = {r["path"] for r in readable_segments(read).filter("not readable").collect()}
        good += [r["scene_id"] for r in some if not bad.intersection(r["paths"])]
    return catalog.latest_scenes(files.filter(F.col("scene_id").isin(good[:n])), bands, segments, n, oldest_first)


def line_batches(
    head: dict, counts: np.ndarray, low: int, high: int, left: int, right: int
) -> Iterator[pa.RecordBatch]:
    """A segment's lines from ``low`` to ``high`` and columns from ``left`` to ``right``: header fields, line, first_column and
    counts, 128 lines at a time."""
    for first in range(max(low, head["first_line"]), min(high, head["first_line"] + head["lines"] - 1) + 1, 128):
        lines = np.arange(first, min(first + 128, high + 1, head["first_line"] + head["lines"]))
        part = counts[lines - head["first_line"], left - 1 : right].astype(np.int32)
        ends = pa.array(np.arange(len(lines) + 1, dtype=np.int32) * part.shape[1])
        fields = [
            pa.array([head[name]] * len(lines), pa.int32() if KINDS[kind] == "int" else pa.float64())
            for *_, kind, name in FIELDS
        ]
        yield pa.record_batch(
            [
                *fields, pa.array(lines.astype(np.int32)), pa.array(np.full(len(lines), left, dtype=np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(part.ravel()))
            ],
            names=[*(f[3] for f in FIELDS), "line", "first_column", "counts"]
        )


def segment_lines(
    spark: SparkSession, folder: str, bands: list[str] | None = None, crop: dict[str, int] | None = None
) -> DataFrame:
    """One row per line of each segment: header fields, line number (from 1) and counts.

    Files of other bands are pruned by name before anything is read; with a crop only its lines and columns come out. A
    segment is decoded by one task and sent on in batches of lines.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", f"*_B{{{','.join(bands)}}}_*.DAT.bz2" if bands else "*.DAT.bz2"
    ).load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                head, counts = read_segment(content.as_buffer().to_pybytes())
                low, high, left, right = 1, head["first_line"] + head["lines"] - 1, 1, head["columns"]
                if crop:
                    low, high = crop["lineStart"], min(high, crop["lineEnd"])
                    left, right = crop["colStart"], min(crop["colEnd"], right)
                for part in line_batches(head, counts, low, high, left, right):
                    yield part.add_column(0, pa.field("path", pa.string()), pa.array([path] * len(part)))

    return files.select("path", "content").mapInArrow(run, COUNTS)


def segment_pixels(lines: DataFrame, kind: str) -> DataFrame:
    """(scene_id, band, line, column, value): calibrated pixels of segment lines; ``kind`` is ``bt`` or ``reflectance``."""
    from emberframe.functions import radiometry as R

    named = lines.withColumn("_n", segment_name(F.element_at(F.split("path", "/"), -1)))
    p = named.select(
        "_n.scene_id", "_n.band", "slope", "intercept", "wavelength_um", "c0", "c1", "c2", "error_count",
        "outside_count", "line", "first_column", F.posexplode("counts").alias("k", "count")
    )
    if kind == "bt":
        value = R.brightness_temperature(
            "count", "slope", "intercept", "wavelength_um", "c0", "c1", "c2", "error_count", "outside_count"
        )
    elif kind == "reflectance":
        value = R.reflectance("count", "slope", "intercept", "c0", "error_count", "outside_count")
    else:
        raise ValueError(f"unknown kind of value: {kind}")
    return p.select(
        "scene_id", "band", "line", (F.col("first_column") + F.col("k")).alias("column"), value.alias("value")
    )


def resample(source: DataFrame, targets: DataFrame, projection, crop: dict[str, int], shift: int = 0) -> DataFrame:
    """Values of the nearest source pixel (line, column, value) at target places (lon, lat): an equi join on rounded line
    and column. ``shift`` moves the column, for compatibility with readers that count from one further on."""
    from emberframe.functions.radiometry import to_column_line

    column, line, visible = to_column_line("lon", "lat", projection)
    t = targets.withColumns(
        {"column": (F.rint(column) + shift).cast("int"), "line": F.rint(line).cast("int"), "_v": visible}
    )
    inside = F.col("_v") & F.col("line").between(
        crop["lineStart"], crop["lineEnd"]
    ) & F.col("column").between(crop["colStart"], crop["colEnd"])
    t = t.withColumn("line", F.when(inside, F.col("line"))).drop("_v")
    return t.join(source.select("line", "column", "value"), ["line", "column"], "left").drop("line", "column")
