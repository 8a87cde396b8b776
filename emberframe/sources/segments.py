"""Segments as a data source for SQL and streams: ``spark.read.format("segments")`` and ``spark.readStream``.

In a batch a segment file is a partition, and what a query asks of scene, band, segment and line decides which files are
opened: a file's name says which lines it holds, since a full disk has as many lines as its resolution allows. A file that is
opened is decompressed to the end of its header first, and no further if its lines are not wanted.

As a stream, scenes come once each, when all their required segments are there and readable to their end; late ones too. The
offset is the newest complete scene and which slots before it are still missing.

Files are listed and opened by Arrow's file systems (local paths, and URIs such as hdfs:// and s3://). For stores that only
Spark's own readers open there is ``hsd.segment_lines``.
"""

from __future__ import annotations

import bz2
import datetime as dt
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual
)

from emberframe.functions.names import SEGMENT
from emberframe.sources import hsd

SCHEMA = f"scene_id string, band string, segment int, {hsd.COUNTS}"
# Lines of a full disk by the resolution in a file's name.
DISK_LINES = {"05": 22000, "10": 11000, "20": 5500}
#: Bytes read at a time while the header is not complete.
STEP = 1 << 16
SLOT = "%Y%m%d%H%M"


@dataclass(frozen=True)
class SegmentFile(InputPartition):
    path: str
    scene_id: str
    band: str
    segment: int
    #: Lines of the disk by the name, None where the name does not say.
    lines: tuple[int, int] | None
    size: int = 0


def described(path: str, size: int = 0) -> SegmentFile | None:
    """What a file's name says; None where it is no segment's."""
    name = path.rsplit("/", 1)[-1]
    found = re.match(SEGMENT, name)
    if not found:
        return None
    segment, total = int(found[6]), int(found[7])
    disk, lines = DISK_LINES.get(found[5]), None
    if disk and total and disk % total == 0:
        height = disk // total
        lines = ((segment - 1) * height + 1, segment * height)
    return SegmentFile(path, found[2] + found[3], found[4], segment, lines, size)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def listed(folder: str) -> list[SegmentFile]:
    """The segment files below a folder, without partial downloads."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    files = [described(f.path, f.size) for f in found if f.type == fs.FileType.File and ".partial-" not in f.path]
    return sorted((f for f in files if f), key=lambda f: (f.scene_id, f.band, f.segment, f.path))


class Wanted:
    """What filters ask of scene, band, segment and line: all of some comparisons of a column with values."""

    #: Whether a value from ``first`` to ``last`` may meet a comparison.
    MAY = {
        EqualTo: lambda first, last, v: first <= v <= last, In: lambda first, last, v: any(first <= x <= last for x in v),
        GreaterThan: lambda first, last, v: last > v, GreaterThanOrEqual: lambda first, last, v: last >= v,
        LessThan: lambda first, last, v: first < v, LessThanOrEqual: lambda first, last, v: first <= v,
    }

    def __init__(self) -> None:
        self.asked: list[tuple[str, type, object]] = []

    def add(self, f: Filter) -> None:
        if type(f) in self.MAY and len(f.attribute) == 1 and f.attribute[0] in ("scene_id", "band", "segment", "line"):
            value = tuple(v for v in f.value if v is not None) if isinstance(f, In) else f.value
            if value is not None:
                self.asked.append((f.attribute[0], type(f), value))

    def meets(self, column: str, first, last) -> bool:
        return all(self.MAY[kind](first, last, v) for c, kind, v in self.asked if c == column)

    def lines(self, first: int, last: int) -> tuple[int, int]:
        """The part of the lines from ``first`` to ``last`` outside of which none is wanted."""
        for column, kind, v in self.asked:
            if column == "line":
                low = {EqualTo: v, GreaterThan: v, GreaterThanOrEqual: v}.get(kind)
                high = {EqualTo: v, LessThan: v, LessThanOrEqual: v}.get(kind)
                first, last = first if low is None else max(first, low), last if high is None else min(last, high)
        return first, last

    def takes(self, f: SegmentFile) -> bool:
        named = all(self.meets(c, v, v) for c, v in (("scene_id", f.scene_id), ("band", f.band), ("segment", f.segment)))
        return named and (f.lines is None or self.meets("line", *f.lines))


def read_lines(f: SegmentFile, folder: str, wanted: Wanted, left: int = 1, right: int | None = None) -> Iterator[pa.RecordBatch]:
    """A segment's wanted lines. Its header is read first; where no line of it is wanted, nothing more is."""
    system, _ = opened(folder)
    with system.open_input_stream(f.path, compression=None) as file:
        unpack, data, raw, head = bz2.BZ2Decompressor(), b"", b"", None
        while head is None:
            step = file.read(STEP)
            if not step:
                raise EOFError(f"{f.path} ends in its header")
            data += step
            raw += unpack.decompress(step)
            try:
                head, _ = hsd.read_header(raw)
            except (IndexError, struct.error):
                continue
        first, last = head["first_line"], head["first_line"] + head["lines"] - 1
        if f.lines is not None and not (f.lines[0] <= first and last <= f.lines[1]):
            raise ValueError(f"{f.path} holds the lines {first} to {last}, its name says {f.lines}")
        if not wanted.meets("line", first, last):
            return
        head, counts = hsd.read_segment(data + file.read())
    low, high = wanted.lines(first, last)
    right = min(right or head["columns"], head["columns"])
    for part in hsd.line_batches(head, counts, low, high, left, right):
        own = [pa.array([v] * len(part), t) for v, t in ((f.scene_id, pa.string()), (f.band, pa.string()), (f.segment, pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [*own, pa.array([f.path] * len(part), pa.string()), *part.columns],
            names=["scene_id", "band", "segment", "path", *part.schema.names]
        )


def _columns(options: dict) -> tuple[int, int | None]:
    left, _, right = str(options.get("columns", "")).partition("-")
    return int(left or 1), int(right) if right else None


class SegmentReader(DataSourceReader):
    """Options: path, and columns ("left-right", counted from 1) to be cut out of each line."""

    def __init__(self, options: dict) -> None:
        self.folder, self.cut, self.wanted = options["path"], _columns(options), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.wanted.add(f)
        return filters  # they choose files and lines; Spark decides on rows

    def partitions(self) -> Sequence[InputPartition]:
        return [f for f in listed(self.folder) if self.wanted.takes(f)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, SegmentFile):
            yield from read_lines(partition, self.folder, self.wanted, *self.cut)


class SceneStreamReader(DataSourceStreamReader):
    """Options: path, bands ("07,13"), segments ("1,2"), columns, and horizon: slots before the newest complete scene that are
    waited for (144, a day); minutes: the distance of slots (10).

    The offset is {"through": the newest complete scene, "missing": slots within the horizon before it that are not complete}.
    A batch has the complete scenes after the start's ``through`` up to the end's, without those missing at the end, and the
    start's missing ones that are missing no more. So each scene comes once, and a batch that is planned again is the same as
    long as its files are there. A scene that is not complete within the horizon never comes. Whether a segment is readable to its
    end is tried once for each file and size.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.cut = options["path"], _columns(options)
        self.bands = [b.strip() for b in options["bands"].split(",")]
        self.segments = [int(s) for s in options["segments"].split(",")]
        self.horizon, self.minutes = int(options.get("horizon", 144)), int(options.get("minutes", 10))
        self.tried: dict[tuple[str, int], bool] = {}

    def initialOffset(self) -> dict:
        return {"through": "", "missing": ""}

    def latestOffset(self) -> dict:
        scenes = self._scenes()
        # from the newest down: no scene before the newest complete one decides it
        through = next((s for s in sorted(scenes, reverse=True) if self._complete(scenes[s])), "")
        if not through:
            return self.initialOffset()
        newest = dt.datetime.strptime(through, SLOT)
        slots = {(newest - dt.timedelta(minutes=self.minutes * k)).strftime(SLOT) for k in range(1, self.horizon + 1)}
        slots |= {s for s in scenes if min(slots) <= s < through}
        return {"through": through, "missing": ",".join(sorted(s for s in slots if not self._complete(scenes.get(s, []))))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        was, now = set(start["missing"].split(",")), set(end["missing"].split(","))
        scenes = self._scenes()
        new = [s for s in scenes if start["through"] < s <= end["through"] and s not in now]
        new += [s for s in scenes if s <= start["through"] and s in was and s not in now and s >= min(now | was - {""}, default="")]
        return [f for s in sorted(set(new)) if self._complete(scenes[s]) for f in scenes[s]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, SegmentFile):
            yield from read_lines(partition, self.folder, Wanted(), *self.cut)

    def _scenes(self) -> dict[str, list[SegmentFile]]:
        """The files of required bands and segments by scene, one of each."""
        out: dict[str, dict[tuple, SegmentFile]] = {}
        for f in listed(self.folder):
            if f.band in self.bands and f.segment in self.segments:
                out.setdefault(f.scene_id, {}).setdefault((f.band, f.segment), f)
        return {s: list(files.values()) for s, files in out.items()}

    def _complete(self, files: list[SegmentFile]) -> bool:
        if len(files) < len(self.bands) * len(self.segments):
            return False
        untried = [f for f in files if (f.path, f.size) not in self.tried]
        with ThreadPoolExecutor(8) as pool:
            for f, good in zip(untried, pool.map(self._readable, untried)):
                self.tried[f.path, f.size] = good
        return all(self.tried[f.path, f.size] for f in files)

    def _readable(self, f: SegmentFile) -> bool:
        system, _ = opened(self.folder)
        try:
            with system.open_input_stream(f.path, compression=None) as file:
                hsd.read_segment(file.read())
            return True
        except (OSError, EOFError, ValueError, IndexError, struct.error):
            return False


class SegmentSource(DataSource):
    """Lines of segments; see ``SegmentReader`` and ``SceneStreamReader`` for the options."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SegmentReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SceneStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``segments`` a format of the session. A batch needs ``spark.sql.python.filterPushdown.enabled``, which is the
    caller's to set: Spark refuses sources that take filters without it."""
    spark.dataSource.register(SegmentSource)
