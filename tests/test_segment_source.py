"""Segments as a data source: which files a query opens, and scenes as a stream."""

import bz2
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.sources import hsd, segments

ROWS = 550  # lines of a segment, a tenth of a disk of 2 km


def name(scene, band, segment):
    return f"HS_H09_{scene[:8]}_{scene[8:]}_B{band}_FLDK_R20_S{segment:02d}10.DAT.bz2"


def segment(number, band="07", columns=6):
    head = {field: 1 for *_, field in hsd.FIELDS} | {
        "segment_number": number, "total_segments": 10, "first_line": (number - 1) * ROWS + 1, "band_number": int(band)
    }
    lines = np.arange(ROWS)[:, None] + head["first_line"]
    return hsd.write_segment(head, (lines + np.arange(columns) * 7) % 4096)


@pytest.fixture
def pushed(spark):
    segments.register(spark)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    yield spark
    spark.conf.set(key, before)


def test_filters_choose_the_files_that_are_opened(pushed, tmp_path):
    """All files that a query must not open are no segments at all, so it fails if it opens one."""
    scene = "202601010000"
    for band in ("07", "13"):
        for s in range(1, 11):
            good = (band, s) in (("07", 4), ("07", 5))
            (tmp_path / name(scene, band, s)).write_bytes(segment(s, band) if good else b"not opened")
    (tmp_path / name("202601010010", "07", 4)).write_bytes(b"not opened")
    (tmp_path / (name(scene, "07", 4) + ".partial-1")).write_bytes(b"")
    (tmp_path / "readme.txt").write_bytes(b"")
    read = pushed.read.format("segments").load(str(tmp_path))
    some = read.filter((F.col("scene_id") == scene) & (F.col("band") == "07") & F.col("line").between(2190, 2210))
    got = some.select("segment", "line", "counts", "first_column", "band_number").collect()
    assert some.rdd.getNumPartitions() == 2
    assert sorted(q["line"] for q in got) == list(range(2190, 2211)) and {q["segment"] for q in got} == {4, 5}
    assert all(q["counts"] == [(q["line"] + 7 * k) % 4096 for k in range(6)] for q in got)
    read.createOrReplaceTempView("lines")
    sql = f"SELECT count(*) AS n, min(line) AS a, max(line) AS b FROM lines WHERE scene_id = '{scene}' AND band IN ('07') AND segment = 5"
    assert tuple(pushed.sql(sql).first()) == (ROWS, 2201, 2750)
    exact = read.filter(f"scene_id = '{scene}' and band = '07' and line = 2200")
    assert exact.rdd.getNumPartitions() == 1 and exact.first()["segment"] == 4
    assert read.filter("scene_id > '202601010010'").count() == 0
    cut = pushed.read.format("segments").option("columns", "2-4").load(str(tmp_path)).filter(
        f"scene_id = '{scene}' and band = '07' and line > 2749 and line < 2751"
    ).first()
    assert cut["first_column"] == 2 and cut["counts"] == [(2750 + 7 * k) % 4096 for k in (1, 2, 3)]
    with pytest.raises(Exception):  # the rest are no segments
        read.filter("band = '13'").count()


def test_same_lines_as_whole_segments(pushed, tmp_path):
    for s in (1, 2, 10):
        (tmp_path / name("202601010000", "07", s)).write_bytes(segment(s))
    crop = {"lineStart": 300, "lineEnd": 600, "colStart": 2, "colEnd": 5}
    names = ["line", "first_column", "counts", *(f[3] for f in hsd.FIELDS)]
    want = hsd.segment_lines(pushed, str(tmp_path), ["07"], crop).select(*names)
    got = pushed.read.format("segments").option("columns", "2-5").load(str(tmp_path)).filter(
        "line between 300 and 600"
    ).select(*names)
    key = lambda d: sorted(map(str, d.collect()))
    assert len(key(got)) == 301 and key(got) == key(want)


def test_a_header_decides_where_names_do_not(pushed, tmp_path):
    """Only the header of a segment that is not wanted is decompressed: what follows is damaged."""
    raw = bz2.decompress(segment(1, columns=2000))
    packed = bz2.compress(raw)
    other = name("202601010000", "07", 1).replace("_R20_", "_R40_")
    (tmp_path / other).write_bytes(packed[:-100])
    read = pushed.read.format("segments").load(str(tmp_path))
    assert read.filter("line > 5000").count() == 0
    with pytest.raises(Exception, match="end-of-stream"):
        read.filter("line > 500").count()
    (tmp_path / other).unlink()
    (tmp_path / name("202601010000", "07", 2)).write_bytes(segment(3))
    with pytest.raises(Exception, match="its name says"):
        pushed.read.format("segments").load(str(tmp_path)).count()


def test_scenes_come_once_when_they_are_complete(pushed, tmp_path):
    there, seen = tmp_path / "in", []
    there.mkdir()
    options = {"path": str(there), "bands": "07,13", "segments": "1,2", "horizon": "6"}

    def put(scene, *parts, harm=False):
        for band, s in parts:
            data = segment(s, band)
            (there / name(scene, band, s)).write_bytes(data[:-30] if harm else data)

    def run():
        before = len(seen)
        stream = pushed.readStream.format("segments").options(**options).load()
        stream.groupBy("scene_id", "band").agg(F.count("*").alias("n")).writeStream.outputMode("update").foreachBatch(
            lambda b, _: seen.extend((r["scene_id"], r["band"], r["n"]) for r in b.collect())
        ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert all(n == 2 * ROWS for *_, n in seen[before:])
        return sorted({s for s, *_ in seen[before:]})

    every = [(b, s) for b in ("07", "13") for s in (1, 2)]
    assert run() == []
    put("202601010000", *every)
    put("202601010010", *every[:3])  # incomplete
    put("202601010020", *every[:3])
    put("202601010020", every[3], harm=True)  # unreadable
    put("202601010020", ("07", 3), ("03", 1))  # not required
    assert run() == ["202601010000"]
    put("202601010030", *every)
    assert run() == ["202601010030"] and run() == []
    put("202601010010", every[3])  # late
    put("202601010040", *every)
    assert run() == ["202601010010", "202601010040"]
    put("202601010020", every[3])  # mended
    assert run() == ["202601010020"] and run() == []
    put("202601010120", *every)  # the horizon ends at 00:20
    assert run() == ["202601010120"]
    put("202601010015", *every)
    assert run() == []
    put("202601010025", *every)  # between slots, and never seen before
    put("202601010050", *every)
    got = run()
    assert "202601010050" in got and run() == []
    assert len({(s, b) for s, b, _ in seen}) == len(seen)


def test_offsets_say_what_a_batch_has(tmp_path):
    """A batch that is planned again has the same files, though more are there by now."""
    reader = segments.SceneStreamReader({"path": str(tmp_path), "bands": "07", "segments": "1", "horizon": "3"})
    assert reader.latestOffset() == reader.initialOffset() and list(reader.partitions(reader.initialOffset(), reader.latestOffset())) == []
    for scene in ("202601010000", "202601010020"):
        (tmp_path / name(scene, "07", 1)).write_bytes(segment(1))
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"through": "202601010020", "missing": "202512312350,202601010010"}
    first = [f.scene_id for f in reader.partitions(start, end)]
    (tmp_path / name("202601010010", "07", 1)).write_bytes(segment(1))
    (tmp_path / name("202601010030", "07", 1)).write_bytes(segment(1))
    again = segments.SceneStreamReader({"path": str(tmp_path), "bands": "07", "segments": "1", "horizon": "3"})
    assert [f.scene_id for f in again.partitions(start, end)] == first == ["202601010000", "202601010020"]
    assert [f.scene_id for f in again.partitions(end, again.latestOffset())] == ["202601010010", "202601010030"]
    assert os.path.basename(first and reader.partitions(start, end)[0].path) == name("202601010000", "07", 1)
