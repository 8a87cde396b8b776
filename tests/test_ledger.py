"""Batches that are killed and come again; sources whose jobs are given up."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from emberframe.functions.radiometry import Thresholds
from emberframe.sources import registry
from emberframe.streaming import ledger


def scenes(spark, folder, *parts):
    folder.mkdir(exist_ok=True)
    for k, rows in enumerate(parts):
        made = folder.parent / f"{folder.name}-{time.monotonic_ns()}"
        spark.createDataFrame(rows, "scene_id string, n int").coalesce(1).write.parquet(str(made))
        (file,) = made.glob("*.parquet")
        at = 1e9 + len(list(folder.iterdir()))
        os.utime(file.rename(folder / f"{int(at)}.parquet"), (at, at))
    return spark.readStream.schema("scene_id string, n int").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_killed_batches_are_neither_skipped_nor_done_twice(spark, tmp_path, monkeypatch):
    calls, target = [], str(tmp_path / "out")

    def process(batch):
        calls.append(sorted(r["scene_id"] for r in batch.select("scene_id").distinct().collect()))
        return batch.filter("n > 0").withColumn("run", F.lit(len(calls)))

    stream = scenes(spark, tmp_path / "in", [("a", 1), ("a", 2), ("b", 3)], [("b", 4), ("c", 5)], [("c", -1), ("d", 7)])
    real = ledger.commit

    def dies_before(sp, t, number, *rest):
        if number == 1:
            raise RuntimeError("killed before")
        real(sp, t, number, *rest)

    monkeypatch.setattr(ledger, "commit", dies_before)
    with pytest.raises(Exception, match="killed before"):
        ledger.run_scenes(stream, process, target, str(tmp_path / "c"), {"x": 1}).awaitTermination()
    seen = lambda: sorted((r["scene_id"], r["n"], r["run"]) for r in ledger.current(spark, target).collect())
    assert seen() == [("a", 1, 1), ("a", 2, 1), ("b", 3, 1)]  # the killed attempt is not read
    assert ledger.attempts_without_entry(spark, target).count() == 1

    def dies_after(sp, t, number, *rest):
        real(sp, t, number, *rest)
        if number == 1:
            raise RuntimeError("killed after")

    monkeypatch.setattr(ledger, "commit", dies_after)
    with pytest.raises(Exception, match="killed after"):
        ledger.run_scenes(stream, process, target, str(tmp_path / "c"), {"x": 1}).awaitTermination()
    monkeypatch.setattr(ledger, "commit", real)
    ledger.run_scenes(stream, process, target, str(tmp_path / "c"), {"x": 1}).awaitTermination()
    assert calls == [["a", "b"], ["b", "c"], ["b", "c"], ["c", "d"]]  # the one in the ledger was not done again
    assert seen() == [("a", 1, 1), ("a", 2, 1), ("b", 4, 3), ("d", 7, 4)]  # c was left empty by its last batch
    assert {(r["batch"], tuple(r["scenes"])) for r in ledger.entries(spark, target).collect()} == {(0, ("a", "b")), (1, ("b", "c")), (2, ("c", "d"))}
    # other settings are another job
    assert ledger.digest({"a": 1, "b": 2}) == ledger.digest({"b": 2, "a": 1}) != ledger.digest({"a": 1, "b": 3})
    assert ledger.digest(Thresholds()) != ledger.digest(Thresholds(min_std_t713_k=9.0))
    ledger.run_scenes(stream, process, target, str(tmp_path / "c2"), {"x": 2}).awaitTermination()
    assert len(calls) == 7 and ledger.entries(spark, target).count() == 6
    ledger.run_scenes(stream, process, target, str(tmp_path / "c3"), {"x": 2}).awaitTermination()
    assert len(calls) == 7  # a lost checkpoint too
    assert ledger.entries(spark, str(tmp_path / "none")).count() == 0


def sleeping(spark, path, seconds=60.0, n=1):
    def run(batches):
        time.sleep(seconds)
        yield from batches

    return spark.range(0, n, 1, 1).mapInArrow(run, "id long")


def test_sources_that_are_given_up_leave_no_job(spark, monkeypatch):
    monkeypatch.setitem(registry.READERS, "sleeping", sleeping)
    monkeypatch.setitem(registry.READERS, "broken", lambda spark, path: spark.range(3).select(F.raise_error(F.lit("broken"))))
    sources = [
        {"id": "slow", "kind": "sleeping", "path": "", "options": {"seconds": 90.0}},
        {"id": "fine", "kind": "sleeping", "path": "", "options": {"seconds": 0.1, "n": 7}},
        {"id": "bad", "kind": "broken", "path": ""}
    ]
    registry.sync(spark, sources[1:2])  # workers start
    began = time.monotonic()
    tables, entries = registry.sync(spark, sources, at_once=3, tries=1, timeout=15.0)
    assert time.monotonic() - began < 60
    got = {r["source_id"]: r for r in entries.collect()}
    assert got["slow"]["status"] == "error" and "timed out after 15.0 s" in got["slow"]["message"]
    assert got["fine"]["rows"] == 7, got
    assert set(tables) == {"fine"} and got["bad"]["status"] == "error"
    for _ in range(50):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert spark.range(5).count() == 5 and not spark.sparkContext.getLocalProperty("spark.jobGroup.id")


def test_the_clock_of_a_source_starts_with_it(spark, monkeypatch):
    monkeypatch.setitem(registry.READERS, "sleeping", sleeping)
    sources = [{"id": str(k), "kind": "sleeping", "path": "", "options": {"seconds": 3.0}} for k in range(3)]
    _, entries = registry.sync(spark, sources, at_once=1, timeout=8.0)
    assert [r["status"] for r in entries.collect()] == ["ok"] * 3


def test_one_run_at_a_time():
    import threading

    flight, started, go, calls, got = registry.SingleFlight(), threading.Event(), threading.Event(), [], []

    def job():
        calls.append(1)
        started.set()
        go.wait(10)
        return len(calls)

    def fails():
        calls.append(1)
        started.set()
        go.wait(10)
        raise ValueError("no")

    def ask(work):
        try:
            got.append(flight.run("sync", work))
        except ValueError as error:
            got.append(str(error))

    for work, want in ((job, 1), (fails, "no")):
        calls.clear(), got.clear(), started.clear(), go.clear()
        first = threading.Thread(target=ask, args=(work,))
        first.start()
        started.wait(10)
        others = [threading.Thread(target=ask, args=(work,)) for _ in range(3)]
        for t in others:
            t.start()
        assert flight.run("other", lambda: 5) == 5
        time.sleep(0.2)
        go.set()
        for t in (first, *others):
            t.join(10)
        assert got == [want] * 4 and len(calls) == 1
    assert flight.run("sync", lambda: 7) == 7
