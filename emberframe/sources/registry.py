"""Sources by kind, read side by side, each falling back to the last good entry of its catalog."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators.tables import kept
from emberframe.sources import grib, hsd, readers

#: Readers (spark, path) by kind of source.
READERS: dict[str, Callable[..., DataFrame]] = {
    "segments": hsd.segment_files, "grib": grib.grid_values, "points": readers.points, "polygons": readers.polygons,
    "candidates": readers.candidates, "active-fires": readers.active_fires,
    "solar-plants": readers.solar_plants, "object-listing": readers.object_listing, "forecast": readers.forecast_points,
    "csv": readers.csv, "files": readers.published_files,
}
ENTRY = "source_id string, kind string, status string, message string, path string, rows long"


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unsupported kind of source: {kind}")
    return READERS[kind](spark, path, **options)


def sync(
    spark: SparkSession, sources: list[dict], previous: DataFrame | None = None, at_once: int = 4, tries: int = 2,
    timeout: float = 900.0
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by source id, catalog entries) of the sources (id, kind, path, options, enabled) of a configuration.

    Sources are read ``at_once`` at a time, in the scheduler's pool ``sources``, and tried ``tries`` times; one that fails or
    takes more than ``timeout`` seconds from its begin does not stop the others: its entry says why, and names the files of
    the catalog before (``previous``) if it had any. The jobs of a source that is given up are cancelled, with all that it would
    still start.
    """
    wanted = [s for s in sources if s.get("enabled", True)]
    if not wanted:
        return {}, spark.createDataFrame([], ENTRY)
    sc, run = spark.sparkContext, uuid.uuid4().hex
    begun: dict[int, float] = {}
    given_up: set[int] = set()

    def fetch(k: int, s: dict) -> tuple[DataFrame, int]:
        begun[k] = time.monotonic()
        sc.setLocalProperty("spark.scheduler.pool", "sources")
        sc.setJobGroup(f"source-{run}-{k}", f"source {s['id']}", interruptOnCancel=True)
        for attempt in range(max(1, tries)):
            try:
                table = kept(read(spark, s["kind"], s["path"], **s.get("options", {})), f"source-{s['id']}")
                return table, table.count()
            except Exception:  # noqa: BLE001  any failure of a source is its own
                if attempt + 1 >= tries or k in given_up:
                    raise
        raise AssertionError

    tables, entries = {}, {}
    pool = ThreadPoolExecutor(max(1, at_once))
    open_ = {pool.submit(inheritable_thread_target(spark)(fetch), k, s): k for k, s in enumerate(wanted)}
    try:
        while open_:
            late = [begun[k] + timeout for k in open_.values() if k in begun]
            # those that wait for a place have no clock yet
            left = max(0.0, min(late, default=time.monotonic() + 1) - time.monotonic())
            done, _ = wait(open_, timeout=min(left, 1.0), return_when=FIRST_COMPLETED)
            for job in done:
                k = open_.pop(job)
                s = wanted[k]
                try:
                    tables[s["id"]], rows = job.result()
                    entries[k] = (s["id"], s["kind"], "ok", "sync completed", s["path"], rows)
                except Exception as error:  # noqa: BLE001
                    entries[k] = (s["id"], s["kind"], "error", str(error).split("\n")[0], None, None)
            for job, k in list(open_.items()):
                if k in begun and time.monotonic() - begun[k] > timeout:
                    del open_[job]
                    given_up.add(k)
                    sc.cancelJobGroup(f"source-{run}-{k}")
                    sc._jsc.sc().cancelJobGroupAndFutureJobs(f"source-{run}-{k}")
                    s = wanted[k]
                    entries[k] = (s["id"], s["kind"], "error", f"timed out after {timeout} s", None, None)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    entries = [entries[k] for k in sorted(entries)]
    current = spark.createDataFrame(entries, ENTRY)
    if previous is None:
        return tables, current
    before = previous.select(
        F.col("source_id").alias("_of"), F.col("path").alias("_path"), F.col("rows").alias("_rows")
    )
    joined = current.join(before, F.col("source_id") == F.col("_of"), "left")
    recovered = (F.col("status") != "ok") & F.col("_path").isNotNull()
    message = F.when(recovered, F.concat("message", F.lit(" (the last good files stay)"))).otherwise(F.col("message"))
    last = [F.when(recovered, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("path", "rows")]
    return tables, joined.select("source_id", "kind", "status", message.alias("message"), *last)


class SingleFlight:
    """Runs of a job by name, one at a time: who asks while a run of that name is under way waits for it and gets its result,
    or its error; who asks later starts another."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._runs: dict[str, Future] = {}

    def run(self, name: str, job: Callable[[], Any]) -> Any:
        with self._lock:
            under_way = self._runs.get(name)
            own = under_way is None
            if own:
                under_way = self._runs[name] = Future()
        if not own:
            return under_way.result()
        try:
            result = job()
        except BaseException as error:
            self._end(name).set_exception(error)
            raise
        self._end(name).set_result(result)
        return result

    def _end(self, name: str) -> Future:
        with self._lock:
            return self._runs.pop(name)
