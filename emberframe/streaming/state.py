"""State that a stream keeps by key: the grid's slots per cell, and official detections for fires.

Both run on Structured Streaming's own state stores, so a batch costs what it touches. ``GridState`` needs the store that holds
state on disk: set ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKS`` before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from emberframe.functions.geo import haversine_km
from emberframe.operators import spatial, temporal

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Slots are numbered from 2000 on, one every ten minutes.
EPOCH, SLOT_SECONDS = 946684800, 600
VALUES = "max_bt07_k double, max_t713_k double, n_cand long, max_area double"
PAST = tuple(k for k in temporal.LAGS if k < 0)
#: Names of the values of other slots, as ``temporal.lag_features`` has them.
NAMES = {"max_bt07_k": "temp_bt07", "max_t713_k": "temp_t713", "n_cand": "temp_n", "max_area": "temp_area"}


class GridState(StatefulProcessor):
    """The slots of a cell. A timer per slot frees it when the watermark is ``keep`` slots further on."""

    def __init__(self, key: str, lags: tuple[int, ...], keep: int, replace: bool) -> None:
        self.key, self.lags, self.keep, self.replace = key, lags, keep, replace

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot_ord int", VALUES)

    def _end(self, slot: int) -> int:
        """When a slot is no longer kept, in milliseconds."""
        return (EPOCH + (slot + self.keep) * SLOT_SECONDS) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new[new["slot_ord"].map(self._end) > timerValues.getCurrentWatermarkInMs()]
        if new.empty:
            return
        per = new.groupby("slot_ord").agg(
            max_bt07_k=("max_bt07_k", "max"), max_t713_k=("max_t713_k", "max"), n_cand=("max_bt07_k", "size"),
            max_area=("cand_area", "max")
        )
        for slot, v in per.iterrows():
            value = [v["max_bt07_k"], v["max_t713_k"], int(v["n_cand"]), v["max_area"]]
            value = [None if pd.isna(x) else x for x in value]
            if self.slots.exists() and self.slots.containsKey((int(slot),)):
                if not self.replace:
                    old = self.slots.getValue((int(slot),))
                    most = lambda a, b: max((x for x in (a, b) if x is not None), default=None)
                    value = [most(old[0], value[0]), most(old[1], value[1]), old[2] + value[2], most(old[3], value[3])]
            else:
                self.handle.registerTimer(self._end(int(slot)))
            self.slots.updateValue((int(slot),), tuple(value))
        known: dict[int, tuple | None] = {}
        for slot in {int(s) + k for s in per.index for k in (0, *self.lags)}:
            known[slot] = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else None
        out = new[[self.key, "slot_ord"]].copy()
        out["glon"], out["glat"] = key
        for k, v in enumerate(NAMES):
            own = [known[int(s)][k] for s in new["slot_ord"]]
            out[v] = own
            for lag in self.lags:
                past = [known[int(s) + lag] for s in new["slot_ord"]]
                out[f"{NAMES[v]}_m{-lag}"] = [float((p and p[k]) or 0) for p in past]
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = expiredTimerInfo.getExpiryTimeInMs() // 1000 - EPOCH
        slot = last // SLOT_SECONDS - self.keep
        if self.slots.exists() and self.slots.containsKey((slot,)):
            self.slots.removeKey((slot,))
        return iter([])

    def close(self) -> None:
        pass


def grid_features(
    candidates: DataFrame, key: str = "fire_id", lags: tuple[int, ...] = PAST, degrees: float = 0.05, keep: int = 400,
    late_minutes: int = 60, replace: bool = True
) -> DataFrame:
    """A stream of candidates (``key``, center_lon, center_lat, slot_ord, max_bt07_k, max_t713_k, cand_area) with their cell
    (glon, glat), what it holds for their slot (as ``temporal.grid_state``) and for slots before (as
    ``temporal.lag_features``; 0 where it holds nothing).

    State is kept by cell, so a batch reads and writes the cells that it has candidates in, whatever the grid holds. A slot
    that comes again replaces what its cells held, or is added with ``replace=False``; a cell without a candidate in the
    repeated slot keeps its old one. The watermark is ``late_minutes`` behind the newest slot: what comes later than it is
    dropped, and a slot is freed when it is ``keep`` slots past it. Slots that come late are in no feature sent before.
    Candidates without a place or a slot are left out.
    """
    if not lags or max(lags) >= 0:
        raise ValueError("lags of a stream must look back")
    kind = candidates.schema[key].dataType.simpleString()
    at = F.timestamp_seconds(F.col("slot_ord").cast("long") * SLOT_SECONDS + EPOCH)
    c = temporal.gridded(candidates, degrees).select(
        key, "glon", "glat", F.col("slot_ord").cast("int").alias("slot_ord"),
        *[F.col(v).cast("double").alias(v) for v in ("max_bt07_k", "max_t713_k", "cand_area")], at.alias("slot_ts")
    ).dropna(subset=["glon", "glat", "slot_ord"]).withWatermark("slot_ts", f"{late_minutes} minutes")
    cell = c.schema["glon"].dataType.simpleString()
    schema = f"{key} {kind}, slot_ord int, glon {cell}, glat {cell}, " + ", ".join(
        ", ".join([f"{v} {'long' if v == 'n_cand' else 'double'}", *(f"{NAMES[v]}_m{-k} double" for k in lags)])
        for v in NAMES
    )
    return c.groupBy("glon", "glat").transformWithStateInPandas(
        GridState(key, lags, keep, replace), schema, "Append", "EventTime"
    )


def fuse_stream(
    fires: DataFrame, references: DataFrame, km: float = 4.0, hours: float = 3.0, late_minutes: int = 60
) -> DataFrame:
    """Fires (fire_id, lon, lat, acq_ts) each with its nearest official detection (id, sensor, lon, lat, acq_ts, confidence,
    frp), both as streams: the columns of ``spatial.nearest_reference``.

    A fire meets the detections of all cells that the distance reaches, within ``hours``, as a left outer join; of those that
    it meets the nearest stays, by distance, time and id. A fire is sent once, when the watermarks say that nothing nearer can
    come, also if it met none; that is ``hours`` and ``late_minutes`` after it. The interval bounds the state of both sides.
    """
    r = references.select("id", "sensor", "lon", "lat", "acq_ts", "confidence", "frp").toDF(
        "r_id", "r_sensor", "r_lon", "r_lat", "r_ts", "r_confidence", "r_frp"
    ).withWatermark("r_ts", f"{late_minutes} minutes")
    r = spatial.in_cells(r, km).withColumnsRenamed({"_band": "_r_band", "_cell": "_r_cell"})
    f = spatial.around_cells(
        fires.select("fire_id", "lon", "lat", "acq_ts").withWatermark("acq_ts", f"{late_minutes} minutes"), km,
        keep_unplaced=True
    )
    width = f"interval {int(hours * 3600)} seconds"
    near = (
        (F.col("_band") == F.col("_r_band")) & (F.col("_cell") == F.col("_r_cell"))
        & F.expr(f"r_ts >= acq_ts - {width} AND r_ts <= acq_ts + {width}")
        & (haversine_km("lon", "lat", "r_lon", "r_lat") <= km)
    )
    met = f.join(r, near, "leftOuter")
    apart = F.abs(F.unix_micros("r_ts") - F.unix_micros("acq_ts")) / 3.6e9
    o = F.struct(
        haversine_km("lon", "lat", "r_lon", "r_lat").alias("distance_km"), apart.alias("dt"), "r_id", "r_sensor",
        "r_confidence", "r_frp"
    )
    best = met.groupBy("fire_id", "lon", "lat", "acq_ts").agg(F.min(F.when(F.col("r_id").isNotNull(), o)).alias("o"))
    return spatial.fused(best, ["fire_id", "lon", "lat", "acq_ts"])
