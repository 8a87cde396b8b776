"""Fire events: detections that chain together over time, kept up to date scene by scene.

An event is a component of fires within a distance and a time of each other. What a later fire can still join is bounded by that
time, so the state of a stream is the fires of the last while with their events, and what is known of those events by time.
A new scene links with the fires of the last while only: events that it connects become one, under the least id.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators.clusters import chain_edges
from emberframe.operators.graphs import connected_components
from emberframe.operators.tables import kept

#: What is known of an event at one time; sums, so that events can become one.
MARK = ("event_id", "seen", "n", "lon_sum", "lat_sum", "top")


@dataclass
class EventState:
    """``open``: fires (fire_id, lon, lat, acq_ts, event_id) that later ones can join; ``marks``: their events by time."""

    open: DataFrame
    marks: DataFrame


def _marks(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("event_id", F.col("acq_ts").alias("seen")).agg(
        F.count("*").alias("n"), F.sum("lon").alias("lon_sum"), F.sum("lat").alias("lat_sum"), F.max("score").alias("top")
    )


def _summed(marks: DataFrame) -> DataFrame:
    return marks.groupBy("event_id", "seen").agg(
        F.sum("n").alias("n"), F.sum("lon_sum").alias("lon_sum"), F.sum("lat_sum").alias("lat_sum"),
        F.max("top").alias("top")
    )


def event_rows(marks: DataFrame, digits: int | None = 6) -> DataFrame:
    """(event_id, first_seen, last_seen, persistence_count, fire_count, lon, lat, max_score) of marks. The persistence is the
    number of different times. Places are rounded to ``digits``, or not at all."""
    mean = lambda c: F.sum(f"{c}_sum") / F.sum("n")
    place = lambda c: (mean(c) if digits is None else F.round(mean(c), digits)).alias(c)
    return marks.groupBy("event_id").agg(
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count("*").alias("persistence_count"),
        F.sum("n").alias("fire_count"), place("lon"), place("lat"), F.max("top").alias("max_score")
    )


def _placed(fires: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return fires.select("fire_id", "lon", "lat", "acq_ts", F.col("score").cast("double").alias("score"), *by).dropna(
        subset=["fire_id", "lon", "lat", "acq_ts", *by]
    ).dropDuplicates(["fire_id"])


def fire_events(
    fires: DataFrame, km: float = 4.0, minutes: float = 60.0, by: tuple[str, ...] = (), digits: int | None = 6
) -> DataFrame:
    """``event_rows`` of fires (fire_id, lon, lat, acq_ts, score) that chain together within ``km`` and ``minutes``, and with
    equal values of the columns ``by``; an event is named by its least fire_id. Fires without an id, place, time or value of
    ``by`` belong to none; one that comes twice counts once."""
    f = _placed(fires, by)
    label = connected_components(
        f.select(F.col("fire_id").alias("id")), chain_edges(f.withColumnRenamed("fire_id", "id"), km, minutes, by)
    )
    named = f.join(label, F.col("fire_id") == F.col("id")).withColumnRenamed("component", "event_id")
    return event_rows(_marks(named), digits)


def start(fires: DataFrame) -> EventState:
    """The state before any fire; ids have the type that they have in ``fires``."""
    none = fires.limit(0)
    f = none.select(
        "fire_id", F.col("lon").cast("double"), F.col("lat").cast("double"), "acq_ts", F.col("fire_id").alias("event_id")
    )
    return EventState(f, _marks(f.withColumn("score", F.lit(None).cast("double"))))


def advance(
    state: EventState, fires: DataFrame, km: float = 4.0, minutes: float = 60.0, late_minutes: float = 0.0
) -> tuple[EventState, DataFrame]:
    """(next state, changes) after new fires (fire_id, lon, lat, acq_ts, score).

    Changes are ``event_rows`` of the events that the fires touched, and a row for every event that became part of another, with
    that one in ``merged_into`` and nulls else. Where fires come in the order of time, or at most ``late_minutes`` late,
    the events are those of ``fire_events`` over all of them; a fire that is later starts an event of its own. The work
    follows the new fires and what they can join. A fire that was there before is left out, so a scene that comes again
    changes nothing while its fires are in reach.
    """
    new = kept(_placed(fires).join(state.open.select("fire_id"), "fire_id", "left_anti"), "new-fires")
    newest = new.agg(F.max("acq_ts")).first()[0]
    gone = F.lit(None).cast(new.schema["fire_id"].dataType).alias("merged_into")
    if newest is None:
        return state, event_rows(state.marks.limit(0)).select("*", gone)
    points = state.open.select("fire_id", "lon", "lat", "acq_ts").unionByName(new.drop("score"))
    links = chain_edges(points.withColumnRenamed("fire_id", "id"), km, minutes).unionByName(
        state.open.select(F.col("fire_id").alias("a"), F.col("event_id").alias("b"))
    )
    nodes = points.select(F.col("fire_id").alias("id")).unionByName(state.open.select(F.col("event_id").alias("id")))
    label = kept(connected_components(nodes, links), "events")
    named = lambda d, c: d.join(label, F.col(c) == F.col("id")).drop("id")
    fresh = named(new, "fire_id").withColumnRenamed("component", "event_id")
    merged = named(state.open.select(F.col("event_id").alias("was")).distinct(), "was").filter("was <> component")
    moved = state.marks.join(merged, F.col("event_id") == F.col("was"), "left").withColumn(
        "event_id", F.coalesce("component", "event_id")
    ).select(*MARK)
    marks = kept(_summed(moved.unionByName(_marks(fresh).select(*MARK))), "marks")
    touched = fresh.select("event_id").unionByName(merged.select(F.col("component").alias("event_id"))).distinct()
    changes = event_rows(marks.join(touched, "event_id", "left_semi")).select("*", gone)
    changes = changes.unionByName(
        merged.select(F.col("was").alias("event_id"), F.col("component").alias("merged_into")), allowMissingColumns=True
    )
    reach = newest - dt.timedelta(minutes=minutes + late_minutes)
    all_open = named(points, "fire_id").withColumnRenamed("component", "event_id")
    before = state.open.agg(F.max("acq_ts")).first()[0]
    if before is not None and before > newest:
        reach = before - dt.timedelta(minutes=minutes + late_minutes)
    open_ = kept(all_open.filter(F.col("acq_ts") >= F.lit(reach)).select(*state.open.columns), "open-fires")
    live = marks.join(open_.select("event_id").distinct(), "event_id", "left_semi")
    return EventState(open_, kept(live, "live-marks")), kept(changes, "event-changes")


def current_events(changes: DataFrame, order: str = "batch") -> DataFrame:
    """The events as they are after all ``changes``, each with the number (``order``) of its batch: the last row of each event,
    without those that became part of another."""
    names = [c for c in changes.columns if c not in ("event_id", order)]
    last = changes.groupBy("event_id").agg(F.max_by(F.struct(*names), order).alias("last"))
    return last.select("event_id", "last.*").filter("merged_into is null").drop("merged_into")
