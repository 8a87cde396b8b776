"""Validation against official detections: one-to-one matches, metrics, tagged results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.graphs import connected_components
from emberframe.operators.spatial import nearest_distance, time_distance_join
from emberframe.operators.tables import kept


def possible_matches(candidates: DataFrame, references: DataFrame, km: float = 5.0, hours: float = 3.0) -> DataFrame:
    """(id, r_id, distance_km, dt_hours) within both bounds."""
    r = references.select(
        F.col("id").alias("r_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"),
        F.col("acq_ts").alias("r_ts")
    )
    near = time_distance_join(candidates.select("id", "lon", "lat", "acq_ts"), r, km, hours)
    near = near.withColumn("dt_hours", F.abs(F.unix_micros("acq_ts") - F.unix_micros("r_ts")) / 3.6e9)
    return near.select("id", "r_id", "distance_km", "dt_hours")


def match(
    candidates: DataFrame, references: DataFrame, km: float = 5.0, hours: float = 3.0, rounds: int = 6
) -> DataFrame:
    """One-to-one matches, the same as a greedy pass over all possible pairs by distance, time, candidate and reference.

    Rounds take the pairs that both their sides prefer, which is what the greedy pass takes; most pairs are decided in a
    few. What ``rounds`` leave open are chains, each of which is a component of the pairs' graph: a component is gone
    through by one task, in order, so a chain of any length takes no more rounds.
    """
    pair = F.struct("distance_km", "dt_hours", "id", "r_id").alias("pair")
    left = kept(possible_matches(candidates, references, km, hours).select("id", "r_id", pair), "pairs")
    taken = left.select("pair.*").limit(0)
    for _ in range(rounds):
        if not left.limit(1).count():
            break
        best_c = left.groupBy("id").agg(F.min("pair").alias("pair"))
        best_r = left.groupBy("r_id").agg(F.min("pair").alias("pair"))
        won = kept(best_c.join(best_r, "pair").select("pair.*"), "matches")
        taken = taken.unionByName(won)
        left = left.join(won.select("id"), "id", "left_anti").join(
            won.select("r_id"), "r_id", "left_anti"
        ).select("id", "r_id", "pair")
        left = kept(left, "pairs")
    else:
        taken = taken.unionByName(_match_chains(left))
    return taken.select(
        "id", "r_id", F.round("distance_km", 3).alias("distance_km"), F.round("dt_hours", 3).alias("dt_hours")
    )


def _match_chains(pairs: DataFrame) -> DataFrame:
    """The greedy pass over each component of the open pairs."""
    sides = pairs.select(F.xxhash64(F.lit("c"), "id").alias("a"), F.xxhash64(F.lit("r"), "r_id").alias("b"), "pair")
    label = connected_components(sides.select(F.col("a").alias("id")), sides.select("a", "b"))
    kinds = pairs.schema["pair"].dataType

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in kinds.names)))
        ids, others, keep = set(), set(), []
        for row in rows:
            if row[2] not in ids and row[3] not in others:
                ids.add(row[2])
                others.add(row[3])
                keep.append(row)
        return pa.table(
            [pa.array(c, table.schema.field(n).type) for c, n in zip(list(zip(*keep)) or [[]] * 4, kinds.names)],
            names=kinds.names
        )

    open_ = sides.join(label, sides["a"] == label["id"]).select("component", "pair.*")
    return open_.groupBy("component").applyInArrow(lambda t: run(t.select(kinds.names)), kinds)


def metrics(candidates: DataFrame, references: DataFrame, matches: DataFrame, hours: float, km: float) -> DataFrame:
    """One row of counts and rates; without references the counts of errors and the rates are null."""
    box = lambda p: [
        F.round(f(c), 6).alias(f"{p}_{n}") for n, f,
        c in (
            ("min_lon", F.min, "lon"), ("min_lat", F.min, "lat"), ("max_lon", F.max, "lon"), ("max_lat", F.max, "lat")
        )
    ]
    one = lambda d: F.broadcast(d)  # noqa: E731  a single row
    c = candidates.agg(F.count("*").alias("candidate_count"), *box("candidate"))
    r = references.agg(F.count("*").alias("reference_count"), *box("reference"))
    m = matches.agg(F.count("*").alias("n"))
    d = nearest_distance(candidates, references, "id").agg(
        F.round(F.min("distance_km"), 3).alias("distance_min"),
        F.round(F.median("distance_km"), 3).alias("distance_median"),
        F.round(F.max("distance_km"), 3).alias("distance_max")
    )
    row = c.crossJoin(one(r)).crossJoin(one(m)).crossJoin(one(d))
    some = F.col("reference_count") > 0
    fp, fn = F.col("candidate_count") - F.col("n"), F.col("reference_count") - F.col("n")
    precision, recall = F.col("n") / F.greatest(
        F.col("n") + fp, F.lit(1)
    ), F.col("n") / F.greatest(F.col("n") + fn, F.lit(1))
    given = {
        "true_positive": F.col("n"), "false_positive": fp, "false_negative": fn, "precision": F.round(precision, 4),
        "recall": F.round(recall, 4), "commission_rate": F.round(1 - precision, 4),
        "omission_rate": F.round(1 - recall, 4)
    }
    return row.withColumns(
        {k: F.when(some, v) for k, v in given.items()} | {
            "status": F.when(some, "provisional").otherwise("no_reference_detections"),
            "time_window_hours": F.lit(float(hours)), "spatial_match_km": F.lit(float(km))
        }
    ).drop("n")


def tagged(candidates: DataFrame, references: DataFrame, matches: DataFrame) -> DataFrame:
    """Candidates and references with what the matching made of them."""
    c = candidates.join(matches.select("id", "distance_km", "dt_hours"), "id", "left").withColumn(
        "tag", F.when(F.col("distance_km").isNotNull(), "true-positive").otherwise("apparent-false-positive")
    )
    r = references.join(matches.select(F.col("r_id").alias("id"), "distance_km", "dt_hours"), "id", "left").withColumn(
        "tag", F.when(F.col("distance_km").isNotNull(), "matched-reference").otherwise("apparent-false-negative")
    )
    names = ["id", "lon", "lat", "acq_ts", "distance_km", "dt_hours", "tag"]
    return c.select(*[F.col(n).cast("string").alias(n) if n == "id" else n for n in names]).unionByName(
        r.select(*[F.col(n).cast("string").alias(n) if n == "id" else n for n in names])
    )


def evaluate(
    candidates: DataFrame, references: DataFrame, windows: tuple[float, ...] = (1, 3, 6), km: float = 5.0,
    cluster_km: float = 2.5, cluster_minutes: float = 30.0
) -> DataFrame:
    """A row of metrics per time window: references near any candidate's time, clustered, matched."""
    from emberframe.operators.clusters import reference_clusters
    from emberframe.operators.spatial import in_time_reach

    out = None
    for h in windows:
        near = in_time_reach(references, candidates, h)
        # without the list of members: close references may all be one cluster
        clusters = kept(reference_clusters(near, cluster_km, cluster_minutes).drop("member_ids"), "clusters")
        row = metrics(candidates, clusters, match(candidates, clusters, km, h), h, km)
        out = row if out is None else out.unionByName(row)
    return out


def recall_at(
    scored: DataFrame, budget: int, by: tuple[str, ...] = ("scene_id",), event: str = "event_id"
) -> DataFrame:
    """One row: the share of events with a candidate among each group's ``budget`` best."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    top = scored.withColumn("_n", F.row_number().over(w))
    return top.agg(
        F.count_distinct(event).alias("events"),
        F.count_distinct(F.when(F.col("_n") <= budget, F.col(event))).alias("found")
    ).withColumn("recall", F.round(F.col("found") / F.nullif(F.col("events"), F.lit(0)), 4))
