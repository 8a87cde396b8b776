"""Connected components of link graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators.tables import discard, kept


#: Nodes that a task remembers while it shortens edges.
REMEMBERED = 1 << 20


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task as edges from every node to the least one that it reaches by them; what was remembered is
    sent on and forgotten after ``REMEMBERED`` nodes, which loses no link."""
    top: dict[int, int] = {}

    def find(v: int) -> int:
        root = v
        while top.setdefault(root, root) != root:
            root = top[root]
        while top[v] != root:
            top[v], v = root, top[v]
        return root

    def told() -> pa.RecordBatch:
        a = [v for v in top if top[v] != v]
        return pa.record_batch([pa.array(a, pa.int64()), pa.array([find(v) for v in a], pa.int64())], names=["a", "b"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = find(u), find(v)
            if p != q:
                top[max(p, q)] = min(p, q)
        if len(top) > REMEMBERED:
            yield told()
            top.clear()
    yield told()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every component of the distinct edges (a > b) is a star around its least node: no node has two lesser
    neighbours, or a lesser and a greater one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    per = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return not per.filter("ups > 0 and n > 1").limit(1).count()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is the least node that it reaches.

    Self-loops, repeated edges and edges with a null are ignored. Each task first shortens the edges that it has, in
    place, to one per node: edges that come from a join by cells lie with their neighbours, so most components are whole
    then. Rounds of large stars and small stars (Kiveris et al., 2014) join what is left: each joins on nodes,
    pre-aggregated by minimum, and is written to the shared folder; nothing is collected but whether a node is left that
    is no star's centre or leaf. The number of rounds grows with the logarithm of the longest path; where tasks settled all
    by themselves there is none.
    """
    e = edges.filter("a <> b").select("a", "b").mapInArrow(_shortened, "a long, b long")
    e = kept(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds + 1):
        if _are_stars(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = kept(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        discard(e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node (id); component is the least id reachable over edges (a, b). Ids that are no numbers
    are numbered by their hash."""
    kind = nodes.schema["id"].dataType.simpleString()
    if kind not in ("bigint", "int"):
        return _components_by_hash(nodes, edges.filter("a <> b").select("a", "b"), rounds)
    found = components(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), rounds)
    label = found.select(F.col("node").cast(kind).alias("id"), F.col("component").cast(kind).alias("component"))
    return nodes.select("id").distinct().join(label, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _components_by_hash(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """``connected_components`` of ids of any kind. Two ids share a hash with a probability of n^2 / 2^65, and then count as
    linked."""
    named = kept(
        nodes.select("id").unionByName(
            edges.select(F.col("a").alias("id"))
        ).unionByName(edges.select(F.col("b").alias("id"))).distinct().withColumn("h", F.xxhash64("id")),
        "names"
    )
    label = connected_components(
        named.select(F.col("h").alias("id")), edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")),
        rounds
    )
    of = named.join(label.withColumnRenamed("id", "h"), "h").select("id", F.col("component").alias("group"))
    first = of.groupBy("group").agg(F.min("id").alias("component"))
    return nodes.select("id").distinct().join(of.join(first, "group").select("id", "component"), "id")
