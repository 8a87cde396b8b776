"""Links and components among items that share buckets, without expanding buckets into pairs.

In each round a bucket's members are compared with a few leaders; links found merge components, and buckets whose members
are all in one component are done. What is left (members of different components in one bucket) is compared in full once
that is little; until then, the number of leaders grows eightfold a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.components import components
from emberframe.llm.shared import discard, materialize


def link_members(
    members: DataFrame, confirm: Callable[[DataFrame], DataFrame], close: Column | None = None, shared: int = 1,
    full: int = 4
) -> DataFrame | None:
    """(node, component) after all links among the members (key, rep, n) of common buckets; None without a link.

    ``confirm`` gets distinct pairs (a, b), a > b, and returns those that are links. ``close`` is a condition on the two
    members' ``n`` and ``m`` (both are n) that every link meets. Pairs must share ``shared`` buckets at least. What is
    left is compared in full once it is at most ``full`` pairs a row.
    """
    links = found = None
    leaders = 1
    while True:
        state = members.withColumn("c", F.col("rep")) if found is None else members.join(
            found, members["rep"] == found["node"], "left"
        ).select(
            "key", "rep", "n", F.coalesce("component", "rep").alias("c")
        )
        per = state.groupBy("key", "c").agg(
            F.count("*").alias("k"), F.min("rep").alias("rep"), F.min_by("n", "rep").alias("m")
        )
        per = per.groupBy("key").agg(
            F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("parts"),
            F.min(F.struct("rep", "c", "m")).alias("lead")
        )
        mixed = materialize(per.filter("parts > 1"), "mixed")
        todo = mixed.agg(
            F.count("*").alias("keys"), F.sum((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs"),
            F.sum("all").alias("rows"), F.max("all").alias("most")
        ).first()
        if not todo["keys"]:
            return found
        state = state.join(mixed, "key")
        last = leaders > 1 and (todo["pairs"] <= full * todo["rows"] + 100_000 or leaders >= todo["most"])
        if leaders == 1:  # the least member, which the buckets of a group mostly have in common
            pairs = state.filter((F.col("c") != F.col("lead.c")) & (F.col("rep") != F.col("lead.rep"))).select(
                F.col("rep").alias("a"), F.col("lead.rep").alias("b"), "n", F.col("lead.m").alias("m")
            )
        else:
            chosen = state if last else state.filter(F.pmod(F.xxhash64("rep", F.lit(leaders)), F.col("all")) < leaders)
            chosen = chosen.select("key", F.col("rep").alias("other"), F.col("c").alias("d"), F.col("n").alias("m"))
            # in full, a pair would come twice from every bucket
            pairs = state.join(chosen, "key").filter(
                "c <> d and rep > other" if last and close is None else "c <> d"
            ).select(
                F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b"), "n", "m",
                *(["key"] if shared > 1 else [])
            )
        pairs = pairs if close is None else pairs.filter(close)
        if shared > 1:  # a pair comes twice from a bucket in which both lead
            tally = F.count("*") if leaders == 1 or last and close is None else F.count_distinct("key")
            pairs = pairs.groupBy("a", "b").agg(tally.alias("k")).filter(F.col("k") >= shared)
        confirmed = materialize(confirm(pairs.select("a", "b").distinct()), "links")
        links = confirmed if links is None else links.unionByName(confirmed)
        if confirmed.limit(1).count():
            found = materialize(components(links), "components")
        discard(mixed)
        if last:
            return found
        leaders *= 8


#: Pairs of items that a task compares at once.
PAIRS = 1 << 14


def link_buckets(
    members: DataFrame, confirm: Callable[[DataFrame], DataFrame], send: Callable[[DataFrame], DataFrame],
    compare: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]], block: int = 1024
) -> DataFrame | None:
    """(node, component) after all links among the members (key, rep) of common buckets; None without a link.

    ``confirm`` gets distinct pairs (a, b), a > b, and returns those that are links. ``send`` gets rows with a rep and adds
    what ``compare`` needs of the item. ``compare`` gets some items as a table and returns what says of two arrays of their
    places which pairs are links. Two steps:

    1. Every item meets the least item of each of its buckets: a pair for a membership at most.
    2. Of a bucket whose items are in several components then, the items outside its largest one meet all of its items, where
       the items are sent, in cells of about ``block`` by ``block``. No pair is a row, and a task tells only links that join
       what it has not seen joined. What is sent grows with a bucket's size times the blocks that those outside make.
    """
    lead = members.groupBy("key").agg(F.min("rep").alias("lead"))
    pairs = members.join(lead, "key").filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    links = materialize(confirm(pairs.distinct()), "links")
    found = materialize(components(links), "components")
    state = members.join(found, members["rep"] == found["node"], "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("c")
    )
    state = materialize(state, "state")
    per = state.groupBy("key", "c").agg(F.count("*").alias("k"))
    per = per.groupBy("key").agg(
        F.sum("k").alias("all"), F.max(F.struct("k", "c")).alias("main"), F.count("*").alias("parts")
    )
    mixed = per.filter("parts > 1").select(
        "key", F.col("main.c").alias("main"), F.ceil(F.col("all") / block).alias("blocks"),
        F.ceil((F.col("all") - F.col("main.k")) / block).alias("rests")
    )
    placed = state.join(mixed, "key").select(
        "key", "rep", "c", (F.col("c") != F.col("main")).alias("outside"), "blocks", "rests",
        F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("own"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rests")).alias("low")
    )
    zero = F.lit(0).cast("long")
    column = F.transform(F.sequence(zero, F.col("rests") - 1), lambda x: F.struct(x.alias("low"), F.col("own").alias("high")))
    line = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda x: F.struct(F.col("low").alias("low"), x.alias("high")))
    cells = placed.select(
        "key", "rep", "c", "outside", F.explode(
            F.when(F.col("outside"), F.array_union(column, line)).otherwise(column)
        ).alias("cell")
    ).select("key", F.col("cell.low").alias("low"), F.col("cell.high").alias("high"), "rep", "c", "outside")
    sent = send(cells).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    more = materialize(sent.mapInArrow(_compared(compare), "a long, b long"), "links")
    discard(state)
    if more.limit(1).count():
        return materialize(components(links.unionByName(more)), "components")
    return found if found.limit(1).count() else None


def _compared(compare: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]]):
    """Sorted rows (key, low, high, rep, c, outside, what else ``compare`` needs) as links (a, b) of different components."""

    def links(table: pa.Table) -> pa.RecordBatch:
        cell = np.stack([table.column(k).to_numpy() for k in ("key", "low", "high")])
        first = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(0)))
        size = np.diff(np.append(first, len(table)))
        rep, c = (table.column(k).to_numpy() for k in ("rep", "c"))
        top: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := top.setdefault(v, v)) != v:
                top[v] = top[up]
                v = top[v]
            return v

        alike, out = compare(table), []
        outside = np.flatnonzero(table.column("outside").to_numpy())
        of = np.searchsorted(first, outside, side="right") - 1
        ahead = np.concatenate([[0], np.cumsum(size[of])])  # each item outside meets all of its cell
        start = 0
        while start < len(outside):
            stop = max(start + 1, int(np.searchsorted(ahead, ahead[start] + PAIRS, side="right")) - 1)
            n = size[of[start:stop]]
            i = np.repeat(outside[start:stop], n)
            j = np.arange(ahead[stop] - ahead[start]) - np.repeat(ahead[start:stop] - ahead[start] - first[of[start:stop]], n)
            apart = c[i] != c[j]
            i, j = i[apart], j[apart]
            yes = alike(i, j)
            for x, y in zip(i[yes].tolist(), j[yes].tolist()):
                p, q = find(int(c[x])), find(int(c[y]))
                if p != q:
                    top[max(p, q)] = min(p, q)
                    out.append((int(rep[x]), int(rep[y])))
            start = stop
        return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            cell = np.stack([batch.column(k).to_numpy() for k in range(3)])
            last = len(batch) - int((cell == cell[:, -1:]).all(0).sum())  # where the batch's last cell begins
            if waiting and (last or any(waiting[0].column(k)[0] != batch.column(k)[0] for k in range(3))):
                yield links(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting = []
            elif last:
                yield links(pa.Table.from_batches([batch.slice(0, last)]))
            waiting.append(batch.slice(last))
        if waiting:
            yield links(pa.Table.from_batches(waiting))

    return run


def spanning_edges(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, least id) for each item of every component of a symmetric matrix of links, the least itself left out."""
    out: list[tuple[int, int]] = []
    order = np.argsort(ids)
    linked, ids = linked[np.ix_(order, order)], ids[order]
    seen = np.zeros(len(ids), dtype=bool)
    for first in range(len(ids)):
        if seen[first]:
            continue
        part = np.zeros(len(ids), dtype=bool)
        part[first] = True
        front = part.copy()
        while front.any():
            front = linked[front].any(0) & ~part
            part |= front
        seen |= part
        part[first] = False
        out += [(int(i), int(ids[first])) for i in ids[part]]
    return out


def link_groups(
    members: DataFrame, send: Callable[[DataFrame], DataFrame], compare: Callable[[pa.Table], list[tuple[int, int]]],
    block: int = 512
) -> DataFrame:
    """(node, component) after all links among items that share a bucket, directly or through others.

    ``members`` has (key, rep). ``send`` gets rows (rep, and keys of type long) and returns them with what ``compare`` needs
    of the item. ``compare`` gets some items as a table, perhaps one of them twice, and returns links among them, at best a
    spanning forest. No pair of items is ever a row. Two steps:

    1. Every item meets the least item of each of its buckets. A leader's items come in chunks of about ``block``, each
       with the leader, so a cluster of near copies costs an item sent once or twice, whatever its size.
    2. Buckets whose items are in several components are open. Components that open buckets join, directly or through
       others, make a group. Its largest component is settled within itself, so only the other items are compared with
       all of the group, in blocks: what is sent grows with a group's size times the part of it that step 1 left apart.
    """

    def linked(sent: DataFrame, keys: list[str]) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            found = compare(table.drop_columns(keys))
            return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        return materialize(send(sent).groupBy(*keys).applyInArrow(run, "a long, b long"), "links")

    lead = members.groupBy("key").agg(F.min("rep").alias("lead"))
    led = members.join(lead, "key").filter("rep <> lead").select("rep", "lead").distinct()
    led = materialize(led, "led")
    chunks = led.groupBy("lead").agg(F.ceil(F.count("*") / block).alias("chunks"))
    of = led.join(chunks, "lead").select("lead", "rep", F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk"))
    heads = chunks.select(
        "lead", F.col("lead").alias("rep"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    )
    links = linked(of.unionByName(heads), ["lead", "chunk"])
    found = materialize(components(links), "components")

    state = members.join(found, members["rep"] == found["node"], "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("c")
    )
    open_ = state.groupBy("key").agg(
        F.min("c").alias("low"), F.max("c").alias("high")
    ).filter("low <> high").select("key", "low")
    open_ = materialize(
        state.join(open_, "key").filter("c <> low").select(F.col("c").alias("a"), F.col("low").alias("b")).distinct(),
        "open"
    )
    if not open_.limit(1).count():
        return found
    groups = components(open_)
    grouped = materialize(
        state.select("rep", "c").distinct().join(groups, F.col("c") == F.col("node")).select(
            "rep", "c", F.col("component").alias("group")
        ),
        "groups"
    )
    sizes = grouped.groupBy("group", "c").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("group").agg(F.max(F.struct("n", "c")).alias("main"), F.sum("n").alias("n"))
    cut = sizes.select(
        "group", F.col("main.c").alias("main"), F.ceil(F.col("n") / block).alias("blocks"),
        F.ceil((F.col("n") - F.col("main.n")) / block).alias("rest")
    )
    # a group of one block is compared at once; of others, each block of the rest with each block of all
    placed = grouped.join(cut, "group").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    every = placed.select(
        "group", "rep", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)).alias("low")
    )
    whole = every.select("group", "low", F.col("own").alias("high"), "rep")
    rest = placed.filter("c <> main").withColumn("low", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rest")))
    rest = rest.select(
        "group", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("high"), "rep"
    )
    more = linked(whole.unionByName(rest).distinct(), ["group", "low", "high"])
    return materialize(components(links.unionByName(more)), "components")
