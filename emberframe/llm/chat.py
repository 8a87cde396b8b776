"""Minimum-cost role repair of conversations, then rendering.

A legal conversation starts with an optional system turn and goes on user, assistant, user, ... A source turn may be kept,
relabelled to another role, or merged into the turn before it; empty turns may be inserted. Every choice has a cost, and
the cheapest repair is found by dynamic programming over the automaton whose states are the role of the last turn:
state after a source turn = min over states before of cost(before, after, role of the source turn).

A source turn is thus a small min-plus matrix that only depends on its role, and matrices multiply. Rows are
range-partitioned by (conversation, turn) and numbered within their conversation, so one that fills the table lies in many
tasks; its rows are then dealt in pieces of ``PIECE``. A conversation of one piece is settled where the piece is. Of longer
ones, the matrices of a piece are multiplied pairwise, those of all pieces of a batch at once; the products of ``PIECE``
pieces make a block, and a conversation has one row per block at the top. Then states go back down: from the conversation's
ends to its blocks' ends, its pieces' ends and its rows. Pieces and blocks are cut by the rows' numbers alone, so the
repair does not depend on how Spark deals the rows. Python sees the roles as numbers; what a choice renders is looked up by
Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.shared import materialize, shuffle_partitions

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, RELABEL_UNKNOWN, MERGE_SAME, MERGE_OTHER, INSERT = 3, 1, 1, 4, 2
#: A state in which a conversation may end; else an empty turn is added.
ENDS = (START, USER, ASSISTANT)
NONE = 10**9
#: In place of the last state of a run: any.
FREE = -1
#: Rows of a piece, and pieces of a block.
PIECE = 4096
#: What opens a header; in a text it is written apart, so that no text can pass for a turn.
OPEN, APART = "<|", "< |"


def _inserts() -> np.ndarray:
    """[before, after] -> roles inserted on the shortest legal way to emit ``after``, or None."""
    way = np.full((4, 4), None, dtype=object)
    for before in range(4):
        front = [(before, ())]
        while front:
            ahead = []
            for at, passed in front:
                for to in LEGAL[at]:
                    if way[before, to] is None:
                        way[before, to] = passed
                        ahead.append((to, (*passed, to)))
            front = ahead
    return way


WAYS = _inserts()


def choices(role: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost, action) of getting from state to state by a turn of ``role`` (0: none of the three). Of equal costs, keeping
    or relabelling comes before merging."""
    cost, action = np.full((4, 4), NONE, dtype=np.int64), np.full((4, 4), "", dtype=object)
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            if (way := WAYS[before, after]) is not None:
                own = 0 if role == after else RELABEL_UNKNOWN if role == 0 else RELABEL
                cost[before, after] = own + INSERT * len(way)
                action[before, after] = "keep" if role == after else "relabel"
        if before != START:
            merged = MERGE_SAME if role == before else MERGE_OTHER
            if merged < cost[before, before]:
                cost[before, before], action[before, before] = merged, "merge"
    return cost, action


TABLES = [choices(r) for r in range(4)]
COSTS = np.stack([cost for cost, _ in TABLES])
#: Cost of ending in a state, and the role of the turn that is added then.
END_COST = np.array([0 if s in ENDS else INSERT for s in range(4)], dtype=np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), NONE)


def codes(roles: list[str | None]) -> list[int]:
    known = {r: k + 1 for k, r in enumerate(ROLES)}
    return [known.get((r or "").strip(" \t\n\v\f\r").lower(), 0) for r in roles]


def role_code(role: Column) -> Column:
    """The same as ``codes``: 1 to 3, or 0 for any other role."""
    name = F.lower(F.btrim(role, F.lit(" \t\n\v\f\r")))
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), name), F.lit(0)).cast("int")


def multiplied(m: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The products of each run of the matrices ``m``; runs begin at ``heads``. Neighbours are multiplied pairwise until
    every run is one matrix."""
    run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(m))))
    while len(m) > len(heads):
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        place = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
        left = np.flatnonzero(place % 2 == 0)
        paired = (left + 1 < len(run)) & (np.append(run, -1)[left + 1] == run[left])
        out = m[left]
        out[paired] = product(out[paired], m[left[paired] + 1])
        m, run = out, run[left]
    return m


def steps(
    matrices: np.ndarray, heads: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(state before, state after) of each matrix on the cheapest way through its run, from the run's state ``first`` to
    ``last`` (``FREE``: the one that is cheapest to end in). Of equal ways, the one whose states are least from the end
    backwards. All runs go forward together, one place at a time, and then back."""
    size = np.diff(np.append(heads, len(matrices)))
    order = np.argsort(-size, kind="stable")  # the longest first: those that have a k-th place are the first ones
    heads, size, first = heads[order], size[order], first[order]
    best = np.full((len(matrices), 4), NONE, dtype=np.int64)  # costs before each place
    now = np.full((len(heads), 4), NONE, dtype=np.int64)
    now[np.arange(len(heads)), first] = 0
    have = [int(np.searchsorted(-size, -k, side="left")) for k in range(int(size.max(initial=0)))]  # runs longer than k
    for k, n in enumerate(have):
        at = heads[:n] + k
        best[at] = now[:n]
        now[:n] = np.minimum((now[:n, :, None] + matrices[at]).min(1), NONE)
    state = np.where(last[order] == FREE, (now + END_COST).argmin(1), last[order])
    before, after = np.empty(len(matrices), dtype=np.int64), np.empty(len(matrices), dtype=np.int64)
    for k, n in zip(range(len(have) - 1, -1, -1), reversed(have)):
        at = heads[:n] + k
        after[at] = state[:n]
        state[:n] = (best[at] + np.take_along_axis(matrices[at], state[:n, None, None], 2)[..., 0]).argmin(1)
        before[at] = state[:n]
    return before, after


def header(role: int) -> str:
    return f"{OPEN}{ROLES[role - 1]}|>\n"


def _heads(rows: pa.RecordBatch, keys: list[int]) -> np.ndarray:
    """Where runs of rows with the same keys begin."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for k in keys:
        x = rows.column(k)
        null, value = x.is_null().to_numpy(zero_copy_only=False), x.fill_null(0).to_numpy()
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def _whole_pieces(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, heads): batches that end where a piece ends, and where their pieces begin."""
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([*carried, batch]).combine_chunks().to_batches()[0]
        heads = _heads(rows, keys)
        last = int(heads[-1])
        carried = [rows.slice(last)]
        if last:
            yield rows.slice(0, last), heads[:-1]
    if carried:
        yield carried[0], np.zeros(1, dtype=np.int64)


def _matrices(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, 4, 4)


def _listed(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * 16), pa.array(m.reshape(-1)))


def _gathered(matrices: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The rows (``at``, matrix) of each key in order, as a list ``f``."""
    return matrices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, "matrix"))).alias("f"))


def _settled(lists: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, ``at``, first, last, end): the states at the ends of each matrix of the lists ``f``, from the states first and
    last of the whole list. ``end`` tells the last matrix of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, first, last, end = (b.column(len(keys) + k) for k in range(4))
            count = np.diff(np.asarray(f.offsets))
            heads = np.cumsum(count) - count
            places, matrix = f.flatten().flatten()
            before, after = steps(_matrices(matrix), heads, np.asarray(first), np.asarray(last))
            ends = np.zeros(len(places), dtype=bool)
            ends[heads + count - 1] = end.to_numpy(zero_copy_only=False)
            of = pa.array(np.repeat(np.arange(len(heads)), count))
            yield pa.record_batch(
                [
                    *(b.column(k).take(of) for k in range(len(keys))), places, pa.array(before), pa.array(after),
                    pa.array(ends)
                ],
                names=[*keys, at, "first", "last", "end"]
            )

    schema = ", ".join(f"{k} long" for k in (*keys, at, "first", "last"))
    return lists.select(*keys, "f", "first", "last", "end").mapInArrow(run, f"{schema}, end boolean")


def _piece_ends(products: DataFrame, width: int) -> DataFrame:
    """(conv_id, piece, first, last, end) of the pieces whose products (conv_id, piece, matrix) are given: all pieces of
    conversations. A list holds ``width`` pieces, or a conversation's blocks of ``width * width`` rows each."""
    blocks = _gathered(products.withColumn("block", F.expr(f"piece div {width}")), ["conv_id", "block"], "piece")
    blocks = materialize(blocks, "blocks")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(2)
            m = _matrices(f.flatten().flatten()[1])
            yield pa.record_batch(
                [*b.columns[:2], _listed(multiplied(m, np.asarray(f.offsets)[:-1] - f.offsets[0].as_py()))],
                names=["conv_id", "block", "matrix"]
            )

    whole = _gathered(blocks.mapInArrow(multiply, "conv_id long, block long, matrix array<long>"), ["conv_id"], "block")
    whole = whole.withColumns(
        {"first": F.lit(START).cast("long"), "last": F.lit(FREE).cast("long"), "end": F.lit(True)}
    )
    ends = _settled(whole, ["conv_id"], "block").withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    below = blocks.join(ends, blocks["conv_id"].eqNullSafe(ends["_conv"]) & (blocks["block"] == ends["_block"]))
    return _settled(below, ["conv_id", "block"], "piece").drop("block")


def _literals(values: list) -> Column:
    return F.array(
        *[F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, (list, tuple)) else F.lit(v) for v in values]
    )


def rendered(rows: DataFrame) -> DataFrame:
    """The result's columns from the states before and after each turn: looked up, and put together as text."""
    pairs = [(b, a) for b in range(4) for a in range(4)]
    way = lambda b, a: WAYS[b, a] or ()
    pair, code = F.col("before") * 4 + F.col("after"), F.col("code") * 16 + F.col("before") * 4 + F.col("after")
    action = F.get(_literals([str(TABLES[r][1][b, a]) for r in range(4) for b, a in pairs]), code)
    cost = F.get(_literals([int(TABLES[r][0][b, a]) for r in range(4) for b, a in pairs]), code).cast("long")
    merged = F.col("action") == "merge"
    none = F.array().cast("array<string>")
    inserted = F.when(merged, none).otherwise(
        F.get(_literals([[ROLES[w - 1] for w in way(b, a)] for b, a in pairs]), pair)
    )
    heads = F.when(merged, "").otherwise(
        F.get(
            _literals(["".join(header(w) + "\n" for w in way(b, a)) + (header(a) if a else "") for b, a in pairs]), pair
        )
    )
    body = F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit(APART))
    short = F.col("final") & F.get(_literals([bool(c) for c in END_COST]), F.col("after"))
    piece = F.concat(
        F.when(F.col("seq") == 0, "").otherwise("\n"), heads, body, F.when(short, "\n" + header(USER)).otherwise("")
    )
    out = rows.withColumn("action", action).withColumn("cost", cost + F.when(short, INSERT).otherwise(0))
    new_role = F.get(_literals(["", *ROLES]), F.col("after"))
    more = F.when(short, F.array(F.lit(ROLES[USER - 1]))).otherwise(none)
    return out.select(
        "conv_id", "seq", "turn", "role", "action", new_role.alias("new_role"),
        F.concat(inserted, more).alias("inserted"), "cost", piece.alias("rendered")
    )


def repair_roles(
    turns: DataFrame, partitions: int | None = None, width: int = PIECE, conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per row of ``turns``: its place in the conversation (seq from 0), what became of it and its rendering.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a defined order; rows with
    a null conv_id are one conversation. Roles are compared without case and outer white space; any other role, or null,
    can only be relabelled or merged. A null text is empty; "<|" within a text is written "< |", so that no text, however
    long, can open a turn. ``rendered`` of a conversation's rows, joined in order of seq, is the whole repaired
    conversation: each turn is "<|role|>", a line end and its text, turns and merged texts are parted by a line end.
    ``inserted`` are the empty turns before this one (after it, where the conversation may not end yet); ``cost`` is the
    row's share of the conversation's cost. An empty table gives an empty result. Other columns are not returned.
    """
    n = partitions or shuffle_partitions(turns.sparkSession)
    rows = turns.select(
        turns[conv_id].cast("long").alias("conv_id"), turns[turn].cast("long").alias("turn"),
        turns[role].cast("string").alias("role"), turns[text].cast("string").alias("text")
    )
    ordered = rows.repartitionByRange(
        n, "conv_id", "turn", "role", "text"
    ).sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.withColumn("code", role_code(F.col("role")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, rows_of_last = TaskContext.get().partitionId(), (), 0
        for b in batches:
            if not len(b):
                continue
            heads = _heads(b, [0])
            counts = np.diff(np.append(heads, len(b)))
            place = np.arange(len(b)) - np.repeat(heads, counts)
            if last == (b.column(0)[0].as_py(),):  # goes on from the batch before
                place[: counts[0]] += rows_of_last
            last, rows_of_last = (b.column(0)[len(b) - 1].as_py(),), int(place[-1]) + 1
            yield pa.record_batch(
                [*b.columns, pa.array(np.full(len(b), part)), pa.array(place)],
                names=["conv_id", "turn", "role", "text", "code", "part", "place"]
            )

    ordered = materialize(
        ordered.mapInArrow(
            number, "conv_id long, turn long, role string, text string, code int, part long, place long"
        ),
        "turns"
    )
    # only the first conversation of a partition can have begun before it: at most a row per partition is broadcast
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = ordered.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(earlier))
    begun = F.broadcast(
        begun.filter("base > 0").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "base")
    )
    rows = ordered.join(
        begun, ordered["conv_id"].eqNullSafe(begun["_conv"]) & (ordered["part"] == begun["_part"]), "left"
    )
    rows = rows.withColumn(
        "seq", F.col("place") + F.coalesce("base", F.lit(0))
    ).withColumn("piece", F.expr(f"seq div {width}"))
    rows = rows.select("conv_id", "piece", "turn", "role", "text", "code", "seq")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, heads in _whole_pieces(batches, [0, 1]):
            piece, n = np.asarray(some.column(1))[heads], np.diff(np.append(heads, len(some)))
            several = np.repeat((piece > 0) | (n == width), n)  # else the conversation has one piece
            some = some.filter(pa.array(several))
            if len(some):
                heads = _heads(some, [0, 1])
                m = multiplied(COSTS[np.asarray(some.column(2))], heads)
                yield pa.record_batch(
                    [*(some.column(k).take(pa.array(heads)) for k in range(2)), _listed(m)],
                    names=["conv_id", "piece", "matrix"]
                )

    roles = rows.select(
        "conv_id", "piece", "code", "seq"
    ).repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "seq")
    ends = _piece_ends(roles.mapInArrow(multiply, "conv_id long, piece long, matrix array<long>"), width)

    # a piece's states come ahead of its rows, as a row of its own: texts are shuffled once, and joined with nothing
    states = {"first": F.lit(START).cast("long"), "last": F.lit(FREE).cast("long"), "end": F.lit(True)}
    told = rows.withColumns(states).unionByName(
        ends.withColumn("seq", F.lit(-1).cast("long")), allowMissingColumns=True
    )

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, heads in _whole_pieces(batches, [0, 1]):
            seq, first, last, end = (some.column(k).to_numpy(zero_copy_only=False) for k in range(6, 10))
            own = seq >= 0
            first, last, end, heads = first[heads], last[heads], end[heads], (np.cumsum(own) - own)[heads]
            some = some.filter(pa.array(own))
            before, after = steps(COSTS[np.asarray(some.column(5))], heads, first, last)
            final = np.zeros(len(some), dtype=bool)
            final[np.append(heads[1:], len(some)) - 1] = end
            columns = [some.column(k) for k in (0, 2, 3, 4, 5, 6)]
            yield pa.record_batch(
                [*columns, pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(final)],
                names=["conv_id", "turn", "role", "text", "code", "seq", "before", "after", "final"]
            )

    told = told.select("conv_id", "piece", "turn", "role", "text", "code", "seq", "first", "last", "end")
    traced = told.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "seq")
    return rendered(
        traced.mapInArrow(
            trace,
            "conv_id long, turn long, role string, text string, code int, seq long, before int, after int, final boolean"
        )
    )
