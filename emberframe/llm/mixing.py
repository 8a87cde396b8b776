"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target number of words. Whole epochs come first: each of its documents is taken
floor(target / source size) times. What is left is a fractional selection: a document draws u in (0, 1) from a hash of
its id and the seed, its exponential key is -ln(u) / quality weight, and the documents with the smallest keys are taken
until their running sum of words reaches the budget (the last one is taken if that comes nearer).

No source is ever sorted as a whole. exp(-key) lies in (0, 1), so its range is cut into bins; the sums of the bins give
the one bin in which a source's budget ends, and only that bin's documents are sorted, to find the last one that is taken.
That row is all that the other rows of the source are compared with, so a source with a third of all rows is spread like
any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which every source's rows are dealt where they meet their target, so that a large source is no hot key.
SALTS = 64


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) with 52 random bits that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets of (source, source_size): the sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share
    the sum of all sizes; no target exceeds ``max_epochs`` times its source's size, and the excess is shared again by
    weight among the others. One row per source goes through a single task; the result has a row per source.

    The repeated sharing has a closed form: target = min(cap, level * weight). With sources ordered by cap / weight, the
    level is that of the first source whose ratio reaches the level left by all sources before it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = max_epochs * F.col("source_size")
    s = sizes.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1)
    s = s.withColumn("ratio", cap / F.col("weight"))
    ranked = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(ranked), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ranked), F.lit(0)))
    s = s.withColumn("level", level)
    s = s.withColumn(
        "level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"]
    )
    target = F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def _drawn(
    docs: DataFrame, size: Column, weight: Column | None, row: Column, seed: int, bins: int, doc_id: str, source: str
) -> list[Column]:
    """The numbers by which rows of ``docs`` are ordered."""
    w = F.lit(1.0) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(1.0)
    key = -F.log(uniform(F.col(doc_id), seed)) / w
    size = F.coalesce(size, F.lit(0)).cast("long")
    return [
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key"),
        F.floor((1 - F.exp(-key)) * bins).cast("int").alias("bin"), row.alias("row")
    ]


#: The order in which a source's rows are taken.
ORDER = ("key", "size", "doc_id", "row")


def _plan(drawn: DataFrame, max_epochs: int) -> DataFrame:
    """A row per source: size, target, whole epochs, the bin in which the budget ends and the last row of it that is taken.

    A row is taken if the sizes before it and half its own are within the budget; after the first that is not, none is."""
    per_bin = drawn.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), max_epochs)
    full = F.when(F.col("source_size") <= 0, 0).when(
        F.col("target") >= max_epochs * F.col("source_size"), max_epochs
    ).otherwise(F.floor(F.col("target") / F.col("source_size")))
    rest = F.when(F.col("epochs") >= max_epochs, 0.0).otherwise(
        F.col("target") - F.col("epochs") * F.col("source_size")
    )
    targets = targets.withColumn(
        "epochs", full.cast("long")
    ).withColumn("budget", rest).withColumnRenamed("source", "of")

    up_to = Window.partitionBy("source").orderBy("bin")  # at most a row per bin
    ends = per_bin.withColumn("sum", F.sum("bin_size").over(up_to)).join(
        targets.select("of", "budget"), F.col("source").eqNullSafe(F.col("of"))
    )
    ends = ends.filter((F.col("sum") > F.col("budget")) & (F.col("sum") - F.col("bin_size") <= F.col("budget")))
    ends = ends.groupBy("of").agg(
        F.min(F.struct("bin", (F.col("sum") - F.col("bin_size")).alias("before"), "budget")).alias("end")
    )
    ends = materialize(ends.select("of", F.col("end.bin").alias("end_bin"), "end.before", "end.budget"), "ends")

    last = drawn.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("end_bin")))
    running = Window.partitionBy("of").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0)) + F.col("before"))
    last = last.filter(
        F.col("ahead") + F.col("size") / 2 <= F.col("budget")
    ).groupBy("of").agg(F.max(F.struct(*ORDER)).alias("last"))
    plan = targets.drop("budget").join(
        ends.select(F.col("of").alias("_of"), "end_bin"), F.col("of").eqNullSafe(F.col("_of")), "left"
    ).drop("_of")
    plan = plan.join(last.withColumnRenamed("of", "_of"), F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of")
    return materialize(plan, "mix-plan")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (drawn) with their source's plan and ``times``: how often the mix takes the row. Every source's rows meet
    the plan in ``SALTS`` parts, so a source with a third of all rows is no hot key."""
    plan = plan.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")
    out = rows.withColumn("part", part).join(
        plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    )
    picked = (F.col("bin") < F.col("end_bin")) | (
        (F.col("bin") == F.col("end_bin")) & (F.struct(*ORDER) <= F.col("last"))
    )
    return out.withColumn("times", F.col("epochs") + F.coalesce(picked, F.lit(False)).cast("long"))


def mix_sources(
    docs: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = 17, max_epochs: int = 3,
    bins: int = 4096, doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, and source.

    ``size`` counts the words of ``text`` unless given; ``weight`` is the quality weight (1 unless given; null or not
    above 0 counts as 1). ``taken`` is a multiple of the size, from 0 to ``max_epochs`` times. A null text has size 0 and
    nothing to take; a null source is a source of its own, the last; a null id draws as the empty string does. Rows with
    equal keys are taken the shorter first, and of repeated rows any may be the one that is taken. An empty table gives
    an empty result. Other columns are not returned.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) if size is None else size
    drawn = docs.select(*_drawn(docs, size, weight, F.monotonically_increasing_id(), seed, bins, doc_id, source))
    drawn = materialize(drawn, "mix")  # the texts are read once; what follows reads a few numbers a document
    out = _with_plan(drawn, _plan(drawn, max_epochs))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source"
    )


def repeat_rows(
    docs: DataFrame, size: str, row: str, weight: Column | None = None, seed: int = 17, max_epochs: int = 3,
    bins: int = 4096, doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """The rows of ``docs``, with all columns, each as often as ``mix_sources`` takes it. Rows of size 0 are left out.

    ``row`` names a column that tells repeated rows apart (such as ``monotonically_increasing_id`` over a scan); ``docs``
    may have no column named like those of ``mix_sources`` or its plan. The few numbers that order the rows are read first;
    with the sources' plan, each row is then decided where it lies, and no list of what was taken is joined.
    """
    numbers = _drawn(docs, F.col(size), weight, F.col(row), seed, bins, doc_id, source)
    plan = _plan(materialize(docs.select(*numbers), "mix"), max_epochs)
    taken = _with_plan(docs.select(*docs.columns, *numbers), plan).filter("size > 0 and times > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return taken.withColumn("copy", copy).select(*docs.columns)
