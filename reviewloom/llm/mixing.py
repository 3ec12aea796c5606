"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import landed, shuffle_partitions, word_count

# Weights of the sources in order, repeating; the mix's share of all words; the most copies of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
# Newton stops when every source is this close to its target, relative to it.
TOLERANCE = 1e-7
MAX_STEPS = 60
# Documents of one source and size that are ranked in one task.
CELL_ROWS = 100


def source_key(source: Column) -> Column:
    """A source as a key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 by a unique column; tasks number their own range, only range sizes are summed up."""
    spread = landed(
        rows.repartitionByRange(shuffle_partitions(rows), order).withColumn("_part", F.spark_partition_id()), "ranked"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = spread.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return spread.join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_offset") + inside - 1).alias(name)
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """``(key, source_size, target)`` from ``(key, source_size)``: weighted shares that stop at ``cap`` times the source.

    What a stopped source leaves is shared again by weight among the others
    until none is above; every round is one sum over the sources.
    """
    weighted = ranked(sizes, "key", "_place").withColumn(
        "_weight", F.get(F.lit(list(map(float, weights))), (F.col("_place") % len(weights)).cast("int"))
    )
    weighted = landed(weighted, "weights")
    limit = F.col("source_size") * float(cap)
    total = share * float(weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    unit = 0.0
    while True:
        # the first round has no stopped source; the unit only grows, so a stopped source stays stopped
        stopped = (F.col("_weight") * unit >= limit) if unit else F.lit(False)
        fixed, free = weighted.agg(
            F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("_weight"))), F.lit(0.0)),
        ).first()
        following = (total - fixed) / free if free else unit
        if following <= unit:
            break
        unit = following
    return weighted.select("key", "source_size", F.least(F.col("_weight") * unit, limit).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, cap: int) -> Column:
    """Copies of a document: an exponential tilt of the odds of each possible copy."""
    return F.lit(float(cap)) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size / mean))))


def balanced(cells: DataFrame, goals: DataFrame, cap: int = MAX_COPIES, tolerance: float = TOLERANCE) -> DataFrame:
    """``(key, size, n, rate)``: rates nearest to one copy each, in relative entropy, that meet every source's words.

    ``cells`` is ``(key, size, n)``, ``goals`` ``(key, source_size, target)``.
    The dual of the problem is convex with one multiplier per source; a Newton
    step for all of them is one aggregation over the cells.  A step that leaves
    the bracket of its multiplier is replaced by the bracket's middle (or a
    doubling while it is open).  A source whose target is all of its copies has
    no finite multiplier: its rate is the cap.
    """
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = landed(
        goals.join(cells.groupBy("key").agg(F.sum("n").alias("docs")), "key").select(
            "key", "target", full.alias("full"), (F.col("source_size") / F.col("docs")).alias("mean"),
            F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            F.lit(False).alias("done"),
        ),
        "tilts",
    )
    for _ in range(MAX_STEPS):
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        slope = rate * (1 - rate / cap) * F.col("size") / F.col("mean")
        sums = (
            cells.join(state.filter(~F.col("full") & ~F.col("done") & (F.col("target") > 0)), "key")
            .groupBy("key")
            .agg(F.sum(F.col("n") * rate * F.col("size")).alias("words"), F.sum(F.col("n") * slope * F.col("size")).alias("slope"))
        )
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        near = F.abs(gap) <= tolerance * F.col("target")
        moved = state.join(sums, "key", "left").select(
            "key", "target", "full", "mean",
            F.when(F.col("words").isNull() | near, F.col("tilt"))
            .when((low.isNull() | (step > low)) & (high.isNull() | (step < high)) & (F.abs(step) <= 2 * F.abs(F.col("tilt")) + 4), step)
            .when(low.isNotNull() & high.isNotNull(), (low + high) / 2)
            .when(gap < 0, F.greatest(2 * F.col("tilt"), F.lit(1.0)))
            .otherwise(F.least(2 * F.col("tilt"), F.lit(-1.0)))
            .alias("tilt"),
            F.when(F.col("words").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("words").isNull(), F.col("high")).otherwise(high).alias("high"),
            (F.col("words").isNull() | near).alias("done"),
        )
        state = landed(moved, "tilts")
        if not state.filter(~F.col("done")).limit(1).count():
            break
    rate = F.when(F.col("full"), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(
        _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
    )
    return cells.join(state, "key").select("key", "size", "n", rate.alias("rate"))


def rounded(rates: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(key, size, salts, salt, n, base, extra)``: whole copies for each cell of documents of one source and size.

    Every document gets the whole part of its rate; the broken parts are summed
    along each source by size and every whole one passed gives one more copy,
    so no prefix of a source is off by more than one document.  A running sum is
    taken inside narrow size ranges and over the ranges' totals.
    """
    base = F.floor("rate")
    part = F.col("n") * (F.col("rate") - base)
    cells = rates.select(
        "key", "size", "n", base.cast("int").alias("base"), part.alias("part"),
        F.floor(F.col("size") / 64).alias("range"),
    )
    totals = cells.groupBy("key", "range").agg(F.sum("part").alias("sum"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("key", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)).alias("start"))
    inside = Window.partitionBy("key", "range").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("start") + F.col("run")
    # half a copy ahead, so that the sum is rounded to the nearest; 2**-20 of a copy hides the order of the sums
    whole = lambda x: F.floor(F.round(x + 0.5, 6))
    summed = cells.withColumn("run", F.sum("part").over(inside)).join(starts, ["key", "range"])
    return summed.select(
        "key", "size", "n", "base",
        F.least(F.greatest(whole(upto) - whole(upto - F.col("part")), F.lit(0)), F.col("n")).alias("extra"),
        F.ceil(F.col("n") / cell_rows).cast("int").alias("salts"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = MAX_COPIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Copies of each document that bring every source's words near its target.

    Returns ``id_col``, ``size`` (words), ``source_size``, ``target``,
    ``copies``, ``taken`` (words times copies) and the ``carry`` columns, one
    row per input row.  A document is taken whole, 0 to ``cap`` times.

    A null text has no words; a null source is a source of its own, the last.
    Documents without words take nothing from any target and get one copy
    unless their source is full.  Which documents of one source and size get one
    more copy is decided by a hash of id and text, so reruns agree; repeated
    rows are documents of their own.  Without any words all targets are 0.  An
    empty table gives an empty result.  Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        source_key(F.col(source_col)).alias("key"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"),
        F.struct(*(F.col(c) for c in carry)).alias("carry") if carry else F.lit(None).cast("string").alias("carry"),
    )
    cells = landed(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    goals = landed(
        targets(cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap), "targets"
    )
    copies = landed(
        rounded(balanced(cells, goals, cap)).join(goals, "key"),
        "copies",
    )
    # dealt by the salt too, so that the documents of one source and size need not meet in one task
    met = rows.join(copies, ["key", "size"]).withColumn("salt", F.pmod("draw", F.col("salts")).cast("int"))
    return _dealt(met.repartition("key", "size", "salt")).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"carry.{c}").alias(c) for c in carry),
    )


def _dealt(met: DataFrame) -> DataFrame:
    """The extra copies of a cell, dealt by draw; a large cell is ranked in several tasks.

    Each task ranks the documents of one salt and knows from the others only
    how many there are, so the first ``extra`` places of the whole cell are those
    of the first salts.
    """
    counts = landed(met.groupBy("key", "size", "salt").agg(F.count("*").alias("rows")), "salts")
    earlier = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("key", "size", "salt", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("draw", "id"))
    return (
        met.withColumn("rank", rank)
        .join(places, ["key", "size", "salt"])
        .withColumn("copies", F.col("base") + F.when(F.col("rank") + F.col("start") <= F.col("extra"), 1).otherwise(0))
    )
