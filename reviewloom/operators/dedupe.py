"""First-wins choices.

Each is a rank filter over a window, which Spark turns into a group limit on
both sides of the shuffle: a task sends at most ``n`` rows per key, so a key
that holds a third of all rows stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank"


def first_n(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) <= n).drop(_RANK)


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return first_n(df, keys, order, 1)


def union_first_seen(batches: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """All rows of all batches, the earliest per key."""
    combined = batches[0]
    for batch in batches[1:]:
        combined = combined.unionByName(batch)
    return keep_first(combined, keys, order)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join in which a null is a key like any other."""
    named = right.select(*(F.col(k).alias(f"_other_{k}") for k in keys))
    return left.join(named, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys)), how)


def not_seen(new: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``seen``; a null key is seen like any other."""
    return null_safe(new, seen, keys, "left_anti")


def new_per_round(sightings: DataFrame, keys: Sequence[str], group: str, round_col: str) -> DataFrame:
    """Per group and round: ids first seen in that round, and distinct ids so far."""
    # one pass: sightings per key and round, the key's first round beside them, then sums per round
    each = sightings.groupBy(group, *keys, round_col).agg(F.count("*").alias("n"))
    by_key = Window.partitionBy(group, *keys)
    marked = each.withColumn("first", F.min(round_col).over(by_key) == F.col(round_col))
    rounds = marked.groupBy(group, round_col).agg(
        F.sum("n").alias("sightings"), F.count_if(F.col("first")).alias("new_ids")
    )
    so_far = Window.partitionBy(group).orderBy(round_col)
    return rounds.withColumn("seen_ids", F.sum("new_ids").over(so_far))
