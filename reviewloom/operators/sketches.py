"""Distinct ids without the ids: HyperLogLog sketches per branch and round, merged where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two to this power registers; a sketch of it is a few kilobytes whatever it has seen.
LG_REGISTERS = 12


def error_bound(lg_registers: int = LG_REGISTERS, deviations: float = 3.0) -> float:
    """Relative error that an estimate stays below in all but a few of a thousand cases."""
    return deviations * 1.04 / (1 << lg_registers) ** 0.5


def id_sketches(sightings: DataFrame, keys: list[str], id_col: str, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """``keys, sketch, sightings``: what a round has to keep to be counted together with others later."""
    return sightings.groupBy(*keys).agg(
        F.hll_sketch_agg(F.col(id_col), F.lit(lg_registers)).alias("sketch"), F.count("*").alias("sightings")
    )


def distinct_estimates(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ids, sightings`` over all rounds of the keys; sketches are merged, no id is read again."""
    merged: Column = F.hll_union_agg(F.col("sketch"), F.lit(True))
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(merged).alias("ids"), F.sum("sightings").alias("sightings"))
