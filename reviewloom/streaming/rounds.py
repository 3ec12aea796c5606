"""Ids that are new in each round of a collection, with keyed state instead of a look at what has landed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the processor travels by value: the driver starts a worker for it that knows of no shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "branch_id long, part int, round long, sightings long, new_ids long, seen_ids long"
# State keys of a branch: a branch that brings a third of all ids is spread over so many of them.
PARTS = 16


class SeenIds(StatefulProcessor):
    """Map state of a key's seen ids, each forgotten ``ttl_ms`` after it was last seen, and a counter of new ones."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "round long", self.ttl_ms)
        self.total = handle.getValueState("total", "ids long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        found: dict[int, list[int]] = {}
        total = self.total.get()[0] if self.total.exists() else 0
        # rounds that arrive together are counted in their order
        for batch in sorted((b for whole in rows for _, b in whole.groupby("round")), key=lambda b: b["round"].iloc[0]):
            number = int(batch["round"].iloc[0])
            counts = found.setdefault(number, [0, 0])
            for name in batch["id"]:
                counts[0] += 1
                if not self.seen.containsKey((name,)):
                    counts[1] += 1
                    total += 1
                self.seen.updateValue((name,), (number,))
            counts.append(total)
        self.total.update((total,))
        branch, part = key
        out = [(branch, part, number, counts[0], counts[1], counts[-1]) for number, counts in sorted(found.items())]
        yield pd.DataFrame(out, columns=["branch_id", "part", "round", "sightings", "new_ids", "seen_ids"])

    def close(self) -> None:
        pass


def new_ids_by_round(sightings: DataFrame, ttl_ms: int | None = None, parts: int = PARTS) -> DataFrame:
    """A stream of ``(branch_id, id, round)`` as counts per branch, part of its ids and round.

    ``sightings`` counts rows, ``new_ids`` ids not seen before (or not for
    ``ttl_ms``), ``seen_ids`` new ids so far.  Ids are dealt over ``parts`` by
    their hash, so no key holds all ids of a large branch; sum over the parts
    with :func:`rounds_of_parts`.  Null ids are left out.
    """
    spark: SparkSession = sightings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = sightings.filter(F.col("id").isNotNull()).select(
        F.col("branch_id").cast("long").alias("branch_id"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
        F.col("id").cast("string").alias("id"), F.col("round").cast("long").alias("round"),
    )
    return rows.groupBy("branch_id", "part").transformWithStateInPandas(
        SeenIds(ttl_ms), OUTPUT, "append", "ProcessingTime" if ttl_ms else "None"
    )


def rounds_of_parts(counts: DataFrame) -> DataFrame:
    """``branch_id, round, sightings, new_ids`` from the counts of all parts."""
    return counts.groupBy("branch_id", "round").agg(F.sum("sightings").alias("sightings"), F.sum("new_ids").alias("new_ids"))
