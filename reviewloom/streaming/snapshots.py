"""Reviews that accumulate over page snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators.dedupe import keep_first, not_seen
from reviewloom.operators.upsert import new_reviews, upsert
from reviewloom.sinks.store import ReviewStore


def unique_over_time(stream: DataFrame, keys: Sequence[str], time_col: str | None = None, delay: str | None = None) -> DataFrame:
    """The first sighting of each key.

    With a delay, state is kept only that long behind the newest ``time_col``;
    later repeats are caught by the anti-join of :func:`land_reviews`.
    """
    if time_col and delay:
        return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def each_batch(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def land_reviews(store: ReviewStore, counts_path: str, order: Sequence[str | Column]) -> Callable[[DataFrame, int], None]:
    """Batch handler: append reviews that are not stored yet and note found / new per branch.

    A batch that runs again ignores its own earlier part and writes it anew,
    so a restart neither loses nor doubles rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        part = f"batch-{batch_id}"
        batch.persist()
        fresh = new_reviews(batch, store.read("reviews", without_part=part), order)
        store.append("reviews", fresh, part)
        found = batch.groupBy("branch_id").agg(F.count("*").alias("found"))
        landed = store.spark.read.parquet(*store.part_files("reviews", part)).groupBy("branch_id").agg(F.count("*").alias("new"))
        counts = found.join(landed, "branch_id", "left").select(
            "branch_id", F.lit(batch_id).cast("long").alias("round"), "found", F.coalesce("new", F.lit(0)).alias("new")
        )
        counts.write.mode("overwrite").parquet(f"{counts_path}/{part}")
        batch.unpersist()

    return handle


def upsert_each_batch(store: ReviewStore, table: str, keys: Sequence[str], order: Sequence[str | Column]) -> Callable[[DataFrame, int], None]:
    """Batch handler: put the rows of a batch in place of stored ones; applying a batch twice changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.replace(table, upsert(store.read(table), batch, keys, order))

    return handle


def land_first(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], order: Sequence[str | Column]) -> None:
    """Write the rows of a batch whose key has not landed in an earlier one; a batch that runs again replaces its part.

    State behind a watermark forgets old keys, and de-duplication leaves open
    which row of a batch stays; both are settled here.
    """
    once = keep_first(batch, keys, order)
    before = _landed_before(batch.sparkSession, path, batch_id)
    fresh = once if before is None else not_seen(once, before, keys)
    fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _landed_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    earlier = [f"{path}/batch={k}" for k in range(batch_id)]
    return spark.read.parquet(*earlier) if earlier else None


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """All landed rows with their ``batch``."""
    return spark.read.parquet(path)
