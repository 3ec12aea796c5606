"""New contents of a table after a batch: inserts, updates and deletes as joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import or_default, text_key
from reviewloom.functions.urls import place_id
from reviewloom.operators.dedupe import keep_first, null_safe
from reviewloom.session import land


def assign_ids(df: DataFrame, order: Sequence[str | Column], id_col: str, start: Column | int = 0) -> DataFrame:
    """Consecutive ids ``start + 1, start + 2, …`` in the given order.

    Rows are written, range-partitioned and numbered inside their partition;
    only the partition sizes are summed up, so no task sees the whole table and
    the sampling of the ranges does not compute the rows again.
    """
    spread = land(land(df, "ids", "zstd").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ids", "zstd")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = spread.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        spread.join(F.broadcast(offsets.drop("_n")), "_part")
        .withColumn(id_col, (first + F.col("_offset") + inside).cast("long"))
        .drop("_part", "_offset")
    )


def next_id(table: DataFrame, id_col: str) -> int:
    """The highest id in use (0 for an empty table): one number read on the driver."""
    return table.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str], latest_last: Sequence[str | Column]) -> DataFrame:
    """``base`` with the rows of ``batch`` put in place of those with the same key.

    Of several rows for one key in the batch the last in the given order wins.
    The batch keys are small next to the table, so the anti-join is normally a
    broadcast and the table is passed through without a shuffle.
    """
    winners = keep_first(batch, keys, [_reversed(c) for c in latest_last]).select(*base.columns)
    # a null key is a key like any other, so that applying a batch twice changes nothing
    named = winners.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return base.join(named, same, "left_anti").select(*base.columns).unionByName(winners)


def _reversed(column: str | Column) -> Column:
    return F.desc_nulls_last(column) if isinstance(column, str) else column.desc_nulls_last()


def absent_reviews(batch: DataFrame, stored: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Batch reviews whose (branch, text) is not stored yet, each once; a null is a value like any other.

    Stored reviews are cut down to the branches of the batch before their texts
    are hashed; a stored ``text_key`` column is used as it is.
    """
    keys = ["branch_id", "_text"]
    fresh = keep_first(batch.withColumn("_text", text_key(F.col("text"))), keys, order)
    key = F.col("text_key") if "text_key" in stored.columns else text_key(F.col("text"))
    visited = null_safe(stored, batch.select("branch_id").distinct(), ["branch_id"], "left_semi")
    hits = null_safe(visited.select("branch_id", key.alias("_text")), fresh, keys, "left_semi").distinct()
    return null_safe(fresh, hits, keys, "left_anti").drop("_text")


def new_reviews(found: DataFrame, stored: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows to append to the reviews table, with defaults filled in and ids continuing the table's."""
    rows = absent_reviews(found, stored, order).select(
        "branch_id",
        "author",
        F.coalesce("rating", F.lit(0)).cast("int").alias("rating"),
        "text",
        F.coalesce("review_date", F.lit("")).alias("review_date"),
        "scraped_at",
    )
    order_cols = ["branch_id", "scraped_at", "text"]
    return assign_ids(rows, order_cols, "review_id", next_id(stored, "review_id")).select(*stored.columns)


def upsert_branches_by_url(branches: DataFrame, batch: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Branches after a collection run keyed by link.

    ``batch`` is ``(name, url, scraped_at)``; the last row per link counts, but
    an empty name never replaces a stored one.  A link stored more than once is
    refreshed at its lowest id.  Rows without a link are left out.
    """
    batch = batch.filter(F.col("url").isNotNull())
    named = F.max_by(F.nullif("name", F.lit("")), F.when(F.nullif("name", F.lit("")).isNotNull(), F.struct(*order)))
    seen = batch.groupBy("url").agg(
        named.alias("_name"), F.max_by("scraped_at", F.struct(*order)).alias("_scraped_at")
    )
    target = branches.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("id").alias("id"))
    updates = seen.join(target, "url").select("id", "_name", "_scraped_at")
    refreshed = branches.join(updates, "id", "left").select(
        *(
            or_default(F.col("_name"), F.col("name")).alias(c) if c == "name"
            else F.coalesce("_scraped_at", "scraped_at").alias(c) if c == "scraped_at"
            else F.col(c)
            for c in branches.columns
        )
    )
    added = seen.join(target, "url", "left_anti").select(
        F.coalesce("_name", "url").alias("name"), "url", F.col("url").alias("place_id"),
        F.col("_scraped_at").alias("scraped_at"),
    )
    return refreshed.unionByName(_inserted(added, branches))


def upsert_branches_by_place(branches: DataFrame, batch: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Branches after a search run keyed by place id or link.

    ``batch`` is ``(name, url, scraped_at)``.  A place that is stored under its
    place id or its link only gets a new date (at the lowest matching id); of
    the others the first per place id is added.  Two equi-joins stand for the
    ``or``, which would otherwise need a nested-loop join.  Rows without a link
    are left out.
    """
    batch = batch.filter(F.col("url").isNotNull())
    places = batch.withColumn("place_id", place_id(F.col("url")))
    keys = places.groupBy("place_id", "url").agg(F.max("scraped_at").alias("scraped_at"))
    by_place = keys.join(branches.select("place_id", F.col("id").alias("match")), "place_id")
    by_url = keys.join(branches.select("url", F.col("id").alias("match")), "url")
    matches = (
        by_place.unionByName(by_url)
        .groupBy("place_id", "url")
        .agg(F.min("match").alias("id"), F.max("scraped_at").alias("_scraped_at"))
    )
    dates = matches.groupBy("id").agg(F.max("_scraped_at").alias("_scraped_at"))
    refreshed = branches.join(dates, "id", "left").select(
        *(F.coalesce("_scraped_at", "scraped_at").alias(c) if c == "scraped_at" else F.col(c) for c in branches.columns)
    )
    unmatched = places.join(matches.select("place_id", "url"), ["place_id", "url"], "left_anti")
    added = keep_first(unmatched, ["place_id"], order).select("name", "url", "place_id", "scraped_at")
    return refreshed.unionByName(_inserted(added, branches))


def _inserted(added: DataFrame, branches: DataFrame) -> DataFrame:
    """New branches with ids after the stored ones and nulls for what is not known."""
    numbered = assign_ids(added, ["url"], "id", next_id(branches, "id"))
    kinds = dict(branches.dtypes)
    return numbered.select(
        *(F.col(c) if c in numbered.columns else F.lit(None).cast(kinds[c]).alias(c) for c in branches.columns)
    )


def delete_branches(branches: DataFrame, reviews: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the removed branch ids; reviews go with their branch."""
    gone = removed.select("branch_id").distinct()
    kept = branches.join(gone.withColumnRenamed("branch_id", "id"), "id", "left_anti")
    return kept.select(*branches.columns), reviews.join(gone, "branch_id", "left_anti").select(*reviews.columns)


def oversize(table: DataFrame, widths: dict[str, int]) -> Column:
    """Names of the columns whose text is wider than the table allows."""
    checks = [F.when(F.length(c) > width, F.lit(c)) for c, width in widths.items() if c in table.columns]
    return F.array_compact(F.array(*checks))


def split_oversize(rows: DataFrame, widths: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and rejected rows with the reason."""
    checked = rows.withColumn("oversize", oversize(rows, widths))
    fits = F.size("oversize") == 0
    return checked.filter(fits).drop("oversize"), checked.filter(~fits)
