"""Line de-duplication: lines that many documents hold are dropped everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import SPACES, ascii_lower, landed


def line_keys(text: Column) -> Column:
    """Key of each line: white space stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(SPACES)))


def _hashed(keys: Column, min_chars: int) -> Column:
    """A 96-bit hash of each key, null for keys that are too short to count."""
    return F.transform(
        keys,
        lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"))),
    )


def dedupe_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Returns ``id_col``, ``n_lines``, ``n_dropped``, ``kept_text`` and the
    ``carry`` columns, one row per input row.  Only hashes are exploded and
    counted, once per row, so a line that is in every document is summed up
    before the shuffle; whether those rows are different documents is counted
    for lines of enough rows only.  The text itself is shuffled once, to meet
    its dropped positions.

    A null or empty text is one empty line.  Rows that share an id are one
    document for the count, rows without an id one each; all of them get their
    result.  An empty table gives an empty result.  Other columns are not read,
    whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("of"), _hashed(line_keys(text), min_chars).alias("lines")
    )
    frequent = landed(
        hashes.select(F.explode(F.array_distinct("lines")).alias("line"))
        .filter(F.col("line").isNotNull())
        .groupBy("line.a", "line.b")
        .count()
        .filter(F.col("count") >= min_docs)
        .select("a", "b"),
        "frequent-lines",
    )
    found = landed(
        hashes.select("id", "of", F.posexplode("lines").alias("pos", "line"))
        .filter(F.col("line").isNotNull())
        .select("id", "of", "pos", "line.a", "line.b")
        .join(frequent, ["a", "b"], "left_semi"),
        "line-places",
    )
    named = found.filter(F.col("id").isNotNull()).groupBy("a", "b", "id").agg(F.lit(1).alias("n"))
    nameless = (
        hashes.filter(F.col("id").isNull())
        .select(F.explode(F.array_distinct("lines")).alias("line"))
        .filter(F.col("line").isNotNull())
        .groupBy("line.a", "line.b")
        .agg(F.count("*").alias("n"))
    )
    shared = landed(
        named.select("a", "b", "n").unionByName(nameless).groupBy("a", "b").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= min_docs).select("a", "b"),
        "shared-lines",
    )
    dropped = found.join(shared, ["a", "b"], "left_semi").groupBy("id", "of").agg(F.collect_set("pos").alias("dropped"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.xxhash64(text).alias("of"),
        F.struct(*(F.col(c) for c in carry)).alias("carry") if carry else F.lit(None).alias("carry"),
    )
    met = rows.alias("r").join(
        dropped.alias("d"), F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.of") == F.col("d.of")), "left"
    )
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    return met.select(
        F.col("r.id").alias(id_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
        .alias("kept_text"),
        *(F.col(f"carry.{c}").alias(c) for c in carry),
    )
