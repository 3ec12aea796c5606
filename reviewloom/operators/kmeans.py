"""Topics by bisecting k-means, fitted for every branch in the same jobs.

Centroids and splits are small tables keyed by branch and cluster; a review's
vector is one row that carries its cluster.  A round splits the loosest clusters
of all branches that still want topics; the loops on the driver run over rounds
and steps, never over branches.  A step is one pass over the rows, which meet the
centroids where they lie: only sums per cluster and place are shuffled.

All arithmetic is on whole numbers (weights in millionths of 2 ** 20, centroids
rounded), so results do not depend on the order in which Spark adds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.terms import with_terms
from reviewloom.operators.topics import OUTLIER, TopicSettings, number_topics
from reviewloom.session import broadcast_if_small, land

ONE = 1 << 20


@dataclass(frozen=True)
class KMeansSettings(TopicSettings):
    """Parameters of a run by k-means: topics wanted per branch, width of the hashed vectors, most steps of a split."""

    ngram_max: int = 1
    topics: int = 8
    width: int = 64
    steps: int = 10


def hashed_vectors(reviews: DataFrame, settings: KMeansSettings, text_col: str = "normalized_text") -> DataFrame:
    """``branch_id, review_id, dim, x``: log counts of terms hashed to ``width`` places, scaled to length 1, in 2 ** -20.

    Reviews without a term, or without a branch, have no rows.
    """
    key = ["branch_id", "review_id"]
    dim = F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("long") % settings.width
    # texts go to their reviews' places once; terms are counted and scaled there
    dealt = reviews.filter(F.col("branch_id").isNotNull()).select(*key, text_col).repartition(*key)
    counts = (
        with_terms(dealt, text_col, settings.words(), settings.ngram_max)
        .groupBy(*key, dim.alias("dim")).agg(F.count("*").alias("n"))
    )
    weight = F.log1p("n")
    length = F.sqrt(F.sum(weight**2).over(Window.partitionBy(*key)))
    return counts.select(*key, "dim", F.round(weight / length * ONE).cast("long").alias("x"))


def _means(rows: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """``by, size, c, cc``: reviews and rounded centroid of every cluster, as ``width`` numbers, and its squared length."""
    # the size is the sum of a one in a place of its own, the last
    sums = rows.select(*by, F.posexplode(F.array_append("v", F.lit(1).cast("long"))).alias("dim", "x")).filter("x <> 0").groupBy(*by, "dim").agg(F.sum("x").alias("sum"))
    size = F.max(F.when(F.col("dim") == width, F.col("sum")))
    held = sums.groupBy(*by).agg(size.alias("size"), F.collect_list(F.when(F.col("dim") < width, F.struct("dim", "sum"))).alias("sums"))
    means = F.transform("sums", lambda s: F.struct(s["dim"].cast("long").alias("dim"), F.round(s["sum"] / F.col("size")).cast("long").alias("x")))
    return held.select(*by, "size", _dense(means, width).alias("c")).withColumn("cc", F.aggregate("c", _zero(), lambda a, x: a + x * x))


def _zero() -> Column:
    return F.lit(0).cast("long")


def _dense(pairs: Column, width: int) -> Column:
    """``width`` numbers of an array of ``dim, x``, zero where there is none."""
    found = F.map_from_entries(pairs)
    return F.transform(F.sequence(_zero(), F.lit(width - 1).cast("long")), lambda d: F.coalesce(F.try_element_at(found, d), _zero()))


def _dot(v: Column, c: Column) -> Column:
    """Whole-number products of two columns of equally many numbers."""

    def dot(v: pa.Array, c: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.int64())
        a, b = (x.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for x in (v, c))
        return pa.array(np.einsum("ij,ij->i", a, b), pa.int64())

    dot.__annotations__ = dict.fromkeys(("v", "c", "return"), pa.Array)
    return F.arrow_udf(dot, "long")(v, c)


def _distances(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``branch_id, review_id, cluster, distance`` of the reviews in clusters with a centre: the squared distance to it."""
    met = rows.join(broadcast_if_small(centres.select("branch_id", "cluster", "c", "cc")), ["branch_id", "cluster"])
    far = F.col("xx") - 2 * _dot(F.col("v"), F.col("c")) + F.col("cc")
    return met.select("branch_id", "review_id", "cluster", far.alias("distance"))


def _farthest() -> Column:
    """The farthest review; of equal ones the smallest."""
    return (-F.max(F.struct("distance", (-F.col("review_id")).alias("minus")))["minus"]).alias("review_id")


def _points(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """``branch_id, cluster, c, cc``: the vectors of the reviews that clusters name."""
    met = rows.join(broadcast_if_small(seeds.select("branch_id", "cluster", "review_id")), ["branch_id", "cluster", "review_id"])
    return met.select("branch_id", "cluster", F.col("v").alias("c"), F.col("xx").alias("cc"))


def _pairs(centroids: DataFrame) -> DataFrame:
    """``branch_id, cluster, only, gap, bar``: what tells the side of a review, by two centroids or the only one."""
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    both = centroids.groupBy("branch_id", "cluster").agg(
        F.when(F.count("*") == 1, F.max("side")).alias("only"), (side(0, "cc") - side(1, "cc")).alias("bar"),
        F.max(F.when(F.col("side") == 0, F.col("c"))).alias("c0"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("c1"),
    )
    return both.select("branch_id", "cluster", "only", F.zip_with("c0", "c1", lambda a, b: a - b).alias("gap"), "bar")


def _sided(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The reviews of the clusters in ``pairs`` with the side of their nearer centroid; of equal ones the smaller."""
    met = rows.join(broadcast_if_small(pairs), ["branch_id", "cluster"])
    side = F.when(F.col("only").isNotNull(), F.col("only")).when(F.col("bar") <= 2 * _dot(F.col("v"), F.coalesce("gap", "v")), 0).otherwise(1)
    return met.select(*rows.columns, side.alias("side"))


def _split(rows: DataFrame, first: DataFrame, settings: KMeansSettings) -> tuple[DataFrame, DataFrame]:
    """The last centroids of Lloyd's steps for every cluster of ``first`` at once, and the sizes of their sides.

    ``first`` names the first seed, the review farthest from the cluster's
    centroid; the second is the one farthest from the first.  The steps end when
    no centroid moves, since no review does then.
    """
    by = ["branch_id", "cluster"]
    one = land(_points(rows, first), "seeds")
    second = land(_distances(rows, one).groupBy(*by).agg(_farthest()), "seeds")
    two = _points(rows, second)
    now = land(one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1))), "centroids")
    for step in range(settings.steps + 1):
        pairs = land(_pairs(now), "sides")
        after = land(_means(_sided(rows, pairs), [*by, "side"], settings.width), "centroids")
        # the sizes of the sides by the centroids of the last step take one more pass
        if step == settings.steps or after.select(*by, "side", "c").exceptAll(now.select(*by, "side", "c")).isEmpty():
            break
        now = after
    return pairs, after.select(*by, "side", "size")


def bisect(vectors: DataFrame, settings: KMeansSettings) -> DataFrame:
    """``branch_id, review_id, cluster``: the leaves of the bisections, as paths of 0 and 1 below ``r``.

    A branch is split until it has ``topics`` leaves or none can be split: both
    sides must hold ``min_topic_size`` reviews.  In a round its loosest leaves,
    by the sum of squared distances, go first, as many as topics are missing.
    Reviews without an id have no leaf.
    """
    by = ["branch_id", "cluster"]
    packed = vectors.filter(F.col("review_id").isNotNull()).groupBy("branch_id", "review_id").agg(
        _dense(F.collect_list(F.struct("dim", "x")), settings.width).alias("v"), F.sum(F.col("x") * F.col("x")).alias("xx")
    )
    rows = land(packed.withColumn("cluster", F.lit("r")), "kmeans-vectors", "zstd")
    closed = None
    while True:
        leaves = F.count("*").over(Window.partitionBy("branch_id"))
        centres = land(_means(rows, by, settings.width).withColumn("missing", settings.topics - leaves), "centres")
        open_ = centres.filter((F.col("missing") > 0) & (F.col("size") >= 2 * settings.min_topic_size))
        if closed is not None:
            open_ = open_.join(closed, by, "left_anti")
        open_ = land(open_, "centres")
        if open_.isEmpty():
            return rows.select("branch_id", "review_id", "cluster")
        spread = _distances(rows, open_).groupBy(*by).agg(F.sum(F.col("distance") / ONE).alias("sse"), _farthest())
        # a handful of leaves per branch
        loosest = Window.partitionBy("branch_id").orderBy(F.desc(F.round("sse")), "cluster")
        placed = land(spread.join(open_.select(*by, "missing"), by).withColumn("place", F.row_number().over(loosest)), "spread")
        chosen = placed.filter(F.col("place") <= F.col("missing"))
        pairs, sizes = _split(rows, chosen, settings)
        large = sizes.filter(F.col("size") >= settings.min_topic_size).groupBy(*by).agg((F.count("*") == 2).alias("good"))
        judged = land(chosen.select(*by).join(large, by, "left").select(*by, F.coalesce("good", F.lit(False)).alias("good")), "judged")
        final = judged.filter(~F.col("good")).select(*by)
        closed = final if closed is None else land(closed.unionByName(final), "closed")
        good = land(pairs.join(judged.filter("good").select(*by), by), "sides")
        sides = rows.join(broadcast_if_small(good), by, "left")
        side = F.when(F.col("bar") <= 2 * _dot(F.col("v"), F.coalesce("gap", "v")), "0").otherwise("1")
        path = F.concat("cluster", F.when(F.col("gap").isNull(), "").otherwise(side))
        rows = land(sides.select("branch_id", "review_id", "v", "xx", path.alias("cluster")), "kmeans-vectors", "zstd")


def kmeans_topics(
    reviews: DataFrame, settings: KMeansSettings = KMeansSettings(), text_col: str = "normalized_text"
) -> DataFrame:
    """``branch_id, review_id, topic, anchor`` for every review; ``anchor`` is the leaf's path.

    Topics are numbered from 0 by size; reviews without a term or a branch, and
    leaves with fewer than ``min_topic_size`` reviews, get -1.
    """
    key = ["branch_id", "review_id"]
    found = bisect(hashed_vectors(reviews, settings, text_col), settings).withColumnRenamed("cluster", "anchor")
    sizes = found.groupBy("branch_id", "anchor").agg(F.count("*").alias("size")).filter(F.col("size") >= settings.min_topic_size)
    topics = found.join(number_topics(sizes), ["branch_id", "anchor"])
    return reviews.select(*key).join(topics.select(*key, "topic", "anchor"), key, "left").select(
        *key, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"), "anchor"
    )
