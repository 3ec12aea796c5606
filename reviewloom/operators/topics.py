"""Topics of each branch's reviews, and their shares.

A topic gathers the reviews that share a characteristic term (frequent-term
clustering): every step is a count or a choice per key, so the work grows with
the number of words and never with the number of review pairs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.bags import flat, frequencies, unpacked, unzipped
from reviewloom.operators.terms import default_stop_words, keyword_lists, term_counts, topic_terms
from reviewloom.operators.upsert import assign_ids
from reviewloom.session import BROADCAST_ROW_LIMIT, broadcast_if_small, land

OUTLIER = -1
# Counts of reviews that a task scores at one time.
STRIP = 1 << 21


@dataclass(frozen=True)
class TopicSettings:
    """Parameters of a topic run; they are stored with it."""

    min_topic_size: int = 5
    ngram_max: int = 2
    min_share: float = 0.0  # a term must occur in this share of the branch's reviews …
    max_share: float = 1.0  # … and in no more than this share; idf weighs common terms down as it is
    stop_words: tuple[str, ...] | None = None

    def words(self) -> Sequence[str]:
        return default_stop_words() if self.stop_words is None else self.stop_words


def settings_json(settings: TopicSettings) -> Column:
    """All settings as one JSON object; stop words are ``"english"`` or the list in use."""
    values = {
        "min_topic_size": settings.min_topic_size,
        "ngram_range": [1, settings.ngram_max],
        "min_share": settings.min_share,
        "max_share": settings.max_share,
        "stop_words": "english" if settings.stop_words is None else list(settings.stop_words),
    }
    return F.lit(json.dumps(values, separators=(",", ":"), ensure_ascii=False))


def assign_topics(
    reviews: DataFrame, settings: TopicSettings = TopicSettings(), text_col: str = "normalized_text", counted: DataFrame | None = None
) -> DataFrame:
    """``branch_id, review_id, topic, anchor`` for every review.

    1. Terms found in at least ``min_topic_size`` reviews of the branch (and
       not in too many) are candidates.
    2. Each review takes its candidate with the highest ``tf * ln(N / df)``.
    3. Candidates taken by fewer than ``min_topic_size`` reviews are dropped and
       their reviews choose again among the others, which can only grow.
    4. Topics are numbered from 0 by size; reviews without one get -1.
    """
    keys = ["branch_id", "review_id"]
    # texts are taken apart in one job, unless the caller has done so; everything after it reads the written counts
    if counted is None:
        counted = term_counts(reviews, text_col, settings.words(), settings.ngram_max)
    sizes = land(reviews.groupBy("branch_id").agg(F.count("*").alias("n")), "topic-sizes")
    low = F.greatest(F.lit(settings.min_topic_size), F.ceil(F.col("n") * settings.min_share)).cast("long")
    candidates = land(
        frequencies(counted, settings.min_topic_size)
        .join(broadcast_if_small(sizes), "branch_id")
        .withColumns({"low": low, "high": F.col("n") * F.lit(settings.max_share).cast("double")}),
        "topic-candidates",
        "zstd",
    )
    first_choice = _first_choice(counted, candidates)
    kept = (
        first_choice.groupBy("branch_id", F.col("anchor").alias("term"))
        .agg(F.count("*").alias("size"))
        .filter(F.col("size") >= settings.min_topic_size)
        .groupBy("branch_id").agg(F.collect_list("term").alias("kept"))
    )
    again = candidates.select("shard", "branch_id").distinct().join(kept, "branch_id").select("shard", "kept")
    chosen = land(_choose(counted, candidates.unionByName(again, allowMissingColumns=True)), "term-counts-chosen")
    numbered = number_topics(chosen.groupBy("branch_id", "anchor").agg(F.count("*").alias("size")))
    return (
        reviews.select(*keys)
        .join(chosen, keys, "left")
        .join(numbered, ["branch_id", "anchor"], "left")
        .select(*keys, F.coalesce("topic", F.lit(OUTLIER)).alias("topic"), "anchor")
    )


def _first_choice(counted: DataFrame, candidates: DataFrame, limit: int = STRIP) -> DataFrame:
    """The candidate each review takes out of all of them."""
    return _choose(counted, candidates.withColumn("kept", F.lit(None).cast("array<string>")), limit, every=True)


def _choose(counted: DataFrame, candidates: DataFrame, limit: int = STRIP, every: bool = False) -> DataFrame:
    """``branch_id, review_id, anchor``: the candidate with the highest score, of equal ones the last.

    Shards meet the rows of their candidates; of these, unless ``every`` one
    counts, only those ``kept`` by another row of the shard do.  So many counts
    are scored at a time.
    """
    kind = dict(counted.dtypes)
    reviews = counted.filter("bucket IS NULL").select("shard", "branch_id", "review_id", "codes", "tfs")

    def choose(own: pa.Table, met: pa.Table) -> pa.Table:
        given = met.filter(pc.is_valid(met["dfs"]))
        terms, begins = unzipped(given["terms"])
        codes, dfs = unpacked(given["codes"], rising=True)[0], unpacked(given["dfs"])[0]
        n, low, high = (np.repeat(given[c].to_numpy(), np.diff(begins)) for c in ("n", "low", "high"))
        good = (dfs >= low) & (dfs <= high)
        if not every:
            good &= pc.is_in(terms, value_set=flat(met["kept"])[0]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(good)
        (mine, starts), tfs = unpacked(own["codes"], rising=True), unpacked(own["tfs"])[0]
        size = max(mine.max(initial=-1), codes.max(initial=-1)) + 1
        place, idf = np.full(size, -1, np.int64), np.zeros(size)
        ratios, which = np.unique(n[at] / dfs[at], return_inverse=True)
        place[codes[at]] = at
        idf[codes[at]] = np.array([math.log(r) for r in ratios])[which]
        rows, anchors = [], []
        first = 0
        while first < own.num_rows:
            end = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
            here = np.arange(starts[first], starts[end])
            here = here[place[mine[here]] >= 0]
            if len(here):
                of, code = np.searchsorted(starts, here, "right") - 1, mine[here]
                begin = np.flatnonzero(np.diff(of, prepend=-1) != 0)
                score = tfs[here] * idf[code]
                best = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, begin), np.diff(np.append(begin, len(of)))))
                # of equal scores the last term counts; few terms have to be put in order for that
                equal, named = np.unique(place[code[best]], return_inverse=True)
                rank = np.empty(len(equal), np.int64)
                rank[pc.sort_indices(terms.take(pa.array(equal))).to_numpy()] = np.arange(len(equal))
                by_rank = best[np.lexsort((rank[named], of[best]))]
                last = by_rank[np.flatnonzero(np.diff(of[by_rank], append=-1) != 0)]
                rows.append(of[last])
                anchors.append(place[code[last]])
            first = end
        row, anchor = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, anchors))
        return pa.table({c: own[c].take(pa.array(row)) for c in ("branch_id", "review_id")} | {"anchor": terms.take(pa.array(anchor))})

    return reviews.groupBy("shard").cogroup(candidates.groupBy("shard")).applyInArrow(
        choose, f"branch_id {kind['branch_id']}, review_id {kind['review_id']}, anchor string"
    )


def number_topics(sizes: DataFrame) -> DataFrame:
    """Topics of each branch numbered from 0, the largest first.

    All topics are numbered in one distributed sort; a branch's numbers follow
    each other in it, so only the first of each has to be known.
    """
    ranked = assign_ids(sizes, ["branch_id", F.desc("size"), "anchor"], "_rank")
    first = ranked.groupBy(F.col("branch_id").alias("_branch")).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, F.col("branch_id").eqNullSafe(F.col("_branch"))).select(
        "branch_id", "anchor", (F.col("_rank") - F.col("_first")).cast("int").alias("topic")
    )


def all_outliers(reviews: DataFrame) -> DataFrame:
    """Assignment used when topic modelling is off or has failed."""
    return reviews.select(
        "branch_id", "review_id", F.lit(OUTLIER).alias("topic"), F.lit(None).cast("string").alias("anchor")
    )


def topic_shares(topics: DataFrame, group: str = "branch_id", topic_col: str = "topic") -> DataFrame:
    """Size and percentage of each topic among the reviews that have one."""
    counts = topics.filter(F.col(topic_col) != OUTLIER).groupBy(group, topic_col).agg(F.count("*").alias("size"))
    total = F.sum("size").over(Window.partitionBy(group))
    return counts.withColumn("percentage", percentage(F.col("size"), total))


def topics_by_size(topics: DataFrame, group: str = "branch_id", topic_col: str = "topic") -> DataFrame:
    """:func:`topic_shares` in order: branch by branch, the largest topic first."""
    return topic_shares(topics, group, topic_col).orderBy(group, F.desc("size"), topic_col)


def percentage(part: Column, total: Column) -> Column:
    """Exact decimal percentage with two places."""
    exact = part.cast("decimal(18,0)") * 100 / total.cast("decimal(18,0)")
    return F.round(exact, 2).cast("decimal(5,2)")


def topic_overview(topics: DataFrame, settings: TopicSettings = TopicSettings(), text_col: str = "normalized_text") -> DataFrame:
    """Size and keywords of every topic, outliers included."""
    keys = ["branch_id", "topic"]
    words = topic_terms(topics, text_col, stop_words=settings.words(), ngram_max=settings.ngram_max)
    sizes = topics.groupBy(*keys).agg(F.count("*").alias("size"))
    return sizes.join(keyword_lists(words, keys), keys, "left")


def overview_head(overview: DataFrame, n: int = 5) -> DataFrame:
    """The first topics of an overview, by size over all branches."""
    return overview.orderBy(F.desc("size"), "branch_id", "topic").limit(n)
