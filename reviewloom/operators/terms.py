"""Bags of words and the terms that characterise a topic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.operators.bags import bucket_count, coded, flat, grouped, packed, shards, unpacked, unzipped
from reviewloom.operators.dedupe import first_n
from reviewloom.session import broadcast_if_small, land

BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
TOP_TERMS = 10
# Terms are ruled out by bounds where the frequent ones of all topics are at most one in so many.
MOST_FREQUENT = 8


def default_stop_words() -> list[str]:
    """Spark's English list; pass another list wherever one is taken."""
    return StopWordsRemover.loadDefaultStopWords("english")


def read_stop_words(spark: SparkSession, path: str, limit: int = 10_000) -> tuple[str, ...]:
    """A stop list from a text file, one word a line; a longer file than ``limit`` is no stop list."""
    words = [r[0] for r in spark.read.text(path).select(F.lower(F.trim("value"))).limit(limit + 1).collect()]
    if len(words) > limit:
        raise ValueError(f"more than {limit} stop words in {path}")
    return tuple(sorted(set(words) - {""}))


def tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case words of two or more letters or digits, without stop words."""
    words = F.split(F.lower(text), BETWEEN_WORDS)
    if not stop_words:
        return F.filter(words, lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))


def _runs(words: Column, length: int) -> Column:
    """Neighbouring words, ``length`` at a time, joined by blanks."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (length - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, length))))


def with_terms(df: DataFrame, text_col: str, stop_words: Sequence[str], ngram_max: int = 2) -> DataFrame:
    """One row per occurrence of a term; word pairs are formed after stop words are gone."""
    words = df.withColumn("words", tokens(F.col(text_col), stop_words)).drop(text_col)
    kept = [c for c in words.columns if c != "words"]
    terms = F.concat(F.col("words"), *(_runs(F.col("words"), n) for n in range(2, ngram_max + 1)))
    return words.select(*kept, F.explode(terms).alias("term"))


def term_counts(reviews: DataFrame, text_col: str, stop_words: Sequence[str], ngram_max: int = 2) -> DataFrame:
    """Terms of every review and how often it has them, as :mod:`reviewloom.operators.bags` in shards, written once.

    The texts are dealt by ranges of reviews before they are taken apart, in one
    job: a shard holds neighbouring reviews of one branch, whose terms it writes
    once, and later steps read numbers.  Rows with the same branch and review
    are one review.
    """
    keys = ["branch_id", "review_id"]
    dealt = reviews.select(*keys, text_col).repartitionByRange(*keys).sortWithinPartitions(*keys)
    words = dealt.select(*keys, tokens(F.col(text_col), stop_words).alias("words"))
    return land(shards(words, ngram_max, bucket_count(reviews, text_col)), "term-counts", "zstd")


def topic_terms(
    topics: DataFrame,
    text_col: str = "normalized_text",
    group: Sequence[str] = ("branch_id",),
    topic_col: str = "topic",
    stop_words: Sequence[str] = (),
    ngram_max: int = 2,
    top: int = TOP_TERMS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Top terms of each topic by class-based TF-IDF.

    ``weight = tf(t, c) / words(c) * ln(1 + A / f(t))`` with ``A`` the whole
    part of the mean number of term occurrences per topic of the group
    (outliers count as a topic of their own).  Occurrences are counted before
    anything else is shuffled, so later steps see one row per topic and term.
    With ``counted``, the :func:`term_counts` of the same reviews, no text is
    read again; the group is the branch then.
    """
    keys = list(group)
    if counted is not None:
        if keys != ["branch_id"]:
            raise ValueError("term counts are those of branches")
        return _counted_topic_terms(topics, topic_col, top, counted)
    occurrences = with_terms(topics.select(*keys, topic_col, text_col), text_col, stop_words, ngram_max).withColumn("tf", F.lit(1))
    # summed up in one job; the sums per topic and the window across topics read the written counts
    counts = land(occurrences.groupBy(*keys, topic_col, "term").agg(F.sum("tf").alias("tf")), "topic-terms", "zstd")
    named = [*keys, topic_col]
    level = F.floor(F.log2("tf"))
    # a row for each power of two that a topic's counts reach
    levels = land(counts.groupBy(*named, level.alias("level")).agg(F.sum("tf").alias("words"), F.count("*").alias("terms")), "topic-levels")
    per_topic = levels.groupBy(*named).agg(F.sum("words").alias("words"))
    mean_words = per_topic.groupBy(*keys).agg(F.floor(F.avg("words")).alias("mean_words"))
    so_far = Window.partitionBy(*named).orderBy(F.desc("level"))
    least = levels.withColumn("above", F.sum("terms").over(so_far)).filter(F.col("above") >= top).groupBy(*named).agg(F.max("level").alias("least"))
    # few rows: one per topic, with the mean of its group alongside; the counts stay where they are
    sizes = land(per_topic.join(mean_words, keys).join(least, named, "left").withColumn("least", F.coalesce("least", F.lit(0))), "topic-words")
    chosen = F.sum(F.when(F.col("level") >= F.col("least"), F.col("terms")))
    frequent, terms = levels.join(sizes.drop("words"), named).agg(F.coalesce(chosen, F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    sized = counts.join(broadcast_if_small(sizes), named)
    if frequent * MOST_FREQUENT <= terms:
        # its most frequent terms tell what weight the last of a topic's top terms has at least; a term found in
        # no other topic has the greatest weight for its count, so most terms are ruled out without the other topics
        some = _weighed(counts, land(sized.filter(level >= F.col("least")), "topic-frequent"), keys)
        last = _ranked(some, named).filter(F.col("rank") == top).select(*named, F.col("weight").alias("last"))
        bound = broadcast_if_small(land(last, "topic-bounds"))
        open_terms = sized.join(bound, named, "left").filter(F.col("last").isNull() | (_weight(F.col("tf")) >= F.col("last") * (1 - 1e-9)))
        weighed = _weighed(counts, land(open_terms.drop("last"), "topic-open"), keys)
    else:
        across = Window.partitionBy(*keys, "term")
        weighed = counts.withColumn("f", F.sum("tf").over(across)).join(broadcast_if_small(sizes), named).withColumn("weight", _weight(F.col("f")))
    return _ranked(weighed.select(*named, "term", "tf", "weight"), named).filter(F.col("rank") <= top)


def _counted_topic_terms(topics: DataFrame, topic_col: str, top: int, counted: DataFrame) -> DataFrame:
    """:func:`topic_terms` of branches, from the shards of their term counts.

    A shard sums up its reviews per topic and deals the sums into the buckets of
    their terms.  A bucket knows all counts of its terms: it hands on those that
    may be among a topic's top terms, a few per topic, with their weight's ``f``.
    """
    named, keys = ["branch_id", topic_col], ["branch_id", "review_id"]
    kind = dict(topics.dtypes)
    placed = broadcast_if_small(topics.select(*keys, topic_col))
    reviews = counted.filter("bucket IS NULL").select("shard", *keys, "codes", "tfs", "words").join(placed, keys)
    per_topic = land(reviews.groupBy(*named).agg(F.sum("words").alias("words")), "topic-words")
    mean_words = per_topic.groupBy("branch_id").agg(F.floor(F.avg("words")).alias("mean_words"))
    sizes = land(per_topic.join(mean_words, "branch_id"), "topic-words")
    places = counted.filter("bucket IS NOT NULL").select(F.col("shard").alias("of"), "bucket", "first")

    def summed(own: pa.Table, buckets: pa.Table) -> pa.Table:
        # the topics of a shard, as rows of ``own`` that have them
        topic, n = coded(own[topic_col]), own.num_rows
        example = np.zeros(topic.max() + 1 if n else 0, np.int64)
        example[topic] = np.arange(n)
        (codes, begins), (tfs, _) = unpacked(own["codes"], rising=True), unpacked(own["tfs"])
        order = np.argsort(buckets["first"].to_numpy())
        bucket, first = buckets["bucket"].to_numpy()[order], buckets["first"].to_numpy()[order]
        width = len(example)
        key = codes * max(width, 1) + np.repeat(topic, np.diff(begins))
        order, firsts, _ = grouped(key)
        sums = np.add.reduceat(tfs[order], firsts) if len(order) else np.zeros(0, np.int64)
        code, which = np.divmod(key[order[firsts]], max(width, 1))
        ends = np.searchsorted(code, np.append(first, np.iinfo(np.int64).max))
        topics_of = own[topic_col].combine_chunks().take(pa.array(example[which]))
        held = np.flatnonzero(np.diff(ends) > 0)
        return pa.table({
            "shard": pa.array(np.full(len(bucket), buckets["of"][0].as_py() if len(bucket) else 0, np.int64)), "bucket": pa.array(bucket), "codes": packed(code, ends, rising=True),
            "topics": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), topics_of), "tfs": packed(sums, ends),
        }).take(pa.array(held))

    dealt = reviews.select("shard", topic_col, "codes", "tfs").groupBy("shard").cogroup(places.groupBy("of")).applyInArrow(
        summed, f"shard long, bucket int, codes binary, topics array<{kind[topic_col]}>, tfs binary"
    )
    # the mean of its branch stands beside a shard's terms
    terms = counted.filter("bucket IS NOT NULL").select("bucket", "shard", "branch_id", "first", "terms")
    terms = terms.join(broadcast_if_small(land(mean_words, "topic-means")), "branch_id")

    def weighed(words: pa.Table, sums: pa.Table) -> pa.Table:
        texts, begins = unzipped(words["terms"])
        encoded = texts.dictionary_encode()
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        names = encoded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[encoded.indices.to_numpy()]
        branch_of_row = coded(words["branch_id"])
        row_of = {shard: k for k, shard in enumerate(words["shard"].to_pylist())}
        rows = [row_of.get(shard, -1) for shard in sums["shard"].to_pylist()]
        known = np.flatnonzero(np.array(rows, np.int64) >= 0)
        sums, rows = sums.take(pa.array(known)), np.array(rows, np.int64)[known]
        (codes, ends), (tfs, _) = unpacked(sums["codes"], rising=True), unpacked(sums["tfs"])
        found = flat(sums["topics"])[0]
        row = np.repeat(rows, np.diff(ends))
        term = place[codes - words["first"].to_numpy()[row] + begins[:-1][row]]
        branch = branch_of_row[row]
        pair = coded(found)
        # one row for each branch, topic and term
        owner = grouped(branch * (pair.max(initial=0) + 1) + pair)[2]
        order, firsts, _ = grouped(owner * max(len(names), 1) + term)
        one = order[firsts]
        tf = np.add.reduceat(tfs[order], firsts) if len(order) else np.zeros(0, np.int64)
        owner, term, row, branch = owner[one], term[one], row[one], branch[one]
        whole = grouped(branch * max(len(names), 1) + term)[2]
        f = np.bincount(whole, tf)[whole] if len(one) else np.zeros(0)
        mean = words["mean_words"].to_numpy()[row]
        # a topic's words weigh the same for all its terms
        weight = tf * np.log1p(mean / f)
        order = np.lexsort((term, f, tf, -weight, owner))
        last = np.flatnonzero(np.diff(owner[order], append=-1) != 0)
        first = np.concatenate(([0], last[:-1] + 1)) if len(last) else np.zeros(0, np.int64)
        least = weight[order][np.minimum(first + top - 1, last)] * (1 - 1e-9)
        topic = np.repeat(np.arange(len(first)), last - first + 1)
        same = np.zeros(len(order), bool)
        same[1:] = (np.diff(owner[order]) == 0) & (np.diff(tf[order]) == 0) & (np.diff(f[order]) == 0)
        starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        kept = order[(weight[order] >= least[topic]) & (np.arange(len(order)) - starts < top)]
        return pa.table({
            "branch_id": words["branch_id"].combine_chunks().take(pa.array(row[kept])), topic_col: found.take(pa.array(one[kept])), "term": names.take(pa.array(term[kept])),
            "tf": pa.array(tf[kept]), "f": pa.array(f[kept].astype(np.int64)),
        })

    some = terms.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(
        weighed, f"branch_id {kind['branch_id']}, {topic_col} {kind[topic_col]}, term string, tf long, f long"
    )
    return _ranked(
        land(some, "topic-terms", "zstd").join(broadcast_if_small(sizes), named).withColumn("weight", _weight(F.col("f"))).select(*named, "term", "tf", "weight"), named
    ).filter(F.col("rank") <= top)


def _weight(f: Column) -> Column:
    return F.col("tf") / F.col("words") * F.log(1 + F.col("mean_words") / f)


def _weighed(counts: DataFrame, some: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``some`` of the counts with the weights that all counts give them."""
    wanted = broadcast_if_small(land(some.select(*keys, "term").distinct(), "topic-wanted"))
    across = counts.join(wanted, [*keys, "term"], "left_semi").groupBy(*keys, "term").agg(F.sum("tf").alias("f"))
    return some.join(across, [*keys, "term"]).withColumn("weight", _weight(F.col("f")))


def _ranked(weighed: DataFrame, named: Sequence[str]) -> DataFrame:
    return weighed.withColumn("rank", F.row_number().over(Window.partitionBy(*named).orderBy(F.desc("weight"), "term")))


def keyword_lists(terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``top_keywords``: the ranked terms of each topic as one comma-separated string."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return terms.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda t: t["term"]), ", ").alias("top_keywords"))


def first_texts(topics: DataFrame, keys: Sequence[str], text_col: str, order: str = "review_id", n: int = 20) -> DataFrame:
    """The first ``n`` texts of each topic as an array (at most ``n`` rows per key are collected)."""
    first = first_n(topics.select(*keys, order, text_col), keys, [order], n)
    ordered = F.array_sort(F.collect_list(F.struct(order, text_col)))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda t: t[text_col]).alias("samples"))
