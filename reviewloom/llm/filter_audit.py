"""How quality filters interact: what each removes, in every order, counted from a sparse document-term matrix.

Every task turns its texts into shards of the matrix in CSR form, with word
numbers of its own.  The shards' words are encoded globally: a bucket of the
dictionary numbers the words of its hash range once for all shards.  The shards
take over the global numbers, and the sums and the nonzero counts of their rows
decide the word filters; the other filters come from the text's bytes and digest.
What is left of the documents is one count for each part and set of failed
filters, from which all orders follow.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import ceil_div, landed, sliced

FILTERS = "ABCDE"
# Characters that fail filter D, and the limits of A, B and C.
SPECIAL = b"#$%&*|"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 100, 80, 10
# Words and texts of a shard, and words of all shards that one task numbers.
SHARD_WORDS, SHARD_TEXTS, BUCKET_WORDS = 1 << 20, 1 << 14, 2 << 20


class _Shard:
    """Rows of the matrix, with word numbers in order of first appearance."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.words: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.n = 0

    def add(self, doc_id, part: str | None, text: str | None) -> None:
        data = (text or "").encode()
        words = data.split()
        self.words.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.n += len(words)
        seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        upper, chars = int(seen[65:91].sum()), len(data) - int(seen[128:192].sum())
        self.rows.append(
            (
                doc_id, part, 100 * upper > MAX_UPPER_PERCENT * chars, bool(seen[list(SPECIAL)].any()),
                hashlib.blake2b(data, digest_size=16).digest(),
            )
        )

    def csr(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row borders, steps between the ascending word numbers of a row, and counts, in narrow types."""
        lengths = [len(w) for w in self.words]
        cells = np.sort((np.repeat(np.arange(len(lengths)), lengths) << 32) + np.concatenate(self.words))
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(cells)))
        borders = np.searchsorted(cells[first] >> 32, np.arange(len(lengths) + 1))
        words = cells[first] & 0xFFFFFFFF
        steps = np.diff(words, prepend=0)
        starts = borders[:-1][np.diff(borders) > 0]
        steps[starts] = words[starts]
        # most steps are 1, to the word that is new in the shard, so that they compress well
        return borders.astype(np.int32), steps.astype(np.uint32), counts.astype(np.min_scalar_type(counts.max(initial=0)))


def local_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The matrix as written shards whose words are numbered within the shard only.

    One row per shard: its number, its documents with what their bytes decide,
    ``borders``, ``words`` and ``counts`` of the CSR form, and its vocabulary
    with a hash for each word.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(part_col).cast("string").alias("part"), F.col(text_col).cast("string").alias("text"))
    schema = (
        f"shard long, docs array<struct<id:{kind},part:string,c:boolean,d:boolean,digest:binary>>, "
        "borders binary, words binary, counts binary, vocabulary array<binary>, hashes binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, doc_type = TaskContext.get().partitionId() << 32, _Shard(), None
        for batch in batches:
            doc_type = pa.struct([("id", batch.schema.field("id").type), ("part", pa.string()), ("c", pa.bool_()), ("d", pa.bool_()), ("digest", pa.binary())])
            for columns in sliced([batch], ["id", "part", "text"]):
                for row in zip(*columns):
                    shard.add(*row)
                    if shard.n >= SHARD_WORDS or len(shard.rows) >= SHARD_TEXTS:
                        yield out(number, shard, doc_type)
                        number, shard = number + 1, _Shard()
        if shard.rows:
            yield out(number, shard, doc_type)

    def out(number: int, shard: _Shard, doc_type: pa.DataType) -> pa.RecordBatch:
        names = [f.name for f in doc_type]
        vocabulary = list(shard.ids)
        hashes = np.fromiter(map(zlib.crc32, vocabulary), np.uint32, len(vocabulary))
        columns = [
            pa.array([number]),
            pa.array([[dict(zip(names, r)) for r in shard.rows]], pa.list_(doc_type)),
            *(pa.array([a.tobytes()], pa.binary()) for a in shard.csr()),
            pa.array([vocabulary], pa.list_(pa.binary())),
            pa.array([hashes.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "docs", "borders", "words", "counts", "vocabulary", "hashes"])

    return landed(rows.mapInArrow(run, schema), "term-shards")


def _by_bucket(hashes: bytes, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's words in the order of the dictionary's buckets, and where each bucket begins."""
    bucket = np.frombuffer(hashes, np.uint32) % np.uint32(n_buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def dictionary(shards: DataFrame) -> tuple[DataFrame, int]:
    """``(shard, bucket, ids)``: global numbers of the shards' words, and the number of buckets.

    A word's number is its rank of first appearance in its bucket times the
    number of buckets, plus the bucket.
    """
    total = shards.agg(F.sum(F.octet_length("hashes") / 4)).first()[0] or 0
    n_buckets = max(1, ceil_div(int(total), BUCKET_WORDS))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                order, edges = _by_bucket(batch.column("hashes")[at].as_py(), n_buckets)
                words = batch.column("vocabulary")[at].values
                columns = [
                    pa.array(range(n_buckets), pa.int32()),
                    pa.array([batch.column("shard")[at].as_py()] * n_buckets, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words.take(pa.array(order))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "words"])

    def number(table: pa.Table) -> pa.Table:
        lists = table.column("words").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bucket = table.column("bucket")[0].as_py()
        ranks = pc.dictionary_encode(lists.flatten()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.split(ranks * n_buckets + bucket, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1])
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "ids": pa.array([p.tobytes() for p in parts], pa.binary())})

    found = (
        shards.select("shard", "vocabulary", "hashes").mapInArrow(pieces, "bucket int, shard long, words array<binary>")
        .groupBy("bucket").applyInArrow(number, "shard long, bucket int, ids binary")
    )
    return found, n_buckets


def _global(row: dict, known: pa.Table, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's CSR form with the dictionary's word numbers."""
    order, edges = _by_bucket(row["hashes"], n_buckets)
    ids = np.empty(len(order), np.int64)
    for bucket, data in zip(known.column("bucket").to_pylist(), known.column("ids").to_pylist()):
        ids[order[edges[bucket] : edges[bucket + 1]]] = np.frombuffer(data, np.int64)
    borders, steps = np.frombuffer(row["borders"], np.int32), np.frombuffer(row["words"], np.uint32).astype(np.int64)
    width = len(row["counts"]) // max(1, len(steps))
    sums = np.cumsum(steps)
    rows = np.repeat(np.append(0, sums)[borders[:-1]], np.diff(borders))
    return borders, ids[sums - rows], np.frombuffer(row["counts"], f"u{max(1, width)}").astype(np.int32)


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[borders])


def matrix(shards: DataFrame) -> DataFrame:
    """The shards with global word numbers: ``shard, doc_ids, borders, words, counts`` (arrays)."""
    kind = shards.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    ids, n_buckets = dictionary(shards)

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = [_global(row, known, n_buckets) for row in rows]
        columns = [pa.array([f[i] for f in found], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32()))]
        return pa.table([table.column("shard"), table.column("doc_ids"), *columns], ["shard", "doc_ids", "borders", "words", "counts"])

    local = shards.select("shard", F.col("docs.id").alias("doc_ids"), "borders", "words", "counts", "hashes")
    return local.groupBy("shard").cogroup(ids.groupBy("shard")).applyInArrow(
        run, f"shard long, doc_ids array<{kind}>, borders array<int>, words array<bigint>, counts array<int>"
    )


def measures(shards: DataFrame) -> DataFrame:
    """``(id, part, n_words, n_distinct, c, d, digest)`` of every document, words counted in the global matrix."""
    kind = shards.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    ids, n_buckets = dictionary(shards)

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        tables = []
        for at in range(table.num_rows):
            row = {c: table.column(c)[at].as_py() for c in ("borders", "words", "counts", "hashes")}
            borders, words, counts = _global(row, known, n_buckets)
            # cells of one word in one row: in ascending order they differ from the cell before
            rows = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
            order = np.lexsort((words, rows))
            nonzero = np.append(True, (np.diff(words[order]) != 0) | (np.diff(rows[order]) != 0))[: len(words)]
            docs = table.column("docs")[at].values
            tables.append(
                pa.table(
                    [docs.field("id"), docs.field("part"), pa.array(_sums(counts, borders)), pa.array(_sums(nonzero, borders)), *(docs.field(c) for c in ("c", "d", "digest"))],
                    ["id", "part", "n_words", "n_distinct", "c", "d", "digest"],
                )
            )
        return pa.concat_tables(tables)

    local = shards.select("shard", "docs", "borders", "words", "counts", "hashes")
    return local.groupBy("shard").cogroup(ids.groupBy("shard")).applyInArrow(
        run, f"id {kind}, part string, n_words long, n_distinct long, c boolean, d boolean, digest binary"
    )


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, failed)`` of every document; bit k of ``failed`` stands for the k-th letter of ``FILTERS``.

    A: fewer than 100 words.  B: fewer than 80 % of the words are distinct.  C:
    more than 10 % of the characters are capitals A-Z.  D: one of ``#$%&*|``.
    E: the whole text is that of a document with a smaller id.

    A null text is an empty one and a null part the empty string.  A document
    without an id is never a copy, nor does it make others copies; rows that
    share id and text are no copies of each other.  An empty table gives an
    empty result.  Texts are taken whole, and other columns are not read.
    """
    rows = landed(measures(local_shards(docs, id_col, text_col, part_col)), "measures")
    copies = landed(
        rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"),
        "copies",
    )
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    tests = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
        F.col("c"), F.col("d"), copy,
    ]
    bits = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return rows.join(copies, "digest", "left").select("id", F.coalesce("part", F.lit("")).alias("part"), bits.alias("failed"))


def audit(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What every filter removes at every step of every order, per part.

    ``failed`` is that of ``failed_filters``; ``labels`` holds ``quality`` and
    ``toxic`` per id, and an id with several rows counts as good or toxic when
    one of them says so.  Returns ``part``, ``filter_order``, ``step`` and the
    counts ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost`` and ``shapley``, 600 rows per part, zeros included.

    Documents are counted by part, failed filters and labels first, so the 120
    orders are worked out on at most 128 rows per part.
    """
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    counted = (
        failed.join(landed(told, "labels"), "id", "left")
        .groupBy("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        .agg(F.count("*").alias("n"))
    )
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = F.array(*(
        F.struct(
            F.lit(order).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << FILTERS.index(letter)).alias("own"),
            F.lit(sum(1 << FILTERS.index(x) for x in order[:k])).alias("earlier"),
        )
        for order in orders for k, letter in enumerate(order)
    ))
    cells = landed(counted, "cells").select("*", F.explode(steps).alias("at")).select("part", "failed", "good", "toxic", "n", "at.*")
    fails = F.col("failed").bitwiseAND(F.col("own")) != 0
    gone = F.col("failed").bitwiseAND(F.col("earlier")) != 0
    removed = fails & ~gone

    def count(condition, name):
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    found = cells.groupBy("part", "filter_order", "step", "own").agg(
        count(~gone & ~fails, "kept"), count(removed, "removed"), count(fails & gone, "redundant"),
        count(F.col("failed") == F.col("own"), "unique_fails"), count(removed & (F.col("good") == 1), "good_lost"),
        count(removed & (F.col("toxic") == 1), "toxic_lost"),
    )
    found = landed(found, "steps")
    shares = found.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return found.join(shares, ["part", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
