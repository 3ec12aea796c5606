"""Substring de-duplication: passages that occur earlier are cut out, found by suffix trees over prefix groups.

The suffixes of all texts, one per word, are split by variable-length prefixes
into groups of bounded size, and one task builds the suffix tree of a group.
An internal node as deep as ``min_words`` is a repeated passage; its first leaf
in document order stays, all others are cut.

* Documents are dealt into shards of a few megabytes of text.  A shard keeps one
  suffix of those that agree over ``min_words`` words, the earliest, so a passage
  that a third of all documents hold reaches its node once for each shard.
* A suffix that can have no partner elsewhere is left out beforehand: two equal
  windows have the same least eight-word hash, so only suffixes whose least hash
  is found in a second shard are sent.  Nothing that repeats is lost.
* A suffix travels as the path of hashes at a quarter, half and three quarters
  of its depth and a 64-bit hash of all of it, 128 bits in total.
* Prefixes: 1,024 ranges of the first quarter's hash.  Neighbouring light ranges
  share a group, a heavy one is extended by the following words until its parts
  fit; the table of groups has 1,024 rows at any size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import ceil_div
from reviewloom.llm.words import LEAF_BASE, Runs, hashed_words, least_of, mixed

MIN_WORDS = 20
# Words of the hashes whose least one stands for a window, at most half the window.
GRAM_WORDS = 8
# Ranges of the first prefix hash, and finer ranges that tell how even a range is.
SLOTS, FINE = 1024, 64
# Text of a shard in bytes, suffixes of a group, and words whose least hashes one task compares.
SHARD_BYTES, GROUP_SUFFIXES, ANCHOR_WORDS = 6 << 20, 4 << 20, 16 << 20


@dataclass(frozen=True)
class Groups:
    """Where a suffix goes: by the range of its first prefix, and for heavy ranges by a longer one."""

    first: np.ndarray
    parts: np.ndarray
    depth: np.ndarray

    def of(self, path: list[np.ndarray]) -> np.ndarray:
        slot = (path[0] >> np.uint64(54)).astype(np.int64)
        group = self.first[slot]
        for level in np.unique(self.depth[slot]).tolist():
            if level:
                longer = (self.depth[slot] == level).nonzero()[0]
                spread = mixed(path[level][longer]) % self.parts[slot[longer]].astype(np.uint64)
                group[longer] += spread.astype(np.int64)
        return group


def prefix_hashes(words: np.ndarray, min_words: int) -> list[np.ndarray]:
    """Hashes of every window's first quarter, half, three quarters and whole; the last from a base of its own."""
    count = max(len(words) - min_words + 1, 0)
    runs = Runs(words)
    quarters = [runs.of(max(1, min_words * k // 4))[:count] for k in (1, 2, 3)]
    return [*quarters, Runs(words, LEAF_BASE).of(min_words)]


def inside(begins: np.ndarray, min_words: int) -> np.ndarray:
    """Which places begin a window that ends in the same text."""
    n = int(begins[-1])
    count = max(n - min_words + 1, 0)
    good = np.ones(max(n, 1), bool)
    for end in range(1, min_words):
        good[np.maximum(begins[1:] - end, begins[:-1])[begins[1:] > begins[:-1]]] = False
    return good[:count]


def _anchors(words: np.ndarray, min_words: int) -> np.ndarray:
    """The least hash of eight neighbouring words in every window."""
    gram = min(GRAM_WORDS, min_words)
    return least_of(Runs(words).of(gram), min_words - gram + 1)


def _prefix_counts(docs: DataFrame, min_words: int) -> tuple[Groups, int, int]:
    """The groups, and how many bytes and words the texts have, from one pass over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, SLOTS * FINE), np.int64)
        n_bytes = n_words = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = batch.column("text").slice(at, 1024)
                n_bytes += pc.sum(pc.binary_length(texts)).as_py() or 0
                words, begins = hashed_words(texts)
                n_words += len(words)
                good = inside(begins, min_words)
                path = [p[good] for p in prefix_hashes(words, min_words)]
                slot = (path[0] >> np.uint64(54)).astype(np.int64) * FINE
                for level in range(4):
                    fine = slot + (mixed(path[level]) % np.uint64(FINE)).astype(np.int64)
                    counts[level] += np.bincount(fine, minlength=SLOTS * FINE)
        fine = counts.reshape(4, SLOTS, FINE)
        kinds = np.repeat(np.arange(6), [1, 1, *[SLOTS] * 4])
        places = np.concatenate([[0, 0], np.tile(np.arange(SLOTS), 4)])
        found = np.concatenate([[n_bytes, n_words], fine[0].sum(1), *fine[:3].max(2)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(places, pa.int32()), pa.array(found)], ["kind", "slot", "n"]
        )

    sums = docs.select("text").mapInArrow(run, "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))
    totals = np.zeros((6, SLOTS), np.int64)
    for kind, slot, n in sums.collect():  # 4,098 rows at any size
        totals[kind, slot] = n
    first, parts, depth = np.zeros(SLOTS, np.int64), np.ones(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    group = held = 0
    for slot in range(SLOTS):
        n = int(totals[2, slot])
        if n > GROUP_SUFFIXES:
            # a group of its own for each part; the shortest prefix none of whose values outgrows a group
            group += held > 0
            first[slot], held = group, 0
            parts[slot] = ceil_div(2 * n, GROUP_SUFFIXES)
            depth[slot] = next((k for k in (1, 2) if totals[3 + k, slot] <= GROUP_SUFFIXES // 2), 3)
            group += int(parts[slot])
            continue
        if held + n > GROUP_SUFFIXES:
            group, held = group + 1, 0
        first[slot], held = group, held + n
    return Groups(first, parts, depth), int(totals[0, 0]), int(totals[1, 0])


def _ordered(table: pa.Table) -> pa.Table:
    """A shard's documents in document order: by id, nulls last, then by text."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text")
    return column.chunk(0) if column.num_chunks == 1 else pa.array([], pa.string())


def _again(path: np.ndarray, leaf: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Which windows of a shard also begin earlier in it."""
    later = np.zeros(len(leaf), bool)
    # windows alone in their slot of a small table can't repeat; only the others are sorted
    slot = (leaf >> np.uint64(42)).astype(np.int64)
    maybe = np.flatnonzero(good & (np.bincount(slot[good], minlength=1 << 22) > 1)[slot])
    order = maybe[np.lexsort((maybe, path[maybe], leaf[maybe]))]
    later[order[1:]] = (leaf[order[1:]] == leaf[order[:-1]]) & (path[order[1:]] == path[order[:-1]])
    return later


def _path(prefixes: list[np.ndarray]) -> np.ndarray:
    """The tree path above the leaf in one number: 20, 20 and 24 bits of the prefix hashes."""
    a, b, c = prefixes[:3]
    return (a >> np.uint64(44) << np.uint64(44)) | (b >> np.uint64(44) << np.uint64(24)) | (c >> np.uint64(40))


def later_leaves(path: np.ndarray, leaf: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which suffixes of a group hang below a deep internal node and are not its first leaf.

    Suffixes sorted by their path and leaf hashes stand in the order of the
    suffix tree's leaves, and a node is a run of neighbours that agree down to
    its depth.  A run that agrees over the whole path is a node at least
    ``min_words`` deep.  ``order`` is the place in the corpus.
    """
    sort = np.lexsort((order, leaf, path))
    path, leaf = path[sort], leaf[sort]
    deep = (path[1:] == path[:-1]) & (leaf[1:] == leaf[:-1])
    later = np.zeros(len(sort), bool)
    later[sort[1:][deep]] = True
    return later


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For each shard of a bucket, its anchors that another shard holds too."""
    blobs = [np.frombuffer(b, np.uint32) for b in table.column("data").to_pylist()]
    values, counts = np.unique(np.concatenate(blobs), return_counts=True)
    shared = values[counts > 1]
    out = []
    for blob in blobs:
        at = np.searchsorted(shared, blob)
        at[at == len(shared)] = 0
        out.append(blob[shared[at] == blob].tobytes() if len(shared) else b"")
    found = pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "data": pa.array(out, pa.binary())})
    return found.filter(pc.greater(pc.binary_length(found.column("data")), 0))


def _marked(table: pa.Table) -> pa.Table:
    """Per shard, the places of a group's suffixes that occur earlier in the corpus."""
    ids = pa.chunked_array([c for row in table.column("ids").chunks for c in [row.flatten()]])
    firsts = [np.frombuffer(b, np.int32) for b in table.column("firsts").to_pylist()]
    places = [np.frombuffer(b, np.int32) for b in table.column("places").to_pylist()]
    shards = table.column("shard").to_numpy()
    # rank of every document of every shard: by id, nulls last, then by shard; a shard's own documents are in order
    n_docs = [len(f) for f in firsts]
    keys = pa.table({"id": ids, "shard": np.repeat(shards, n_docs), "at": np.arange(sum(n_docs))})
    rank = np.empty(sum(n_docs), np.int64)
    rank[pc.sort_indices(keys, [("id", "ascending"), ("shard", "ascending"), ("at", "ascending")]).to_numpy()] = np.arange(sum(n_docs))
    order, base = [], 0
    for first, place in zip(firsts, places):
        of = base + np.searchsorted(first, np.arange(len(place)), "right") - 1
        order.append((rank[of] << 32) + place)
        base += len(first)
    path = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("path").to_pylist()])
    leaf = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("leaf").to_pylist()])
    later = np.split(later_leaves(path, leaf, np.concatenate(order)), np.cumsum([len(p) for p in places])[:-1])
    out = pa.table({"shard": shards, "data": pa.array([p[m].tobytes() for p, m in zip(places, later)], pa.binary())})
    return out.filter(pc.greater(pc.binary_length(out.column("data")), 0))


def _cut(data: bytes | None, drop: np.ndarray) -> bytes:
    words = (data or b"").split()
    return b" ".join(compress(words, ~drop) if drop.any() else words)


def drop_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut every word that lies in a passage of ``min_words`` words which begins earlier in the corpus.

    Returns ``id_col``, ``n_words``, ``n_removed``, ``kept_text`` (the kept
    words, one space between them) and ``spans``, the places and lengths in
    words of what was cut; one row per input row.  Earlier means a smaller id,
    or the same row and an earlier word; what is cut is decided on the input,
    not on what is left.

    A null or empty text has no words.  Null ids come after all others.  Rows
    that share an id, or have none, are in a fixed order of their texts and
    shards; of equal rows one counts as the first.  An empty table gives an
    empty result.  Texts are taken whole and other columns are not read.  Ids
    may be of any type that sorts.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    groups, n_bytes, n_words = _prefix_counts(rows, min_words)
    n_shards = max(1, ceil_div(n_bytes, SHARD_BYTES))
    n_buckets = max(1, ceil_div(n_words, ANCHOR_WORDS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n_shards)).cast("int")).repartition(
        max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard"
    )

    def anchors(table: pa.Table) -> pa.Table:
        words, begins = hashed_words(_text(table.combine_chunks()))
        found = _anchors(words, min_words)[inside(begins, min_words)]
        found = mixed(np.unique(found[np.append(True, found[1:] != found[:-1])] if len(found) else found))
        bucket = ((found >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        # 32 bits do: an anchor taken for another one only sends a suffix that finds no partner
        parts = [np.unique(found[bucket == k].astype(np.uint32)).tobytes() for k in range(n_buckets)]
        shard = table.column("shard")[0].as_py()
        return pa.table(
            {"shard": pa.array([shard] * n_buckets, pa.int32()), "bucket": pa.array(range(n_buckets), pa.int32()), "data": pa.array(parts, pa.binary())}
        )

    shared = (
        dealt.groupBy("shard").applyInArrow(anchors, "shard int, bucket int, data binary")
        .groupBy("bucket").applyInArrow(_shared_anchors, "shard int, bucket int, data binary")
    )

    def suffixes(table: pa.Table, known: pa.Table) -> pa.Table:
        names = ["group", "shard", "ids", "firsts", "places", "path", "leaf"]
        table = _ordered(table)
        words, begins = hashed_words(_text(table))
        if not known.num_rows or len(words) < min_words:
            kinds = [pa.int64(), pa.int32(), pa.list_(table.schema.field("id").type), *[pa.binary()] * 4]
            return pa.table([pa.array([], k) for k in kinds], names)
        good = inside(begins, min_words)
        least = _anchors(words, min_words)
        # one look-up for each stretch of windows with the same anchor
        change = np.append(True, least[1:] != least[:-1])
        values = mixed(least[change])
        bucket = ((values >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        seen = np.zeros(len(values), bool)
        for k, data in zip(known.column("bucket").to_pylist(), known.column("data").to_pylist()):
            mine = np.flatnonzero(bucket == k)
            have = np.frombuffer(data, np.uint32)
            at = np.searchsorted(have, values[mine].astype(np.uint32))
            at[at == len(have)] = 0
            seen[mine] = have[at] == values[mine].astype(np.uint32)
        prefixes = prefix_hashes(words, min_words)
        path = _path(prefixes)
        sent = np.flatnonzero(good & seen[np.cumsum(change) - 1] & ~_again(path, prefixes[3], good))
        group = groups.of([p[sent] for p in prefixes])
        order = np.argsort(group, kind="stable")
        sent, group = sent[order], group[order]
        edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)) if len(group) else np.zeros(1, int)
        ids, out = table.column("id").combine_chunks(), {n: [] for n in names}
        picked, lengths = [], [0]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            of = np.searchsorted(begins, sent[a:b], "right") - 1
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            picked.append(of[first])
            lengths.append(len(first))
            out["group"].append(int(group[a]))
            for name, data in (("firsts", first.astype(np.int32)), ("places", sent[a:b].astype(np.int32)), ("path", path[sent[a:b]]), ("leaf", prefixes[3][sent[a:b]])):
                out[name].append(data.tobytes())
        taken = ids.take(pa.array(np.concatenate(picked) if picked else np.zeros(0, int)))
        taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
        columns = [
            pa.array(out["group"], pa.int64()),
            pa.array([table.column("shard")[0].as_py()] * len(out["group"]), pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), taken),
            *(pa.array(out[n], pa.binary()) for n in names[3:]),
        ]
        return pa.table(columns, names)

    marks = (
        dealt.groupBy("shard").cogroup(shared.groupBy("shard"))
        .applyInArrow(suffixes, f"group long, shard int, ids array<{kind}>, firsts binary, places binary, path binary, leaf binary")
        .groupBy("group").applyInArrow(_marked, "shard int, data binary")
    )

    def kept(table: pa.Table, marked: pa.Table) -> pa.Table:
        table = _ordered(table)
        texts = _text(table)
        words, begins = hashed_words(texts)
        prefixes = prefix_hashes(words, min_words)
        later = _again(_path(prefixes), prefixes[3], inside(begins, min_words))
        for data in marked.column("data").to_pylist():
            later[np.frombuffer(data, np.int32)] = True
        del prefixes
        edges = np.zeros(len(words) + 1, np.int32)
        at = np.flatnonzero(later)
        edges[at] += 1
        edges[at + min_words] -= 1
        dropped = np.cumsum(edges[:-1]) > 0
        sums = np.append(0, np.cumsum(dropped))
        raw = texts.cast(pa.binary())
        new, spans = [], []
        for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
            drop = dropped[a:b]
            new.append(_cut(raw[k].as_py(), drop))
            turns = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]])))
            spans.append([{"start": int(s), "n_words": int(e - s)} for s, e in zip(turns[::2], turns[1::2])])
        return pa.table(
            {
                "id": table.column("id"),
                "n_words": np.diff(begins),
                "n_removed": np.diff(sums[begins]),
                "kept_text": pa.array(new, pa.binary()).cast(pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32())]))),
            }
        )

    found = dealt.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(
        kept, f"id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<start:int,n_words:int>>"
    )
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", "spans")
