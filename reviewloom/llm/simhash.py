"""SimHash near-duplicates: fingerprints linked through a forest of vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import SLICE_ROWS, landed, shuffle_partitions, sliced
from reviewloom.llm.words import Runs, hashed_words, inverse, mixed, powers

# Words in a shingle, hash seed, differing bits of a link.
SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
# Blocks of the fingerprint.  A tree watches all choices of BLOCKS - max_bits blocks; more blocks make finer shards and
# more rows per fingerprint (6: 15 rows and 2 ** 21 values per tree, 7: 35 rows and 2 ** 27 values, for 10 ** 10 and more).
BLOCKS = 6
# Vantage points on each tree's path, and the bits of one distance.
VANTAGES, DISTANCE_BITS = 8, 6
# Fingerprints that one task compares with each other; larger shards are dealt into pairs of such parts.
SHARD_ROWS = 8_192
# Fingerprints below a vantage point that are compared directly.
LEAF_ROWS = 512


def text_fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles, as a signed number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - words_per_shingle + 1)
    firsts, lasts = starts[:count].tolist(), ends[-count:].tolist()
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 65_536):
        part = [of(joined[s:e], SEED) for s, e in zip(firsts[at : at + 65_536], lasts[at : at + 65_536])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fp)`` of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [text_fingerprint(t, words) for (texts,) in sliced([batch], ["text"]) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Bit masks such that two fingerprints with at most ``max_bits`` differing bits are equal under one of them.

    Differing bits touch at most ``max_bits`` blocks, so some choice of the
    other blocks is untouched: under its mask the distance is 0.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - max_bits)]


def vantage_points(mask: int, count: int = VANTAGES) -> np.ndarray:
    """Fixed pseudo-random vantage points below a mask."""
    points = [xxhash.xxh64_intdigest(f"{mask}/{k}".encode(), SEED) & mask for k in range(count)]
    return np.array(points, np.uint64)


def shard_of(fps: np.ndarray, mask: int) -> np.ndarray:
    """Path through one tree: the masked distances to its vantage points.

    The children of a vantage point are its distance shells.  By the triangle
    bound a neighbour at masked distance r lies in the shells d - r to d + r;
    each tree looks for the neighbours at distance 0, so one shell per vantage
    point holds them all and every other branch is pruned.
    """
    path = np.full(len(fps), mask % 251, np.int64)
    low = fps & np.uint64(mask)
    for point in vantage_points(mask):
        path = (path << DISTANCE_BITS) + np.bitwise_count(low ^ point).astype(np.int64)
    return path


def _shards(distinct: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """``(tree, shard, fp)``: each fingerprint in one shard of every tree."""
    masks = block_masks(blocks, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                fps = batch.column("fp").to_numpy(zero_copy_only=False)[at : at + 50_000].view(np.uint64)
                for tree, mask in enumerate(masks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fps), tree, np.int32)), pa.array(shard_of(fps, mask)), pa.array(fps.view(np.int64))],
                        ["tree", "shard", "fp"],
                    )

    return distinct.select("fp").mapInArrow(run, "tree int, shard long, fp long")


def _groups(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Index of the smallest member of each fingerprint's group inside one shard, by a vantage-point tree.

    A node takes a vantage point and the median distance to it as radius.
    Fingerprints inside and outside are searched on their own; pairs across the
    border can only lie within ``max_bits`` of it, and only those meet.
    """
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), LEAF_ROWS):
            part = a[at : at + LEAF_ROWS]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[b][None, :]) <= max_bits)
            i, j = label[part[i]], label[b[j]]
            # pairs of groups, not of fingerprints
            pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1)[i != j], axis=0)
            if len(pairs):
                for x, y in pairs.tolist():
                    x, y = find(x), find(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                flat = np.array([find(k) for k in np.unique(pairs).tolist()])
                moved = np.isin(label, np.unique(pairs))
                label[moved] = flat[np.searchsorted(np.unique(pairs), label[moved])]

    label = np.arange(len(fps))
    stack = [np.arange(len(fps))]
    while stack:
        here = stack.pop()
        if len(here) <= LEAF_ROWS:
            join(here, here)
            continue
        distance = np.bitwise_count(fps[here] ^ fps[here[0]]).astype(np.int64)
        radius = np.median(distance)
        inner = distance <= radius
        if inner.all() or not inner.any():
            inner = distance < radius
            if not inner.any():
                join(here, here)
                continue
            radius = distance[inner].max()
        stack += [here[inner], here[~inner]]
        join(here[inner & (distance > radius - max_bits)], here[~inner & (distance <= radius + max_bits)])
    return np.array([find(k) for k in label.tolist()])


def _shard_links(sharded: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, to)``: every grouped fingerprint and the smallest of its group in the shard, a star per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((4, 0), np.int64)
        for batch in [*_tabled(batches), None]:
            rows = kept if batch is None else np.concatenate([kept, batch], axis=1)
            changes = np.flatnonzero((np.diff(rows[:3], axis=1) != 0).any(axis=0)) + 1
            ends = np.append(changes, rows.shape[1]) if batch is None else changes
            start, source, to = 0, [], []
            for end in ends.tolist():
                if end - start > 1:
                    fps = np.unique(rows[3, start:end])
                    group = _groups(fps.view(np.uint64), max_bits)
                    other = group != np.arange(len(fps))
                    source.append(fps[other])
                    to.append(fps[group[other]])
                start = end
            kept = rows[:, start:]
            if source:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(source)), pa.array(np.concatenate(to))], ["fp", "to"]
                )

    return sharded.mapInArrow(run, "fp long, to long")


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "shard", "part", "fp")])


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``(fp, to)`` links that connect exactly the fingerprints reachable through pairs of at most ``max_bits`` bits.

    A shard larger than ``SHARD_ROWS`` is dealt into parts, and every pair of
    its parts is searched in a task of its own: no task holds more, no pair is
    missed.
    """
    shards = landed(_shards(distinct, max_bits, blocks), "shards")
    large = (
        shards.groupBy("tree", "shard")
        .count()
        .filter(F.col("count") > SHARD_ROWS)
        .select("tree", "shard", F.ceil(2 * F.col("count") / SHARD_ROWS).cast("int").alias("parts"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.least(mine, other) * F.col("parts") + F.greatest(mine, other),
    )
    dealt = shards.join(large, ["tree", "shard"], "left").select(
        "tree", "shard", "fp", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part")
    )
    together = dealt.repartition(shuffle_partitions(distinct), "tree", "shard", "part").sortWithinPartitions(
        "tree", "shard", "part"
    )
    return _shard_links(together.select("tree", "shard", "part", "fp"), max_bits).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node reachable over ``(fp, to)`` links, for every node that has one.

    Labels move along the links and then jump to their label's label, so the
    rounds grow with the logarithm of the longest path.  A round is a few
    joins over written tables, which adaptive execution splits where a node has
    very many links.
    """
    edges = landed(
        links.select(F.col("fp").alias("u"), F.col("to").alias("v"))
        .unionByName(links.select(F.col("to").alias("u"), F.col("fp").alias("v"))),
        "edges",
    )
    labels = landed(
        edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels"
    )
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        moved = landed(
            labels.join(near, F.col("node") == F.col("u"), "left").select(
                "node", F.least("label", F.col("near")).alias("label"), F.col("label").alias("old")
            ),
            "labels",
        )
        up = moved.select(F.col("node").alias("via"), F.col("label").alias("further"))
        jumped = landed(
            moved.join(up, F.col("label") == F.col("via")).select("node", F.least("label", "further").alias("label"), "old"),
            "labels",
        )
        if not jumped.filter(F.col("label") != F.col("old")).limit(1).count():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def near_duplicates(
    docs: DataFrame,
    max_bits: int = MAX_BITS,
    words: int = SHINGLE_WORDS,
    blocks: int = BLOCKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Fingerprint and component of every document.

    Returns ``id_col``, ``fp`` (the 64 bits as a signed number) and
    ``component_id``, the smallest id reachable over pairs of fingerprints with
    at most ``max_bits`` differing bits.  Exact copies share a fingerprint and
    are one node; only distinct fingerprints are sharded, each into one shard of
    every tree, and links are stars, never all pairs of a group.

    Null and empty texts have the fingerprint 0 and are linked like any other.
    A null id is never a component's name unless no member has an id.  Repeated
    rows give repeated results, an empty table an empty one.  Other columns are
    not read.
    """
    prints = landed(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = landed(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    grouped = connected(landed(near_links(distinct, max_bits, blocks), "links"))
    firsts = grouped.join(distinct, F.col("node") == F.col("fp")).select("node", "label", "first")
    names = firsts.groupBy("label").agg(F.min("first").alias("name"))
    named = landed(firsts.join(names, "label").select(F.col("node").alias("fp"), "name", F.lit(True).alias("grouped")), "names")
    classes = landed(
        distinct.join(named, "fp", "left").select(
            "fp", F.when(F.col("grouped"), F.col("name")).otherwise(F.col("first")).alias("component_id")
        ),
        "classes",
    )
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# --- similar texts: wide fingerprints, trees under random masks, exact check --------------------------------------------

# Words of a shingle, likeness of shingle sets, bits of a fingerprint, and the share of pairs just that alike that a
# search is to meet in some tree.
SIMILAR_WORDS, SIMILARITY, WIDE_BITS, MET = 5, 0.8, 128, 0.97
# Fingerprints of a shard that are compared row by row with their neighbours, and what a mask leaves in a shard on average.
SMALL_SHARD, SHARD_MEAN = 64, 16
# Pairs that a task looks at together, and large shards that may be sent to every task.
BLOCK_PAIRS, BROADCAST_SHARDS = 1 << 16, 100_000
_LANE = 0xA24BAED4963EE407


def _shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles in order and where each text's begin; a shorter text is one shingle, no words none."""
    hashes, begins = hashed_words(pc.ascii_lower(texts))
    sums = Runs(hashes)
    sizes = np.diff(begins)
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    borders = np.append(0, np.cumsum(counts))
    at = np.repeat(begins[:-1] - borders[:-1], counts) + np.arange(borders[-1])
    length = np.repeat(np.minimum(sizes, words), counts)
    with np.errstate(over="ignore"):
        return mixed((sums.sums[at + length] - sums.sums[at]) * powers(inverse(sums.base), max(1, len(hashes)))[at]), borders


def _wide(texts: pa.Array, words: int) -> np.ndarray:
    """Two 64-bit SimHashes of every text, from independent hashes of its shingles."""
    shingles, borders = _shingles(texts, words)
    out = np.zeros((2, len(texts)), np.uint64)
    for lane in range(2):
        values = mixed(shingles ^ np.uint64(_LANE)) if lane else shingles
        for k, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
            ones = np.zeros(64, np.int64)
            for at in range(a, b, 65_536):
                part = np.ascontiguousarray(values[at : min(b, at + 65_536)]).view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[lane, k] = np.packbits(2 * ones > b - a, bitorder="little").view(np.uint64)[0]
    return out


def search_plan(n: int, similarity: float = SIMILARITY, met: float = MET) -> tuple[int, int, int]:
    """Bits of a mask, number of trees and differing bits of a candidate, for ``n`` fingerprints.

    Sets with Jaccard likeness s have the cosine 2 s / (1 + s) when they are
    equally large, and each bit differs with the angle's share of a half turn.
    Masks grow with the logarithm of ``n`` so that shards don't; the trees are as
    many as it takes for two texts just that alike to be equal under one of the
    masks; candidates may differ in two standard deviations more than the mean.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(48, max(12, math.ceil(math.log2(max(2, n / SHARD_MEAN)))))
    trees = math.ceil(math.log(1 - met) / math.log(1 - (1 - differ) ** bits))
    return bits, trees, math.floor(WIDE_BITS * differ + 2 * math.sqrt(WIDE_BITS * differ * (1 - differ)))


def random_masks(bits: int, count: int) -> list[int]:
    """Fixed pseudo-random masks of so many bits; even trees watch the first half of a fingerprint, odd ones the second."""
    draw = np.random.default_rng(SEED)
    return [sum(1 << int(b) for b in draw.choice(64, bits, replace=False)) for _ in range(count)]


def spanning(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Indices of the pairs of a shortest spanning forest; ``label`` names the trees so far and is brought up to date.

    In each round every tree takes its shortest pair to another one.
    """
    rank = np.empty(len(i), np.int64)
    rank[np.lexsort((j, i, distance))] = np.arange(len(i))
    left, chosen = np.arange(len(i)), []
    while True:
        left = left[label[i[left]] != label[j[left]]]
        if not len(left):
            return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        a, b = label[i[left]], label[j[left]]
        tree, other, pair = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([left, left])
        order = np.lexsort((rank[pair], tree))
        first = order[np.append(True, tree[order][1:] != tree[order][:-1])]
        chosen.append(np.unique(pair[first]))
        parent = np.arange(n)
        parent[tree[first]] = other[first]
        both = parent[parent] == np.arange(n)
        parent[both] = np.minimum(parent[both], np.arange(n)[both])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label[:] = parent[label]


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``max_bits`` that hold the groups of one shard together, by a vantage-point tree.

    Inside and outside of the median distance to a vantage point are searched on
    their own; across the border only what lies within ``max_bits`` of it meets.
    """
    label = np.arange(fps.shape[1])
    found = []

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(lane[a][:, None] ^ lane[b][None, :]).astype(np.int16) for lane in fps)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        # so few rows at a time that a block in which all are alike stays small
        step = max(1, BLOCK_PAIRS // max(1, len(b)))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            distance = apart(part, b)
            i, j = np.nonzero((distance <= max_bits) & (label[part][:, None] != label[b][None, :]))
            pairs = spanning(len(label), part[i], b[j], distance[i, j], label)
            found.append(np.stack([part[i[pairs]], b[j[pairs]]]))

    stack = [label.copy()]
    while stack:
        here = stack.pop()
        distance = apart(here[:1], here)[0] if len(here) > LEAF_ROWS else np.zeros(0)
        radius = np.median(distance) if len(distance) else 0
        inner = distance <= radius
        if not len(distance) or inner.all():
            join(here, here)
            continue
        stack += [here[inner], here[~inner]]
        join(here[inner & (distance > radius - max_bits)], here[~inner & (distance <= radius + max_bits)])
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _near_pairs(rows: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Pairs of fingerprints that hold the groups of whole shards together; ``rows`` is shard, part and two lanes."""
    n = rows.shape[1]
    starts = np.flatnonzero(np.append(True, (np.diff(rows[:2], axis=1) != 0).any(axis=0))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    fps = rows[2:].view(np.uint64)
    pairs = []
    small = np.repeat(sizes <= SMALL_SHARD, sizes)
    ends = np.repeat(starts + sizes, sizes)
    i, j, distance = [], [], []
    for step in range(1, min(SMALL_SHARD, int(sizes.max(initial=1)))):
        at = np.flatnonzero(small[: n - step] & (np.arange(n - step) + step < ends[: n - step]))
        if not len(at):
            break
        apart = sum(np.bitwise_count(lane[at] ^ lane[at + step]).astype(np.int16) for lane in fps)
        near = apart <= max_bits
        i.append(at[near]), j.append(at[near] + step), distance.append(apart[near])
    if i:
        i, j, distance = map(np.concatenate, (i, j, distance))
        kept = spanning(n, i, j, distance, np.arange(n))
        pairs.append(np.concatenate([rows[2:, i[kept]], rows[2:, j[kept]]]))
    for a, size in zip(starts.tolist(), sizes.tolist()):
        if size > SMALL_SHARD:
            part = np.ascontiguousarray(rows[2:, a : a + size])
            i, j = _forest(part.view(np.uint64), max_bits)
            pairs.append(np.concatenate([part[:, i], part[:, j]]))
    return pairs


def _candidates(distinct: DataFrame, similarity: float) -> DataFrame:
    """``(a1, a2, b1, b2)``: pairs of fingerprints to be checked, a forest per shard of every tree."""
    bits, trees, max_bits = search_plan(distinct.count(), similarity)
    masks = random_masks(bits, trees)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                lanes = [part.column(c).to_numpy(zero_copy_only=False) for c in ("f1", "f2")]
                for tree, mask in enumerate(masks):
                    # one number for the tree and the path in it; paths of two trees that collide only share a shard
                    path = shard_of(lanes[tree % 2].view(np.uint64), mask).view(np.uint64)
                    shard = mixed(path ^ np.uint64(tree * _LANE & (1 << 64) - 1)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (shard, *lanes)], ["shard", "f1", "f2"])

    sharded = landed(distinct.select("f1", "f2").mapInArrow(shards, "shard long, f1 long, f2 long"), "wide-shards")
    large = landed(
        sharded.groupBy("shard").count().filter(F.col("count") > SHARD_ROWS)
        .select("shard", F.ceil(2 * F.col("count") / SHARD_ROWS).cast("int").alias("parts")),
        "large-shards",
    )
    n_large = large.count()
    if n_large:
        mine = F.pmod(F.xxhash64("f1", "f2"), F.col("parts")).cast("int")
        each = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least(mine, other) * F.col("parts") + F.greatest(mine, other)
        )
        met = sharded.join(F.broadcast(large) if n_large <= BROADCAST_SHARDS else large, "shard", "left")
        dealt = met.select("shard", "f1", "f2", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(each)).alias("part"))
    else:
        dealt = sharded.withColumn("part", F.lit(0))
    key = ["shard", "part"]
    together = dealt.repartition(shuffle_partitions(distinct), *key).sortWithinPartitions(*key)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((4, 0), np.int64)
        tables = (np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key, "f1", "f2")]) for b in batches)
        for batch in chain(tables, [None]):
            rows = kept if batch is None else np.concatenate([kept, batch], axis=1)
            changes = np.flatnonzero((np.diff(rows[:2], axis=1) != 0).any(axis=0)) + 1
            whole = rows.shape[1] if batch is None else int(changes[-1]) if len(changes) else 0
            pairs = _near_pairs(np.ascontiguousarray(rows[:, :whole]), max_bits)
            kept = rows[:, whole:]
            if pairs:
                found = np.concatenate(pairs, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a1", "a2", "b1", "b2"])

    return together.select(*key, "f1", "f2").mapInArrow(search, "a1 long, a2 long, b1 long, b2 long").distinct()


def similar_documents(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    words: int = SIMILAR_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, hash, group)`` of every document: its id, a 64-bit hash of its text, and its group of similar texts.

    Two texts are linked when their sets of ``words``-word shingles, A-Z lower
    case, have a Jaccard likeness of ``similarity`` or more, which is checked on
    the whole texts; groups are what links connect.  Candidates come from
    128-bit fingerprints that meet in some tree and differ in few bits.  Each
    shard sends a shortest spanning forest instead of all its pairs, so a group
    of n copies costs n pairs in each tree.  A pair just that alike is met with
    probability ``MET`` and has few enough differing bits in all but a few of a
    hundred cases; more alike ones are missed more rarely.

    Texts of fewer words are one shingle.  Null and empty texts and those of
    white space alone have no shingle and are one group.  Equal texts are in one
    group whatever their ids; repeated rows give repeated results, an empty
    table an empty one.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                lanes = _wide(part.column("text"), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), *map(pa.array, lanes)], ["id", "hash", "f1", "f2"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), text.alias("text"))
    prints = landed(rows.mapInArrow(fingerprint, f"id {kind}, hash long, f1 long, f2 long"), "wide-prints")
    distinct = landed(prints.select("f1", "f2").distinct(), "wide-distinct")
    pairs = landed(_candidates(distinct, similarity), "pairs")
    # one row stands for each fingerprint that takes part in a pair
    ends = pairs.select(F.col("a1").alias("f1"), F.col("a2").alias("f2")).union(pairs.select("b1", "b2")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    shown = landed(
        prints.join(landed(ends, "ends"), ["f1", "f2"], "left_semi").groupBy("f1", "f2").agg(first).select("f1", "f2", "first.id", "first.hash"),
        "shown",
    )
    met = rows.withColumnRenamed("id", "_id").join(shown, F.col("_id").eqNullSafe(F.col("id")) & (rows["hash"] == shown["hash"]))
    texts = landed(met.select("f1", "f2", "text").dropDuplicates(["f1", "f2"]), "texts")

    def likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                (left, a), (right, b) = (_shingles(part.column(c), words) for c in ("left", "right"))
                good = []
                for k in range(part.num_rows):
                    one, two = np.unique(left[a[k] : a[k + 1]]), np.unique(right[b[k] : b[k + 1]])
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    good.append(common >= similarity * (len(one) + len(two) - common) - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("fp"), part.column("to")], ["fp", "to"]).filter(pa.array(good, pa.bool_()))

    def node(a: str, b: str):
        return F.concat_ws("-", F.hex(a), F.hex(b))

    sides = [texts.select(*(F.col(c).alias(f"{side}{n}") for n, c in ((1, "f1"), (2, "f2"))), F.col("text").alias(name)) for side, name in (("a", "left"), ("b", "right"))]
    both = pairs.join(sides[0], ["a1", "a2"]).join(sides[1], ["b1", "b2"])
    links = both.select(node("a1", "a2").alias("fp"), node("b1", "b2").alias("to"), "left", "right").mapInArrow(likeness, "fp string, to string")
    grouped = connected(landed(links, "similar-links"))
    own = node("f1", "f2")
    return prints.withColumn("node", own).join(grouped, "node", "left").select(
        "id", "hash", F.coalesce("label", "node").alias("group")
    )


def keep_one(docs: DataFrame, order: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each group of :func:`similar_documents`, with all its columns.

    The one with the smallest id stays (a null id comes last), of equal ids that
    with the smallest text hash; rows that agree in both are told apart by the
    ``order`` columns.  Nothing is left to chance.
    """
    found = similar_documents(docs, id_col=id_col, text_col=text_col, **settings)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    chosen = landed(found.groupBy("group").agg(first).select(F.col("first.id").alias("_id"), F.col("first.hash").alias("_hash")), "chosen")
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = hashed.join(chosen, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    same = Window.partitionBy(id_col, "_text_hash").orderBy(*(F.col(c).asc_nulls_last() for c in (*order, text_col)))
    return kept.withColumn("_place", F.row_number().over(same)).filter("_place = 1").select(*docs.columns)
