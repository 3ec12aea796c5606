"""The prefix trie of conversations, from digests of fixed-length blocks of turns.

Conversations are grouped by the digests of their successive blocks first.  Only
inside a block that diverges from a sibling are single turns compared; a block
that all conversations at its place share gives its nodes as they are.

Everything about a subtree is a sum over conversations.  A node belongs to its
smallest member, and the nodes of one conversation are then the lower end of its
path, its chain.  So the leaves below a node are the chains of its members that
end in a leaf, and what lies below it weighs as much as its members' chains less
the part of the owner's chain that is above it: two more aggregations over the
blocks, no walk along the trie, whatever its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.llm.common import landed, shuffle_partitions

# Turns of a block; a group carries that many turn hashes, so it stays small.
BLOCK_TURNS = 4
# Rows of one key that stand in one window; a longer conversation is summed up piece by piece.
WINDOW_ROWS = 4_096
NODE = ["depth", "p1", "p2"]
NOBODY = hashlib.sha256(b"").hexdigest()


def numbered_turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, pos, t1, t2, size)``: the place of every turn from 1 on, 128 bits of hash, bytes of the text.

    Turns are ordered by ``turn_col``, null first; equal ones by role and text.
    Null roles and texts are empty ones.  Rows without a conversation are left
    out.  A range sort numbers the rows, so a conversation may be spread over
    any number of tasks.
    """
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    placed = landed(
        rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order).select(
            "conv_id",
            F.monotonically_increasing_id().alias("at"),
            F.xxhash64("role", "text").alias("t1"),
            F.xxhash64("text", F.lit(1), "role").alias("t2"),
            F.octet_length("text").cast("long").alias("size"),
        ),
        "turns",
    ).withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = landed(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "starts")
    return landed(
        placed.join(starts, ["conv_id", "part"]).select(
            "conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "t1", "t2", "size"
        ),
        "numbered",
    )


def before(df: DataFrame, key: str, order: str, values: list[str], kind: str) -> DataFrame:
    """``df`` with ``<value>_before``: the sum or exclusive or of a key's earlier rows.

    A key's rows are taken in pieces of ``WINDOW_ROWS``, so no window holds all
    rows of a very long one.
    """
    total = {"sum": F.sum, "xor": F.bit_xor}[kind]

    def both(a: Column, b: Column) -> Column:
        return a + b if kind == "sum" else a.bitwiseXOR(b)

    df = df.withColumn("_piece", F.floor(F.col(order) / WINDOW_ROWS))
    pieces = df.groupBy(key, "_piece").agg(*(total(v).alias(v) for v in values))
    over = W.partitionBy(key).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(key, "_piece", *(total(v).over(over).alias(f"_{v}") for v in values)).filter("_piece > 0")
    inner = W.partitionBy(key, "_piece").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    found = df.select("*", *(F.coalesce(total(v).over(inner), F.lit(0)).alias(f"{v}_before") for v in values))
    summed = found.join(offsets, [key, "_piece"], "left")
    kept = [c for c in df.columns if c != "_piece"]
    return summed.select(
        *kept, *(both(F.col(f"{v}_before"), F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(f"{v}_before") for v in values)
    )


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: digests of all earlier blocks and of this one, and its turns."""
    at, inner = F.col("pos") - 1, (F.col("pos") - 1) % block
    tagged = turns.select(
        "conv_id", F.floor(at / block).alias("block"), inner.alias("j"), "size",
        F.xxhash64("pos", "t1", "t2").alias("x1"), F.xxhash64("t2", "pos", "t1").alias("x2"),
    )
    columns = [
        F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}_{j}") for j in range(block) for c in ("x1", "x2", "size")
    ]
    grouped = tagged.groupBy("conv_id", "block").agg(
        F.bit_xor("x1").alias("d1"), F.bit_xor("x2").alias("d2"), F.count("*").alias("m"), *columns
    )
    found = before(grouped, "conv_id", "block", ["d1", "d2"], "xor")
    return found.withColumnRenamed("d1_before", "q1").withColumnRenamed("d2_before", "q2")


def _turn_nodes(groups: DataFrame, block: int, carried: list[str]) -> DataFrame:
    """The nodes at every turn of a block: depth, prefix, the parent's prefix, bytes of the last text."""

    def prefix(c: str, q: str, upto: int) -> Column:
        return reduce(lambda a, b: a.bitwiseXOR(b), [F.col(f"{c}_{j}") for j in range(upto)], F.col(q))

    nodes = F.array(*(
        F.struct(
            (F.col("block") * block + j + 1).alias("depth"),
            prefix("x1", "q1", j + 1).alias("p1"), prefix("x2", "q2", j + 1).alias("p2"),
            prefix("x1", "q1", j).alias("up1"), prefix("x2", "q2", j).alias("up2"),
            F.col(f"size_{j}").alias("size"),
        )
        for j in range(block)
    ))
    return groups.select(F.explode(F.slice(nodes, 1, F.col("m").cast("int"))).alias("node"), *carried).select("node.*", *carried)


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, comma-joined ids of every node's conversations, fed row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*NODE, "conv_id")]
            for *node, conv in zip(*columns):
                if node != last:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, digest.hexdigest())], [*NODE, "ends_sha256"])

    together = rows.select(*NODE, "conv_id").repartition(shuffle_partitions(rows), *NODE).sortWithinPartitions(*NODE, "conv_id")
    return together.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def conversation_trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """Every distinct sequence of first turns, as a node of the trie.

    ``convs`` holds ``(conv_id, n_turns)``, one row per conversation and 0 for
    one without turns; ``turns`` holds ``(conv_id, pos, t1, t2, size)`` with
    ``pos`` from 1 to ``n_turns``.  Both are read several times: pass written
    tables.  Returns ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (bytes of last texts that members beyond the first share,
    over the subtree) and ``ends_sha256`` (of the ids that end at the node).

    Equal conversations share all their nodes.  No conversation at all gives no
    node; conversations without turns end at the root.  Turns are told apart by
    two 64-bit hashes, prefixes by the exclusive or of those hashes taken
    together with their places.  The ids that end at one node are sorted on disk
    and hashed as a stream, since their digest is one sequence by definition;
    everything else of a node is pre-aggregated.
    """
    blocks = landed(_blocks(turns, block), "blocks")
    key = ["block", "q1", "q2", "d1", "d2", "m"]
    held = [f"{c}_{j}" for j in range(block) for c in ("x1", "x2", "size")]
    groups = landed(
        blocks.groupBy(*key).agg(
            F.count("*").alias("n"), F.min("conv_id").alias("owner"), *(F.min(c).alias(c) for c in held)
        ),
        "groups",
    )
    # several different blocks after the same prefix: turns are compared only there
    parting = landed(groups.groupBy("block", "q1", "q2").count().filter("count > 1").drop("count"), "parting")
    whole = _turn_nodes(groups.join(parting, ["block", "q1", "q2"], "left_anti"), block, ["n", "owner"])
    split = (
        _turn_nodes(groups.join(parting, ["block", "q1", "q2"], "left_semi"), block, ["n", "owner"])
        .groupBy(*NODE)
        .agg(*(F.min(c).alias(c) for c in ("up1", "up2", "size")), F.sum("n").alias("n"), F.min("owner").alias("owner"))
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("owner")).filter("n > 0").select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("up1"), zero.alias("up2"), zero.alias("size"), "n", "owner"
    )
    bare = landed(whole.unionByName(split).unionByName(root), "nodes")
    kids = bare.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2")).agg(
        F.count("*").alias("n_children")
    )
    weighed = bare.join(kids, NODE, "left").select(
        "*", ((F.col("n") - 1) * F.col("size")).alias("weight")
    ).fillna(0, ["n_children"])
    nodes = landed(before(weighed, "owner", "depth", ["weight"], "sum"), "weighed")
    chains = landed(
        nodes.groupBy(F.col("owner").alias("conv_id")).agg(
            F.sum("weight").alias("chain"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
        ),
        "chains",
    )
    sums = (
        blocks.select("conv_id", *key).join(chains, "conv_id").groupBy(*key)
        .agg(F.sum("chain").alias("chain"), F.sum("leaf").alias("leaf"))
    )
    below = (
        _turn_nodes(groups.join(landed(sums, "sums"), key), block, ["chain", "leaf"])
        .groupBy(*NODE).agg(F.sum("chain").alias("chain"), F.sum("leaf").alias("leaf"))
        .unionByName(
            chains.agg(F.sum("chain").alias("chain"), F.sum("leaf").alias("leaf")).filter("chain is not null")
            .select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "chain", "leaf")
        )
    )
    last = blocks.select(
        "conv_id", "block", F.col("q1").bitwiseXOR(F.col("d1")).alias("p1"), F.col("q2").bitwiseXOR(F.col("d2")).alias("p2")
    )
    ended = (
        convs.filter("n_turns > 0").withColumn("block", F.floor((F.col("n_turns") - 1) / block))
        .join(last, ["conv_id", "block"])
        .select(F.col("n_turns").cast("long").alias("depth"), "p1", "p2", "conv_id")
        .unionByName(convs.filter("n_turns = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id"))
    )
    parents = landed(
        nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("owner").alias("parent")),
        "parents",
    )
    told = nodes.join(parents, ["depth", "up1", "up2"], "left")
    return (
        landed(told, "told").join(below, NODE).join(_ends(ended), NODE, "left")
        .select(
            F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            "n_children", F.col("leaf").alias("n_leaves"), (F.col("chain") - F.col("weight_before")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
        )
    )


def rebuilt(conversations: DataFrame, every: int = 5, spans: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of an earlier one: ``(convs, turns)`` for ``conversation_trie``.

    Conversation c takes the first h turns of conversation ``c - c % every`` (all
    if it has fewer, none if there is none) and then its own turns after its
    first h, where h is the CRC-32 of c in decimal modulo ``spans``.
    """
    turns = numbered_turns(conversations)
    conv = F.col("conv_id")
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    span = F.crc32(conv.cast("string").cast("binary")) % spans
    heads = counted.filter(conv % every == 0).select(conv.alias("base"), F.least("own", F.lit(spans - 1)).alias("offered"))
    convs = landed(
        counted.withColumn("base", conv - conv % every).join(heads, "base", "left").select(
            "conv_id", "base", span.alias("span"), F.least(span, F.coalesce("offered", F.lit(0))).alias("taken"), "own"
        ).withColumn("n_turns", F.col("taken") + F.greatest(F.col("own") - F.col("span"), F.lit(0))),
        "convs",
    )
    own = turns.join(convs.select("conv_id", "span", "taken"), "conv_id").filter(F.col("pos") > F.col("span")).select(
        "conv_id", (F.col("pos") - F.col("span") + F.col("taken")).alias("pos"), "t1", "t2", "size"
    )
    first = turns.filter((F.col("pos") < spans) & (conv % every == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter(F.col("pos") <= F.col("taken"))
    return convs.select("conv_id", "n_turns"), landed(
        own.unionByName(lent.select("conv_id", "pos", "t1", "t2", "size")), "rebuilt"
    )
