"""I-Match fingerprints over randomised lexicon subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import NO_WORD, ascii_lower, ceil_div, landed, shuffle_partitions
from reviewloom.session import broadcast_if_small

# Terms in use: found in at least two documents and in between these shares of all documents.  A text has a bounded
# number of terms on average, so at most that number / LOW_SHARE terms can reach the lower share: the lexicon does not
# grow with the number of documents.
LOW_SHARE, HIGH_SHARE, MIN_DOCS = 0.001, 0.2, 2
# Lexicon subsets: at level k the lexicon falls at random into SUBSETS * 2 ** k parts, the first SUBSETS of which are used.
# Four hexadecimal digits of a term's MD5 choose its part at one level, so one digest does for all.
LEVELS, SUBSETS = 8, 32
# A subset speaks for a text that holds 1 to so many of its terms; the few expected terms survive an edit elsewhere.
MAX_TERMS = 3
# Number of the subset that stands for all terms of a text.
WHOLE = LEVELS * SUBSETS
# Terms of the lexicon that are sent to every task; a larger lexicon is met by a shuffle.
BROADCAST_TERMS = 500_000
# Fixed value: punctuation that is cut off both ends of a word.
PUNCTUATION = ".,;:!?\"'()[]{}<>*#|"
# Characters of text that one bucket of neighbouring documents should hold, and the most buckets there are.
BUCKET_CHARS, MAX_BUCKETS = 32 << 20, 1 << 16
# Documents without an id are dealt by so many leading bits of their text's hash.
NULL_BITS = 12
SEPARATOR = "\x01"


def terms_of(text: Column) -> Column:
    """Distinct terms in order: words, lower-cased, without punctuation at their ends."""
    words = F.split(ascii_lower(text), NO_WORD)
    trimmed = F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION))), lambda w: w != "")
    return F.sort_array(F.array_distinct(trimmed))


def subsets_sql(array: str, number: str) -> list[str]:
    """SQL of the numbers of a term's subsets, null where it is in none of a level; ``number`` reads hex digits."""
    parts = [number.format(f"substr(md5(term), {4 * k + 1}, 4)") + f" % {SUBSETS << k}" for k in range(LEVELS)]
    return [array.format(f"CASE WHEN {part} < {SUBSETS} THEN {part} + {SUBSETS * k} END") for k, part in enumerate(parts)]


def lexicon(terms: DataFrame, n_docs: int, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> DataFrame:
    """``(term, mask)`` of the terms inside the band; ``terms`` holds each text's distinct terms as ``terms``."""
    counted = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    inside = (F.col("n") >= MIN_DOCS) & (F.col("n") >= low * n_docs) & (F.col("n") <= high * n_docs)
    subsets = ", ".join(subsets_sql("{0}", "cast(conv({0}, 16, 10) AS int)"))
    return counted.filter(inside).select(
        "term", _code(F.md5("term")).alias("code"), F.expr(f"array_compact(array({subsets}))").alias("subsets")
    )


def _code(digest: Column) -> Column:
    """The first 48 bits of a hexadecimal digest; sums of many stay in 64 bits."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _tagged(terms: Column, tag: int) -> Column:
    """Terms with the number of their text, and before them one element that holds the digest of them all."""
    whole = F.struct(F.lit(-1 - tag).alias("of"), F.md5(F.array_join(terms, " ")).alias("term"))
    return F.concat(F.array(whole), F.transform(terms, lambda t: F.struct(F.lit(tag).alias("of"), t.alias("term"))))


def likeness(left: Column, right: Column) -> Column:
    """Twice the subset hashes that two fingerprints share over all they hold; 1 for equal fingerprints."""
    a, b = F.split(left, r"\."), F.split(right, r"\.")
    return F.when(left == right, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def _split_points(ids: DataFrame, every: int) -> list[str]:
    """Every so manieth id of each range of the sorted ids, as strings; ids may be of any type with an order."""
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ids.filter("id IS NOT NULL").orderBy("id").withColumn("at", in_range)
    found = ranged.filter(F.col("at") % every == 0).select(F.col("id").cast("string").alias("start")).distinct().collect()
    return [row["start"] for row in found if SEPARATOR not in row["start"]]


def _bucket(starts: list[str], order: Column, kind: str) -> Column:
    """Number of split points at or below the value, by binary search; one foldable expression whatever their number."""
    if not starts:
        return F.lit(0)
    points = F.sort_array(F.split(F.lit(SEPARATOR.join(starts)), SEPARATOR).cast(f"array<{kind}>"))
    steps = F.lit([1 << k for k in reversed(range(len(starts).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) <= order, at + step).otherwise(at)
    )


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """``(bucket, place, id, text, next_text)``: each text beside the next document's by ascending id, the last beside the first.

    Documents are dealt into buckets of neighbouring ids at split points, so the
    text is shuffled once and each bucket looks ahead in itself; only the first
    text of every bucket is handed to the bucket before.  Null ids come first,
    in the order of their texts' hashes; equal ids are ordered by text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_rows, total = rows.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    n = min(max(ceil_div(total or 0, bucket_chars), 4 * shuffle_partitions(docs)), MAX_BUCKETS)
    starts = _split_points(rows.select("id"), max(1, ceil_div(n_rows, n)))
    kind = rows.schema["id"].dataType.simpleString()
    tie = F.when(F.col("id").isNull(), F.xxhash64("text"))
    by_hash = F.shiftright("tie", 64 - NULL_BITS).cast("int") - (1 << (NULL_BITS - 1))
    dealt = rows.withColumn("tie", tie).withColumn(
        "bucket", F.when(F.col("id").isNull(), by_hash).otherwise(_bucket(starts, F.col("id"), kind))
    )
    # at most one row per bucket
    around = Window.orderBy("bucket")
    ring = (
        dealt.groupBy("bucket")
        .agg(F.min(F.struct("id", "tie")).alias("first"))
        .select(
            F.col("bucket").alias("following"),
            F.col("first.id").alias("start_id"),
            F.col("first.tie").alias("start_tie"),
            F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(Window.partitionBy())).alias("previous"),
        )
    )
    first = F.col("id").eqNullSafe(F.col("start_id")) & F.col("tie").eqNullSafe(F.col("start_tie"))
    heads = (
        dealt.join(F.broadcast(ring), (F.col("bucket") == F.col("following")) & first)
        .groupBy(F.col("previous").alias("bucket"))
        .agg(F.min("text").alias("head"))
    )
    order = Window.partitionBy("bucket").orderBy("id", "tie", "text")
    looked = dealt.select(
        "bucket", "id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("ahead")
    )
    return looked.join(heads, "bucket", "left").select(
        "bucket", "place", "id", "text", F.coalesce("ahead", "head").alias("next_text")
    )


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``next_text``, or all of them."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprint(
    docs: DataFrame, lex: DataFrame, keys: list[str], texts: dict[str, str], carried: Sequence[str] = ()
) -> DataFrame:
    """``keys``, ``carried`` and the fingerprints of several text columns at once; ``keys`` name each row uniquely.

    Terms are exploded with little besides and meet the lexicon; those of one
    subset are at most ``MAX_TERMS`` codes where they count, so their number,
    least, greatest and sum give them in order, and only numbers are grouped.
    Where the rows lie together by some of the keys already, nothing is
    shuffled unless the lexicon is too large to be sent.  A text no subset
    speaks for, as one without a term of the band, has the hash of all its terms.
    Columns to be carried go along with the first text's hash alone, as one
    more value to group by, so that they need no join afterwards.
    """
    columns = list(texts)
    places = range(len(columns))
    load = F.struct(*carried) if carried else F.lit(None).cast("int")
    termed = docs.select(*keys, load.alias("_load"), *(terms_of(F.col(c)).alias(f"_terms{i}") for i, c in enumerate(columns)))
    tagged = F.concat(*(_tagged(F.col(f"_terms{i}"), i) for i in places))
    whole = F.col("of") < 0
    met = (
        termed.select(*keys, "_load", F.explode(tagged).alias("_t"))
        .select(*keys, "_t.of", "_t.term", F.when(F.col("_t.of") == -1, F.col("_load")).alias("_load"))
        .join(broadcast_if_small(lex, BROADCAST_TERMS), "term", "left")
        .filter(whole | F.col("code").isNotNull())
        .select(
            *keys,
            "_load",
            F.when(whole, -1 - F.col("of")).otherwise(F.col("of")).alias("of"),
            F.when(whole, _code(F.col("term"))).otherwise(F.col("code")).alias("code"),
            F.explode(F.when(whole, F.array(F.lit(WHOLE))).otherwise(F.col("subsets"))).alias("subset"),
        )
    )
    held = met.groupBy(*keys, "of", "subset", "_load").agg(
        F.count("*").alias("n"), F.min("code").alias("least"), F.max("code").alias("most"), F.sum("code").alias("total")
    )
    speaking = held.filter(F.col("n") <= MAX_TERMS).select(*keys, "of", "subset", "_load", F.expr(token_sql("lower(lpad(hex(subset), 3, '0'))")).alias("token"))
    mine = lambda i, plain: (F.col("of") == i) & ((F.col("subset") < WHOLE) == F.lit(plain))
    gathered = speaking.groupBy(*keys).agg(
        F.any_value("_load", F.lit(True)).alias("_load"),
        *(F.max(F.when(mine(i, False), F.col("token"))).alias(f"_whole{i}") for i in places),
        *(F.sort_array(F.collect_list(F.when(mine(i, True), F.col("token")))).alias(f"_tokens{i}") for i in places),
    )
    return gathered.select(
        *keys,
        *(F.col("_load")[c].alias(c) for c in carried),
        *(
            F.when(F.size(f"_tokens{i}") == 0, F.col(f"_whole{i}")).otherwise(F.array_join(f"_tokens{i}", ".")).alias(texts[c])
            for i, c in enumerate(columns)
        ),
    )


def token_sql(prefix: str) -> str:
    """SQL of a subset's hash: its number and a digest of its terms' codes in order."""
    middle = "CASE WHEN n = 3 THEN concat(' ', total - least - most) ELSE '' END"
    last = "CASE WHEN n > 1 THEN concat(' ', most) ELSE '' END"
    return f"concat({prefix}, substr(md5(concat(least, {middle}, {last})), 1, 10))"


def document_lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The lexicon of a table of documents, counted over all of them."""
    texts = docs.select(terms_of(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    return landed(lexicon(texts, docs.count()), "lexicon")


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses.

    Returns ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.  A null text
    counts as empty; texts without terms have equal fingerprints.  Ids may be of
    any type with an order.  A single document is its own next one.  Rows
    that repeat are rows of their own.  An empty table gives an empty result.
    Other columns are not read.
    """
    lex = document_lexicon(docs, text_col)
    pairs = with_next_text(docs, id_col, text_col).select(
        "bucket", "place", "id", "text", edited(F.col("text"), F.col("next_text")).alias("edit")
    )
    keys, carried = ["bucket", "place"], ["id", "n_chars", "edited_sha256"]
    rows = pairs.select(
        *keys, "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "text", "edit"
    )
    found = fingerprint(rows, lex, keys, {"text": "fingerprint", "edit": "edited_fingerprint"}, carried)
    return _near_next(found).select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        "near_next",
    )


def _near_next(found: DataFrame) -> DataFrame:
    """The rows, landed, with ``near_next``, the likeness to the next row over the buckets' ring.

    Where the rows lie together by bucket they look ahead in place; the last row
    of every bucket alone is joined to the first of the bucket after.
    """
    ahead = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    looked = found.withColumn("_ahead", ahead)
    near = F.when(F.col("_ahead").isNotNull(), likeness(F.col("fingerprint"), F.col("_ahead")))
    prints = landed(looked.select(*found.columns, near.alias("near_next")), "fingerprints")
    # one row per bucket
    around = Window.orderBy("bucket")
    ring = prints.groupBy("bucket").agg(F.max("place")).select(
        F.col("bucket").alias("first_of"), F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(Window.partitionBy())).alias("bucket")
    )
    heads = prints.filter("place = 1").select(F.col("bucket").alias("first_of"), F.col("fingerprint").alias("_head"))
    crossing = prints.filter("near_next IS NULL").drop("near_next").join(ring.join(heads, "first_of").drop("first_of"), "bucket")
    closed = crossing.withColumn("near_next", likeness(F.col("fingerprint"), F.col("_head"))).drop("_head")
    return prints.filter("near_next IS NOT NULL").unionByName(closed)
