"""From raw documents to token identifiers, in five stages.

Each stage is a function of a session, the documents so far and the data
folder.  ``run`` writes what a stage returns to the shared folder and hands the
written rows to the next, so every stage works on all its predecessor kept and a
lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import line_dedup, mixing, pieces, quality, simhash
from reviewloom.llm.common import documents, landed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LABELS = ("lang", "source")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text has no words and goes.  Rows that repeat are judged
    alike and all stay or go; null ids and labels change nothing.
    """
    judged = quality.apply_rules(docs, carry=("text", "lang", "source", "n_chars"))
    return judged.filter("kept").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them hold.

    Every row stays; a text that was null, or all of whose lines went, is empty.
    Rows that share an id count as one document, those without an id each as one.
    """
    kept = line_dedup.dedupe_lines(docs, carry=LABELS)
    return kept.select(
        "doc_id", F.col("kept_text").alias("text"), *LABELS, F.char_length("kept_text").cast("long").alias("n_chars")
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their five-word shingles.

    The smallest id stays; documents without an id are compared like all others
    and stay only when no member has one.  All texts without a word are one
    group.  Rows with one id and different texts are different documents.
    """
    return simhash.keep_one(docs.select(*COLUMNS), (*LABELS, "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as bring the sources to their weights.

    Documents without a word weigh nothing and may go or stay; a null source is
    a source of its own.  Rows that repeat are mixed one by one.
    """
    mixed = mixing.mix_sources(docs, carry=("text", "lang", "source", "n_chars"))
    copies = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return mixed.filter(F.col("copies") > 0).withColumn("_copy", copies).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of every document, and whether they decode to its text.

    A null or empty text has no identifiers and comes back empty.  Texts go to
    the workers only; a digest of each stands beside what they decode to.
    """
    digests = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    encoded = pieces.encode(digests, carry=("_digest", "source"), with_decoded=True)
    return encoded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids",
        (F.sha2("decoded", 256) == F.col("_digest")).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

# Merge ranks, shingle hashes over groups and Newton steps have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
