"""Token counts of sections: whole texts are encoded once and tokens attributed by their characters."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import sliced

# How the byte-level vocabulary splits a text before merging, and what counts as white space there.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The pattern steps back through a run of white space, which overflows on very long ones; those are encoded apart.
LONG_RUN = re.compile(f"[{WHITE}]{{1000,}}")
# Section of the tokens that no section gets.
OUTSIDE = -1


def default_vocabulary() -> str:
    """The installed public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding, np.ndarray]:
    """The encoder of a rank file, one that takes a text as one piece, and every token's bytes; loaded once per worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    widths[list(ranks.values())] = list(map(len, ranks))
    split, whole = (
        tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for name, pattern in (("split", PATTERN), ("whole", r"(?s).+"))
    )
    return split, whole, widths


def encode(text: str, path: str) -> list[int]:
    """Tokens of a whole text.

    Before other text a run of white space leaves its last character to what
    follows; so does a long run here.
    """
    split, whole, _ = encoding(path)
    tokens, at = [], 0
    for run in LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        tokens += split.encode_ordinary(text[at : run.start()]) + whole.encode_ordinary(text[run.start() : stop])
        at = stop
    return tokens + split.encode_ordinary(text[at:]) if tokens else split.encode_ordinary(text)


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of every token; a token inside a character spans that character."""
    widths = encoding(path)[2]
    tokens = np.asarray(encode(text, path), np.int64)
    ends = np.cumsum(widths[tokens])
    starts = ends - widths[tokens]
    data = text.encode()
    if len(data) == len(text):
        return starts, ends
    # number of the character each byte belongs to
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def attribute(first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple:
    """Interval join of tokens and sections of one text.

    Returns tokens allocated to, touching and crossing the border of each
    section, and the tokens of no section.  ``rule`` says which of the sections
    it touches a token goes to: the one with its ``first`` character (the first
    one touched, if that character has none), or the one with its ``largest``
    part (the earlier one of equals).
    """
    low = np.searchsorted(last, begin, "right")
    high = np.maximum(np.searchsorted(first, end, "left"), low)
    high = np.where(end > begin, high, low)
    touching = high - low
    section = np.repeat(np.arange(len(begin)), touching)
    token = np.arange(touching.sum()) - np.repeat(np.cumsum(touching) - touching, touching) + np.repeat(low, touching)
    shared_from, shared_to = np.maximum(first[token], begin[section]), np.minimum(last[token], end[section])
    crossing = np.bincount(section, (first[token] < begin[section]) | (last[token] > end[section]), len(begin)).astype(np.int64)
    measure = first[token] - shared_from if rule == "first" else shared_to - shared_from
    order = np.lexsort((section, begin[section], -measure, token))
    chosen = order[np.concatenate(([True], np.diff(token[order]) != 0))] if len(order) else order
    allocated = np.bincount(section[chosen], minlength=len(begin)).astype(np.int64)
    return allocated, touching.astype(np.int64), crossing, len(first) - len(chosen)


def line_sections(text: Column) -> Column:
    """One section for each line of a text, without its line end."""
    lines = F.split(text, "\n")
    joined = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("spans")),
        lambda state, line: F.struct(
            (state["at"] + F.char_length(line) + 1).alias("at"),
            F.array_append(
                state["spans"], F.struct(state["at"].alias("begin"), (state["at"] + F.char_length(line)).alias("end"))
            ).alias("spans"),
        ),
    )
    return joined["spans"]


def count_tokens(
    docs: DataFrame,
    sections_col: str | None = None,
    rule: str = "largest",
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every section of every text.

    ``sections_col`` names an ``array<struct<begin, end>>`` of character spans,
    which may leave gaps or overlap; without it each line is a section.  Returns
    one row per section, ``id_col``, ``section`` (place in the array),
    ``begin``, ``end``, ``n_tokens`` (allocated, each token to one section at
    most), ``n_touching`` and ``n_crossing``, and one row per text with section
    -1 for the tokens of no section, so that ``n_tokens`` adds up to the text's
    tokens.

    A text is encoded whole, once, by the byte-level vocabulary at
    ``vocabulary`` (a path every executor can read).  A null or empty text has
    no tokens; null sections are none, and an empty section gets none.  Repeated
    rows give repeated results, an empty table an empty one.  Other columns are
    not read.
    """
    if rule not in ("first", "largest"):
        raise ValueError("rule is 'first' or 'largest'")
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        *([F.col(f"{sections_col}.begin").alias("begin"), F.col(f"{sections_col}.end").alias("end")] if sections_col else []),
    )
    names = ["section", "begin", "end", "n_tokens", "n_touching", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for columns in sliced([batch], ["text", "begin", "end"] if sections_col else ["text"]):
                places, tables = [], []
                for text, *spans in zip(*columns):
                    text = text or ""
                    if spans:
                        begin, end = (np.array(s or [], np.int64) for s in spans)
                    else:
                        widths = np.fromiter(map(len, text.split("\n")), np.int64)
                        end = np.cumsum(widths + 1) - 1
                        begin = end - widths
                    first, last = token_spans(text, path)
                    allocated, touching, crossing, outside = attribute(first, last, begin, end, rule)
                    n = len(begin)
                    table = np.empty((6, n + 1), np.int64)
                    table[:, 0] = OUTSIDE, 0, len(text), outside, outside, 0
                    table[:, 1:] = np.arange(n), begin, end, allocated, touching, crossing
                    places.append(np.full(n + 1, at))
                    tables.append(table)
                    at += 1
                ids = batch.column("id").take(pa.array(np.concatenate(places)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in np.concatenate(tables, axis=1))], ["id", *names])

    counted = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))
    return counted.select(F.col("id").alias(id_col), *names)
