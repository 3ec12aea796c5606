"""Quality rules from repetition: characters inside duplicated word runs and lines."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import SLICE_ROWS

# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
# Multiplier of the rolling hash, odd so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are of the characters in words.  All may be changed by a caller.

    The shares are the published ones.  Only later occurrences count, the first one is no repetition, and words of a
    repeated line count for the share of lines alone: a short text with the same line at its head and foot stays below.
    """

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    duplicate_share: dict[int, float] = field(
        default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    )
    duplicate_line_share: float = 0.20


def _powers(base: int, n: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006 - kept per worker
    if len(known := cache.get(base, np.ones(0, np.uint64))) < n:
        with np.errstate(over="ignore"):
            known = np.full(2 * max(n, 1024), base, np.uint64)
            known[0] = 1
            cache[base] = known = np.cumprod(known)
    return known[:n]


def rolling(values: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all runs of each length, from one prefix sum of ``value * BASE ** place``."""
    n = len(values)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(BASE, n), dtype=np.uint64)])
        shift = _powers(INVERSE, n)
        return {k: (prefix[k:] - prefix[:-k]) * shift[: n - k + 1] for k in lengths if k <= n}


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs occur at least twice, and which of them have occurred before."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    later = np.zeros(len(hashes), bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


def covered(runs: np.ndarray, length: int, n_words: int) -> np.ndarray:
    """Which words lie inside a marked run."""
    edges = np.zeros(n_words + 1, np.int64)
    starts = np.flatnonzero(runs)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None, rules: Rules) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, shares per length, of lines, and of later runs outside them."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    seen, again, n_dup_lines, dup_chars = set(), [], 0, 0
    for line in data.split(b"\n"):
        if (line and not line.isspace()) and line.split():
            if line in seen:
                n_dup_lines += 1
                dup_chars += sum(len(w.decode()) for w in line.split())
            again.append((line, line in seen))
            seen.add(line)
    n_symbols = sum(map(data.count, [bytes([c]) for c in SYMBOLS]))
    if data.isascii():
        chars = np.fromiter(map(len, words), np.int64, n)
    else:
        chars = np.fromiter((len(w.decode()) for w in words), np.int64, n)
    total = int(chars.sum())
    lengths = sorted({rules.window, *rules.duplicate_share})
    ids: dict[bytes, int] = {}
    # distinct words get distinct numbers; mixing spreads them over 64 bits
    places = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    with np.errstate(over="ignore"):
        values = (places + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xA0761D6478BD642F)
        values ^= values >> np.uint64(32)
    elsewhere = np.ones(n, bool)
    if n_dup_lines:
        elsewhere = np.repeat([not twice for _, twice in again], [len(line.split()) for line, _ in again])
    shares, extra, n_repeat = dict.fromkeys(rules.duplicate_share, 0.0), dict.fromkeys(rules.duplicate_share, 0.0), 0
    for k, hashes in sorted(rolling(values, lengths).items()):
        twice, later = repeated(hashes)
        if not later.any():
            # no longer run can occur twice either
            break
        inside = covered(twice, k, n)
        if k == rules.window:
            n_repeat = int(inside.sum())
        if k in shares:
            shares[k] = float(chars[inside].sum() / total)
            extra[k] = float(chars[covered(later, k, n) & elsewhere].sum() / total)
    by_length = [[part[k] for k in sorted(part)] for part in (shares, extra)]
    return n, total, n_symbols, n_dup_lines, n_repeat, by_length[0], dup_chars / total if total else 0.0, by_length[1]


def apply_rules(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """Measures and verdict of every text.

    Returns ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``dup_ngram_shares`` (by run length in
    ascending order, all occurrences), ``dup_line_share``, ``later_ngram_shares``
    (occurrences after the first, outside repeated lines), ``base_failed``,
    ``kept`` and the ``carry`` columns.  A text is kept when the base rule holds
    and neither the characters inside later runs nor those in repeated lines
    exceed their share.

    A null text is an empty one: no words, so the base rule fails.  Repeated rows
    give repeated results, an empty table an empty one.  Texts are measured one
    at a time and whole.  Only the text goes to the Python workers and only the
    measures come back; other columns stay where they are.
    """
    rules = rules or Rules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_ngram_shares", "dup_line_share", "later_ngram_shares"]
    types = [*[pa.int64()] * 5, pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64())]

    def run(texts: pa.Array) -> pa.Array:
        found = [measure(t, rules) for at in range(0, len(texts), SLICE_ROWS) for t in texts.slice(at, SLICE_ROWS).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)], names)

    # set for the return type and the argument, which annotations would hide behind strings
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    measured = F.arrow_udf(
        run,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "dup_ngram_shares array<double>, dup_line_share double, later_ngram_shares array<double>",
    )
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("carry"),
        measured(F.col(text_col).cast("string")).alias("measures"),
    )
    limits = [rules.duplicate_share[k] for k in sorted(rules.duplicate_share)]
    m = F.col("measures")
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    within = F.forall(
        F.zip_with(m["later_ngram_shares"], F.lit(limits), lambda share, limit: share <= limit), lambda good: good
    )
    return rows.select(
        F.col("id").alias(id_col),
        *(m[n].alias(n) for n in names),
        failed.alias("base_failed"),
        (~failed & within & (m["dup_line_share"] <= rules.duplicate_line_share)).alias("kept"),
        *(F.col(f"carry.{c}").alias(c) for c in carry),
    )
