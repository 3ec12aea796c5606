"""Words of whole Arrow batches as hashes, in numpy: boundaries, hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# The white space between words.
SPACE_BYTES = b" \t\n\x0b\f\r"
# Odd multipliers, so that each has an inverse modulo 2 ** 64.
BYTE_BASE = 0x9E3779B97F4A7C15
RUN_BASE, LEAF_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
# Bytes that are looked at together; a longer text is cut between two of its words.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_known: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 … base ** (n - 1)`` modulo 2 ** 64; kept, and grown by doubling."""
    known = _known.get(base)
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.full(max(n, 1024, 2 * (0 if known is None else len(known))), base, np.uint64)
            known[0] = 1
            _known[base] = known = np.cumprod(known)
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a value spread over all 64."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about ``CHUNK_BYTES`` that end between two words."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK_BYTES, n)
        stop = int(offsets[min(np.searchsorted(offsets, end), len(offsets) - 1)])
        while end < stop and not _SPACE[data[end]]:
            end += 1
        yield at, end
        at = end


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and where each text's words begin (one entry more than texts).

    Nulls have no words.  A word is a run of bytes other than white space; its
    hash is a polynomial over its bytes, taken from running sums.
    """
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    hashes, firsts = [], []
    for at, end in _chunks(data, offsets):
        part = data[at:end]
        space = _SPACE[part]
        low, high = np.searchsorted(offsets, [at, end])
        inner = offsets[low:high] - at
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, space[:-1]
        before[inner] = True
        starts = np.flatnonzero(before & ~space)
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, space[1:]
        after[inner[inner > 0] - 1] = True
        ends = np.flatnonzero(after & ~space)
        with np.errstate(over="ignore"):
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, len(part)), out=sums[1:])
            hashes.append(mixed((sums[ends + 1] - sums[starts]) * powers(inverse(BYTE_BASE), len(part))[starts]))
        firsts.append(starts + at)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begins = np.searchsorted(np.concatenate(firsts), offsets) if firsts else np.zeros(len(offsets), np.int64)
    return words, begins.astype(np.int64)


class Runs:
    """Hashes of all runs of words of any one length, from one running sum."""

    def __init__(self, words: np.ndarray, base: int = RUN_BASE):
        self.n, self.base = len(words), base
        with np.errstate(over="ignore"):
            self.sums = np.empty(self.n + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(words * powers(base, max(self.n, 1))[: self.n], out=self.sums[1:])

    def of(self, length: int) -> np.ndarray:
        """One hash for each place at which ``length`` words begin."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        count = self.n - length + 1
        with np.errstate(over="ignore"):
            return mixed((self.sums[length:] - self.sums[:count]) * powers(inverse(self.base), count))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        span += step
    return values
