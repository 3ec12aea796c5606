"""SentencePiece encoding and decoding with one forward pass per distinct prefix."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import SLICE_ROWS

# Fixed value: the mark that stands for a space.
MARK = "▁"
# Distinct words whose pieces a worker keeps, and pairs of pieces it remembers.
KEPT_WORDS = 400_000
KEPT_PAIRS = 500_000


def default_model() -> str:
    """The installed public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def word_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Marked words: a run of marks and what follows it; a character of no longer piece stands alone."""
    joined = {c for piece in pieces if len(piece) > 1 for c in piece} - {MARK}
    inside = f"[{''.join(map(re.escape, sorted(joined)))}]" if joined else "(?!)"
    return re.compile(f"{MARK}*{inside}+|{MARK}+|.", re.DOTALL)


def marked(text: str) -> str:
    """The text with a mark in front and for every space."""
    return MARK + text.replace(" ", MARK) if text else ""


class Lattice:
    """Vocabulary of a model and the forward state of every prefix of a marked word.

    ``kind`` is the model's: for ``unigram`` the state of a prefix is its best
    score and last piece (Viterbi).  A ``bpe`` model has merge ranks instead of
    scores that add up, and summing them would choose other pieces; there the
    last piece of a prefix is the one that its predecessor is not merged with,
    which is unique, so the same pass gives the model's merges.  Both states
    depend on the prefix alone, so words that share a prefix share its states.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], kind: str, byte_ids: list[int], unknown: int):
        self.pieces, self.kind, self.byte_ids, self.unknown = pieces, kind, byte_ids, unknown
        self.apart: dict[int, bool] = {}
        self.least = min((score for _, score in pieces.values()), default=0.0) - 10.0
        # pieces by number; characters that are no piece are numbered as they come
        self.names = [name for name in pieces if kind == "unigram" or self.merged(name) == [name]]
        self.numbers = {name: k for k, name in enumerate(self.names)}
        self.own = [packed([pieces[name][0]]) for name in self.names]
        self.matcher = ahocorasick.Automaton()
        for name, k in self.numbers.items():
            self.matcher.add_word(name, (len(name), k, pieces[name][1]))
        if self.names:
            self.matcher.make_automaton()

    def merged(self, text: str) -> list[str]:
        """``text`` merged pair by pair: the best ranked pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                known = self.pieces.get(parts[i] + parts[i + 1])
                if known and (best is None or known[1] > best):
                    best, at = known[1], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays_apart(self, pair: int) -> bool:
        """Whether two pieces next to each other (their numbers in one) stay as they are."""
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        names = [self.names[pair >> 32], self.names[pair & 0xFFFFFFFF]]
        known = self.apart[pair] = self.merged("".join(names)) == names
        return known

    def number(self, char: str) -> int:
        """Number of a single character, also of one that is no piece."""
        if (known := self.numbers.get(char)) is None:
            known = self.numbers[char] = len(self.names)
            self.names.append(char)
        return known

    def forward(self, word: str, shared: int, states: list[tuple]) -> None:
        """Append the states of the prefixes of ``word`` longer than ``shared``: (score, start and number of the last piece)."""
        unigram, apart = self.kind == "unigram", self.apart
        best, at = None, shared + 1
        for last, (width, number, score) in self.matcher.iter(word) if self.names else ():
            end = last + 1
            if end < at:
                continue
            while end > at:
                states.append(best or self.alone(word, at, states))
                best, at = None, at + 1
            start = end - width
            if unigram:
                score += states[start][0]
                if best is None or score > best[0]:
                    best = (score, start, number)
            elif best is None:
                if start:
                    pair = states[start][2] << 32 | number
                    if (good := apart.get(pair)) is None:
                        good = self.stays_apart(pair)
                    if not good:
                        continue
                best = (0.0, start, number)
        while at <= len(word):
            states.append(best or self.alone(word, at, states))
            best, at = None, at + 1

    def alone(self, word: str, end: int, states: list[tuple]) -> tuple:
        """State of a prefix whose last character is in no piece that ends there."""
        return (states[end - 1][0] + self.least, end - 1, self.number(word[end - 1]))

    def ids(self, number: int) -> bytes:
        """Identifier of a piece, or those of a character's bytes."""
        if number < len(self.own):
            return self.own[number]
        name = self.names[number].encode()
        return packed([self.byte_ids[b] for b in name] if self.byte_ids else [self.unknown])

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Identifiers of every distinct word, as 32-bit numbers.

        The sorted words are the depth-first order of their trie: the stack of
        forward states is cut back to the prefix shared with the word before,
        and only the characters after it get new ones.
        """
        found: dict[str, bytes] = {}
        states: list[tuple] = [(0.0, 0, -1)]
        before, ids = "", self.ids
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            self.forward(word, shared, states)
            numbers, end = [], len(word)
            while end:
                _, end, number = states[end]
                numbers.append(number)
            numbers.reverse()
            found[word] = b"".join(map(ids, numbers))
            before = word
        return found


def model_kind(path: str) -> str:
    """``unigram`` or ``bpe``: field 3 of the trainer settings (field 2) of the model file."""

    def fields(data: bytes) -> Iterator[tuple[int, object]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            elif key & 7 == 2:
                size = varint()
                yield key >> 3, data[at : at + size]
                at += size
            else:
                at += 4 if key & 7 == 5 else 8

    with open(path, "rb") as file:
        settings = next(value for number, value in fields(file.read()) if number == 2)
    return {1: "unigram", 2: "bpe"}[next((v for number, v in fields(settings) if number == 3), 1)]


class Codec:
    """Encoder and decoder of one model; loaded once per worker."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        bytes_first = [i for i in range(size) if model.is_byte(i)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
        pieces = {names[i]: (i, model.get_score(i)) for i in range(size) if i not in special}
        if any(MARK in name.lstrip(MARK) for name in pieces):
            raise ValueError("pieces that reach over a word's end are not supported")
        self.words = word_pattern(pieces).findall
        self.lattice = Lattice(pieces, model_kind(path), bytes_first, model.unk_id())
        self.raw = [b"" if i in special else names[i].replace(MARK, " ").encode() for i in range(size)]
        for value, i in enumerate(bytes_first):
            self.raw[i] = bytes([value])
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Identifiers of several texts; their new distinct words are encoded together."""
        split = [self.words(marked(t)) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        self.known |= self.lattice.encode_words(set().union(*split) - self.known.keys())
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of identifiers; byte pieces join to UTF-8, and the first mark is not part of the text."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(
    docs: DataFrame,
    model: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple = (),
    with_decoded: bool = False,
) -> DataFrame:
    """Pieces of every whole text, as the model's own encoder gives them.

    Returns ``id_col``, ``ids``, with ``with_decoded`` also ``decoded``, the text
    made from them again, and the ``carry`` columns.  ``model`` is a path every
    executor can read; the model must keep texts as they are (identity
    normalisation, a mark put in front).  A null or empty text has no pieces.
    Repeated rows give repeated results, an empty table an empty one.  Other
    columns are not read.
    """
    path = model or default_model()
    kind = docs.schema[id_col].dataType.simpleString()
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), carried.alias("carry"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = codec(path).encode([t or "" for t in part.column("text").to_pylist()])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [part.column("id"), part.column("carry"), lists]
                if with_decoded:
                    columns.append(pa.array(map(codec(path).decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "carry", "ids", "decoded"][: len(columns)])

    carry_kind = rows.schema["carry"].dataType.simpleString()
    schema = f"id {kind}, carry {carry_kind}, ids array<int>" + ", decoded string" * with_decoded
    encoded = rows.mapInArrow(run, schema)
    decoded = ["decoded"] if with_decoded else []
    return encoded.select(F.col("id").alias(id_col), "ids", *decoded, *(F.col(f"carry.{c}").alias(c) for c in carry))


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple = ()) -> DataFrame:
    """``id_col``, ``decoded`` and the ``carry`` columns; null identifiers decode to an empty text."""
    path = model or default_model()
    kind = encoded.schema[id_col].dataType.simpleString()
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("string")
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), carried.alias("carry"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                lists = [np.array(ids or [], np.int32) for ids in part.column("ids").to_pylist()]
                texts = pa.array(map(codec(path).decode, lists), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("carry"), texts], ["id", "carry", "decoded"])

    carry_kind = rows.schema["carry"].dataType.simpleString()
    decoded = rows.mapInArrow(run, f"id {kind}, carry {carry_kind}, decoded string")
    return decoded.select(F.col("id").alias(id_col), "decoded", *(F.col(f"carry.{c}").alias(c) for c in carry))
