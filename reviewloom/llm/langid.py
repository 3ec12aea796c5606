"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import sliced

UNKNOWN = "und"
# Buckets of the hashed subwords, width of an embedding, lengths of the subwords in characters.
BUCKETS, WIDTH, LENGTHS = 4096, 24, (1, 2, 3, 4)
# The classifier is fitted on at most this many labelled documents, the same share of them for every language.
MAX_SAMPLE = 6_000
MAX_LANGUAGES = 256
EPOCHS, BATCH, RATE, DECAY = 30, 64, 40.0, 1e-6
# Share of the sample that is kept for calibration, and the precision that accepted answers should have there.
CALIBRATION, PRECISION = 5, 0.995
SPACE = np.uint32(32)


def subwords(text: str) -> np.ndarray:
    """How often each bucket's subwords occur in a whole text.

    Letters are lower-cased, anything else is one space; subwords may begin or
    end at a space but not reach across one.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes < 0x2C00)) & ~(
        (codes >= 0x3000) & (codes < 0x3040)
    ) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letter, codes, SPACE)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    codes = codes[keep]
    space = codes == SPACE
    counts = np.zeros(BUCKETS, np.int64)
    rolled = np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for k in LENGTHS:
            n = len(codes) - k + 1
            if n <= 0:
                break
            rolled = rolled[:n] * np.uint32(0x01000193) + codes[k - 1 :]
            inner = ~space[:n] if k == 1 else np.ones(n, bool)
            for j in range(1, k - 1):
                inner &= ~space[j : n + j]
            mixed = (rolled[inner] ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            counts += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Languages, the joined linear map of buckets to languages, biases, temperature and the least accepted score."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; the mean of the embeddings is linear, so both maps are one."""
        logits = (counts @ self.weights / max(1, counts.sum()) + self.bias) / self.temperature
        odds = np.exp(logits - logits.max())
        return odds / odds.sum()


def softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def train(counts: np.ndarray, labels: np.ndarray, languages: list[str], held: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax by stochastic gradient descent; temperature and threshold from the ``held`` rows."""
    draw = np.random.default_rng(seed)
    means = counts / np.maximum(1, counts.sum(axis=1, keepdims=True)).astype(np.float32)
    embed = draw.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(labels))
    share = np.bincount(labels[fit], minlength=len(languages)).astype(np.float32)
    weight = (len(fit) / np.maximum(1, share) / max(1, (share > 0).sum())).astype(np.float32)
    total, done = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        for at in range(0, len(order := draw.permutation(fit)), BATCH):
            rows = order[at : at + BATCH]
            mean = means[rows]
            hidden = mean @ embed
            error = softmax(hidden @ out + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error *= (weight[labels[rows]] / len(rows))[:, None]
            rate = np.float32(RATE * (1 - done / total))
            back = error @ out.T
            out -= rate / 8 * (hidden.T @ error + DECAY * out)
            embed -= rate * (mean.T @ back + DECAY * embed)
            bias -= rate / 40 * error.sum(axis=0)
            done += 1
    check = np.flatnonzero(held) if held.any() else fit
    logits, truth = means[check] @ embed @ out + bias, labels[check]
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), truth], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    chances = softmax(logits / temperature)
    order = np.argsort(-chances.max(axis=1), kind="stable")
    precise = np.cumsum((chances.argmax(axis=1) == truth)[order]) / np.arange(1, len(order) + 1) >= PRECISION
    # the lowest score above which answers are precise enough; none is accepted if there is no such score
    threshold = float(chances.max(axis=1)[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return Model(languages, (embed @ out).astype(np.float64), bias.astype(np.float64), temperature, threshold)


def labelled_sample(docs: DataFrame, labels_of: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int) -> tuple:
    """Counts, labels and languages of a bounded sample: for every language the documents with the smallest id hashes.

    Hashes are even, so those of a language that can be among its smallest lie
    below a bound that follows from its number of documents; only about twice
    as many rows as are wanted pass it and meet to be ranked.
    """
    counted = labels_of.groupBy(lang_col).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    sizes = {r[lang_col]: r["n"] for r in counted}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; clean the column first")
    names = sorted(sizes)
    if not names:
        return np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64), [], np.zeros(0, bool)
    wanted = max(1, limit // len(names))
    bounds = {n: -(2.0**63) + 2.0**64 * min(1.0, (2 * wanted + 50) / sizes[n]) for n in names}
    bound = F.try_element_at(F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)), F.col("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    chosen = (
        labels_of.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("draw"))
        .filter(F.col("draw") <= bound)
        .withColumn("place", place)
        .filter(F.col("place") <= wanted)
        .select("id", "lang", "draw")
    )
    # at most ``limit`` ids; a repeated id counts once
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen.dropDuplicates(["id"])), "id")
        .select("id", "text", "lang", "draw")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lists = [], []
            at = 0
            for (texts,) in sliced([batch], ["text"]):
                for text in texts:
                    if has_letter(text):
                        counts = subwords(text)
                        places = np.flatnonzero(counts)
                        kept.append(at)
                        lists.append((places.astype("<u2").tobytes() + counts[places].astype("<u4").tobytes()))
                    at += 1
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("draw"), part.column("id"), pa.array(lists, pa.binary())],
                ["lang", "draw", "id", "counts"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"lang string, draw long, id {kind}, counts binary").collect()
    got.sort(key=lambda r: (r["draw"], r["id"], bytes(r["counts"])))
    counts = np.zeros((len(got), BUCKETS), np.float32)
    for i, row in enumerate(got):
        n = len(row["counts"]) // 6
        data = bytes(row["counts"])
        counts[i, np.frombuffer(data[: 2 * n], "<u2")] = np.frombuffer(data[2 * n :], "<u4")
    labels = np.array([names.index(r["lang"]) for r in got], np.int64)
    held = np.array([r["draw"] % CALIBRATION == 0 for r in got], bool)
    return counts, labels, names, held


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = MAX_SAMPLE) -> Model | None:
    """A model from the labelled documents (ids and languages), or None when nothing can be learned."""
    counts, labels, names, held = labelled_sample(docs, labelled, id_col, text_col, lang_col, limit)
    return train(counts, labels, names, held) if len(labels) else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text.

    Returns ``id_col``, ``lang_pred``, ``score`` (calibrated probability of the
    language) and ``rejected`` (the score is below the model's threshold, so the
    answer should not be relied on).  A text that is null or has no letter is
    ``und`` with score 0 and rejected, and so is every text without a model.
    Repeated rows give repeated results, an empty table an empty one.  Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def answer(text: str | None) -> tuple[str, float, bool]:
        if model is None or not has_letter(text):
            return UNKNOWN, 0.0, True
        chances = model.scores(subwords(text))
        best = int(chances.argmax())
        return model.languages[best], float(chances[best]), bool(chances[best] < model.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [answer(t) for (texts,) in sliced([batch], ["text"]) for t in texts]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "lang_pred", "score", "rejected"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double, rejected boolean"
    )
    return found.select(F.col("id").alias(id_col), "lang_pred", "score", "rejected")
