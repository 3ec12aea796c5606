"""Language of a text, and replacement of foreign texts from a translation table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import text_key
from reviewloom.session import land

GRAM = 3
# Languages a model may know, and numbers of a model that reach the driver and the executors; a larger model stays a table.
MAX_LANGUAGES, MODEL_CELLS = 64, 1 << 24
# Texts whose runs a task holds at one time.
SLICE_TEXTS = 256


@dataclass(frozen=True)
class LanguageModel:
    """Naive Bayes over runs of characters.

    ``counts`` is the written table ``(run, lang, n)`` of all runs; ``runs`` and
    ``logs`` hold the same, a row of log probabilities for each run, where that
    is small enough to be sent to every task.
    """

    languages: tuple[str, ...]
    priors: np.ndarray
    bases: np.ndarray
    counts: DataFrame | None = None
    runs: np.ndarray | None = None
    logs: np.ndarray | None = None


def runs_of(text: str | None) -> np.ndarray:
    """Every run of three characters of a text, repeats included, as one number of three code points."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    return points[:-2] | points[1:-1] << 21 | points[2:] << 42


def fit_language(samples: DataFrame, text_col: str = "text", lang_col: str = "lang", max_runs: int | None = None) -> LanguageModel:
    """Naive Bayes over overlapping runs of three characters, fitted on labelled texts.

    All runs of all texts count, at any size of the samples; their counts are a
    written table, of which at most ``MODEL_CELLS`` numbers reach the driver.
    Where a caller sets ``max_runs``, more runs are an error.
    """
    labelled = samples.filter(F.col(lang_col).isNotNull())
    texts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    languages = sorted(texts)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; clean the label column first")
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros(0))
    number = F.array_position(F.array(*map(F.lit, languages)), F.col(lang_col)) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_TEXTS):
                part = batch.slice(at, SLICE_TEXTS)
                langs = part.column("lang").to_numpy(zero_copy_only=False)
                found = [runs_of(t.as_py()) for t in part.column("text")]
                for lang in np.unique(langs).tolist():
                    runs, times = np.unique(np.concatenate([found[k] for k in np.flatnonzero(langs == lang)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), lang)), pa.array(runs), pa.array(times)], ["lang", "run", "n"])

    rows = labelled.select(number.cast("long").alias("lang"), F.lower(F.col(text_col)).alias("text"))
    sums = rows.mapInArrow(count, "lang long, run long, n long").groupBy("run", "lang").agg(F.sum("n").alias("n"))
    counts = land(sums, "language-runs")
    n_runs = counts.select("run").distinct().count()
    if max_runs is not None and n_runs > max_runs:
        raise ValueError(f"more than {max_runs} runs of {GRAM} characters")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    priors = np.log(np.array([texts[x] / sum(texts.values()) for x in languages]))
    bases = -np.log(np.array([totals.get(k, 0) + n_runs for k in range(len(languages))], float).clip(1))
    if n_runs * len(languages) > MODEL_CELLS:
        return LanguageModel(tuple(languages), priors, bases, counts)
    run, lang, n = (counts.toArrow().column(c).to_numpy() for c in ("run", "lang", "n"))
    runs, at = np.unique(run, return_inverse=True)
    logs = np.zeros((len(runs), len(languages)))
    logs[at, lang] = np.log1p(n)
    return LanguageModel(tuple(languages), priors, bases, counts, runs, logs + bases)


def detect_language(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_guess``, the most likely language of the whole text; null for a text without any known run.

    Scoring is one step over the rows, from which only the text goes to the
    workers: nothing is exploded, joined or shuffled.  Only for a model too
    large to be sent the texts' runs meet its table in a join.
    """
    if not model.languages:
        return df.withColumn("lang_guess", F.lit(None).cast("string"))
    if model.runs is None:
        return _detect_by_join(df, model, text_col)
    known = df.sparkSession.sparkContext.broadcast((model.runs, model.logs, model.priors, model.languages))

    def guess(texts: pa.Array) -> pa.Array:
        runs, logs, priors, languages = known.value
        out = []
        for text in texts:
            mine = runs_of(text.as_py())
            if not len(runs) or not len(mine):
                out.append(None)
                continue
            at = np.searchsorted(runs, mine)
            at[at == len(runs)] = 0
            found, times = np.unique(at[runs[at] == mine], return_counts=True)
            out.append(languages[int(np.argmax(priors + times @ logs[found]))] if len(found) else None)
        return pa.array(out, pa.string())

    guess.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn("lang_guess", F.arrow_udf(guess, "string")(F.lower(F.col(text_col))))


def _detect_by_join(df: DataFrame, model: LanguageModel, text_col: str) -> DataFrame:
    """The same from the table of counts: runs of the texts, summed up per text and language."""
    rows = land(df.withColumn("_row", F.monotonically_increasing_id()), "language-rows")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text")):
                runs, times = np.unique(runs_of(text.as_py()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), row)), pa.array(runs), pa.array(times)], ["_row", "run", "times"])

    own = rows.select("_row", F.lower(F.col(text_col)).alias("text")).mapInArrow(taken, "_row long, run long, times long")
    # a run that a language has not seen adds the logarithm of one, so only known ones have to be met
    table = model.counts.groupBy("run").agg(F.collect_list(F.struct("lang", F.log1p("n").alias("log"))).alias("seen"))
    met = own.join(table, "run")
    per_row = met.groupBy("_row").agg(F.sum("times").alias("known"))
    sums = met.select("_row", "times", F.explode("seen").alias("s")).groupBy("_row", F.col("s.lang").alias("lang")).agg(
        F.sum(F.col("times") * F.col("s.log")).alias("log")
    )
    languages = F.array(*(
        F.struct(F.lit(k).cast("long").alias("lang"), F.lit(float(p)).alias("prior"), F.lit(float(b)).alias("base"))
        for k, (p, b) in enumerate(zip(model.priors, model.bases))
    ))
    every = per_row.select("_row", "known", F.explode(languages).alias("l")).select("_row", "known", "l.*")
    score = F.col("prior") + F.col("known") * F.col("base") + F.coalesce("log", F.lit(0.0))
    best = every.join(sums, ["_row", "lang"], "left").groupBy("_row").agg(
        F.max(F.struct(score.alias("score"), (-F.col("lang")).alias("minus"))).alias("best")
    )
    name = F.get(F.array(*map(F.lit, model.languages)), (-F.col("best.minus")).cast("int"))
    return rows.join(best.select("_row", name.alias("lang_guess")), "_row", "left").select(*df.columns, "lang_guess")


def agreement(detected: DataFrame, by: Sequence[str], lang_col: str = "lang") -> DataFrame:
    """Texts and rightly labelled ones per group."""
    right = F.count_if(F.coalesce(F.col("lang_guess") == F.col(lang_col), F.lit(False)))
    return detected.groupBy(*by).agg(F.count("*").alias("texts"), right.alias("right"))


def translate_from(reviews: DataFrame, memory: DataFrame, needs: Column, text_col: str = "original_text") -> DataFrame:
    """``normalized_text``: the stored translation where ``needs`` holds and one exists, else the text.

    ``memory`` is ``(text, translated)``.  Only texts that need a translation
    take part in the join, by hash; all others pass through without a shuffle.
    """
    needed = F.coalesce(needs, F.lit(False))
    known = memory.groupBy(text_key(F.col("text")).alias("_key")).agg(F.min("translated").alias("_translated"))
    foreign = (
        reviews.filter(needed)
        .withColumn("_key", text_key(F.col(text_col)))
        .join(known, "_key", "left")
        .withColumn("normalized_text", F.coalesce("_translated", text_col))
        .drop("_key", "_translated")
    )
    return reviews.filter(~needed).withColumn("normalized_text", F.col(text_col)).unionByName(foreign)


def pending_translations(reviews: DataFrame, memory: DataFrame, needs: Column, text_col: str = "original_text") -> DataFrame:
    """Distinct texts still without a translation: the work list for whoever fills the memory."""
    wanted = reviews.filter(needs).select(F.col(text_col).alias("text")).distinct()
    known = memory.select(text_key(F.col("text")).alias("_key"))
    return wanted.withColumn("_key", text_key(F.col("text"))).join(known, "_key", "left_anti").drop("_key")
