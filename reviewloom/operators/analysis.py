"""Requests for, and results of, the analysis of topics by an outside model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.replies import analysis_request, parse_reply
from reviewloom.operators.terms import first_texts, keyword_lists, topic_terms
from reviewloom.operators.topics import OUTLIER, TopicSettings, settings_json, topic_shares

KEYS = ["branch_id", "topic"]


def analysis_requests(
    topics: DataFrame,
    settings: TopicSettings = TopicSettings(),
    text_col: str = "normalized_text",
    samples: int = 20,
    counted: DataFrame | None = None,
) -> DataFrame:
    """One request per topic: share, keywords, sample texts and the prompt built from them.

    ``counted`` are the term counts that the topics were found with, if they are still there.
    """
    shares = topic_shares(topics)
    words = topic_terms(topics, text_col, stop_words=settings.words(), ngram_max=settings.ngram_max, counted=counted)
    texts = first_texts(topics.filter(F.col("topic") != OUTLIER), KEYS, text_col, n=samples)
    return (
        shares.join(keyword_lists(words.filter(F.col("topic") != OUTLIER), KEYS), KEYS, "left")
        .join(texts, KEYS, "left")
        .withColumn("top_keywords", F.coalesce("top_keywords", F.lit("")))
        .withColumn("request", analysis_request(F.col("top_keywords"), F.col("samples")))
    )


def analysis_results(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with the parsed fields of their response; a topic without one is left out.

    ``responses`` is ``(branch_id, topic_id, reply, error)``.
    """
    answers = responses.withColumnRenamed("topic_id", "topic")
    return (
        requests.drop("samples", "request")
        .join(answers, KEYS)
        .withColumn("analysis", parse_reply(F.col("reply"), F.col("error")))
        .select(
            *KEYS,
            "percentage",
            "top_keywords",
            F.col("analysis.aspect").alias("gemini_aspect"),
            F.col("analysis.sentiment").alias("gemini_sentiment"),
            F.col("analysis.summary").alias("gemini_summary"),
            F.col("analysis.recommendation").alias("gemini_recommendation"),
        )
    )


def run_headers(topics: DataFrame, results: DataFrame, branches: DataFrame, settings: TopicSettings) -> DataFrame:
    """One header per branch with results: reviews processed (outliers too) and topics analysed."""
    processed = topics.groupBy("branch_id").agg(F.count("*").cast("int").alias("number_of_reviews_processed"))
    analysed = results.groupBy("branch_id").agg(F.count("*").cast("int").alias("number_of_topics"))
    names = branches.select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    return (
        analysed.join(processed, "branch_id")
        .join(names, "branch_id")
        .withColumn("bertopic_parameters", settings_json(settings))
    )
