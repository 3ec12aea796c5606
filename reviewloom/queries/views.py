"""The driver's tables seen as review tables: a Spark view and a SQL twin of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.text import SPACE

# parameters of the text queries
STOP_WORDS = ("the", "and", "for", "with", "that", "les", "des", "que", "der", "die", "und", "los", "las", "una")

BASE_TIME = "2025-10-15 00:00:00"
STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver.

    Its small files are one split each; a session that sets
    ``spark.reviewloom.spread`` (the local runs do, a cluster does not) deals
    their rows over that many tasks.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get("spark.reviewloom.spread", None)
    return rows.repartition(int(parts)) if parts else rows


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'))"


# reviews ------------------------------------------------------------------------------


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.expr("try_cast(substring(source, 4) AS BIGINT)").alias("branch_id"),
        F.concat(F.lit("author "), F.col("doc_id") % 97).alias("author"),
        (F.col("doc_id") % 6).cast("int").alias("rating"),
        "text",
        F.lit("").alias("review_date"),
        F.expr(f"timestamp_ntz'{BASE_TIME}' + doc_id * interval '1' minute").alias("scraped_at"),
        "lang",
        "source",
    )


REVIEWS = f"""reviews AS (
  SELECT doc_id AS review_id, TRY_CAST(substr(source, 4) AS BIGINT) AS branch_id, 'author ' || (doc_id % 97) AS author,
         CAST(doc_id % 6 AS INT) AS rating, text, '' AS review_date,
         TIMESTAMP '{BASE_TIME}' + doc_id * INTERVAL 1 MINUTE AS scraped_at, lang, source
  FROM documents)"""


# branches, run headers, insights ----------------------------------------------------------


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("branch "), F.col("c_custkey") % 500).alias("name"),
        null.alias("address"),
        F.col("c_custkey").cast("string").alias("place_id"),
        null.alias("phone"),
        null.alias("lat"),
        null.alias("lng"),
        F.concat(F.lit("https://maps.example/place/"), F.col("c_custkey")).alias("url"),
        F.expr(
            f"CASE WHEN c_acctbal >= 0 THEN timestamp_ntz'{BASE_TIME}' "
            "+ (c_custkey * 7919 % 10007) * interval '1' minute END"
        ).alias("scraped_at"),
    )


BRANCHES = f"""branches AS (
  SELECT c_custkey AS id, 'branch ' || (c_custkey % 500) AS name, CAST(c_custkey AS VARCHAR) AS place_id,
         'https://maps.example/place/' || c_custkey AS url,
         CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '{BASE_TIME}' + (c_custkey * 7919 % 10007) * INTERVAL 1 MINUTE END AS scraped_at
  FROM customer)"""


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("meta_id"),
        F.col("o_custkey").alias("branch_id"),
        F.concat(F.lit("branch "), F.col("o_custkey") % 500).alias("branch_name"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, (o_orderkey % 3) / 1000000bd)").alias("analysis_date"),
    )


META = """meta AS (
  SELECT o_orderkey AS meta_id, o_custkey AS branch_id, 'branch ' || (o_custkey % 500) AS branch_name,
         o_orderdate + to_microseconds(o_orderkey % 3) AS analysis_date FROM orders)"""


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("meta_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("int").alias("topic_id"),
        F.col("l_quantity").cast("decimal(5,2)").alias("percentage"),
        F.concat_ws(", ", "l_returnflag", "l_linestatus").alias("top_keywords"),
        F.concat(F.lit("part "), F.col("l_partkey")).alias("gemini_aspect"),
        F.col("l_returnflag").alias("gemini_sentiment"),
        F.concat(F.lit("supplier "), F.col("l_suppkey")).alias("gemini_summary"),
        F.col("l_linestatus").alias("gemini_recommendation"),
    )


INSIGHTS = """insights AS (
  SELECT l_orderkey AS meta_id, CAST(l_partkey * 10 + l_linenumber AS INT) AS topic_id,
         CAST(l_quantity AS DECIMAL(5,2)) AS percentage, l_returnflag || ', ' || l_linestatus AS top_keywords,
         'part ' || l_partkey AS gemini_aspect, l_returnflag AS gemini_sentiment,
         'supplier ' || l_suppkey AS gemini_summary, l_linestatus AS gemini_recommendation
  FROM lineitem)"""


# collected pages: twenty reviews of a branch to a page ------------------------------------


def escaped(text):
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def pages_of(spark: SparkSession, sf_dir: str, block, head=None) -> DataFrame:
    """Pages whose markup is ``head`` and then ``block`` (expressions over a review) per review, by id."""
    rows = reviews(spark, sf_dir).withColumn("page_no", F.expr("review_id div 400"))
    key = ["branch_id", "page_no"]
    body = F.array_sort(F.collect_list(F.struct("review_id", block.alias("block"))))
    grouped = rows.groupBy(*key).agg(F.array_join(F.transform(body, lambda b: b["block"]), "").alias("body"))
    start = F.lit("<!DOCTYPE html><html><body>") if head is None else head
    return grouped.select(
        (F.col("page_no") * 1000 + F.col("branch_id")).alias("page_id"),
        F.concat(F.lit("https://maps.example/maps/place/"), "branch_id", F.lit("/"), "page_no").alias("url"),
        F.concat(start, "body", F.lit("<p>end</body></html>")).alias("html"),
        F.lit(0).alias("snapshot_no"),
        F.lit(f"{BASE_TIME[:10]} 12:00:00").cast("timestamp").alias("fetched_at"),
    )


PAGED = f"""{REVIEWS}, paged AS (
  SELECT *, (review_id // 400) * 1000 + branch_id AS page_id,
         'https://maps.example/maps/place/' || branch_id || '/' || (review_id // 400) AS url,
         review_id // 400 AS page_no,
         row_number() OVER (PARTITION BY branch_id, review_id // 400 ORDER BY review_id) - 1 AS block_no,
         {sql_strip('text')} AS stripped
  FROM reviews)"""
