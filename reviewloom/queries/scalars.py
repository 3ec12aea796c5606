"""Expressions over whole texts, labels and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions.dates import relative_date
from reviewloom.functions.ratings import rating_from_label, rating_single_digit
from reviewloom.functions.replies import UNPARSED, parse_reply
from reviewloom.functions.text import arabic_share, keep_english, normalize_simple, or_default, snippet, text_key
from reviewloom.functions.urls import place_id, unwrap_redirect
from reviewloom.operators import reports
from reviewloom.operators.topics import TopicSettings, settings_json
from reviewloom.queries.registry import query
from reviewloom.queries.views import REVIEWS, reviews, sql_collapse, sql_strip, table
from reviewloom.functions.text import SPACE

SQL_ENGLISH = f"""{sql_collapse(
    "regexp_replace(regexp_replace(CASE WHEN contains(text, '(Original)') THEN split_part(text, '(Original)', 1) "
    "WHEN contains(text, '(original)') THEN split_part(text, '(original)', 1) ELSE text END, "
    "'(?i)\\(Translated by Google\\)', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g')")}"""

# every third review carries the markers that page translation leaves
MARKED_SQL = """marked AS (
  SELECT review_id, branch_id, CASE review_id % 6
    WHEN 0 THEN '(Translated by Google) ' || text || ' (Original) ' || reverse(text)
    WHEN 3 THEN text || '(original)' || text || '(Original)' ELSE text END AS text FROM reviews)"""


def marked(spark, sf):
    text, number = F.col("text"), F.col("review_id") % 6
    both = (
        F.when(number == 0, F.concat(F.lit("(Translated by Google) "), text, F.lit(" (Original) "), F.reverse(text)))
        .when(number == 3, F.concat(text, F.lit("(original)"), text, F.lit("(Original)")))
        .otherwise(text)
    )
    return reviews(spark, sf).withColumn("text", both)


@query(f"WITH {REVIEWS} SELECT review_id, lower({sql_collapse('text')}) AS normalized_text FROM reviews")
def normalize_simple_text(spark, sf):
    return reviews(spark, sf).select("review_id", normalize_simple(F.col("text")).alias("normalized_text"))


@query(f"""WITH {REVIEWS}, {MARKED_SQL}, cleaned AS (SELECT review_id, {SQL_ENGLISH} AS text FROM marked)
SELECT review_id, text FROM cleaned WHERE text <> ''""")
def clean_keep_english(spark, sf):
    return reports.english_reviews(marked(spark, sf)).select("review_id", "text")


@query(f"""WITH {REVIEWS}, {MARKED_SQL}, cleaned AS (SELECT branch_id, {SQL_ENGLISH} AS text FROM marked)
SELECT branch_id, count(*) AS found, count(*) FILTER (text <> '') AS kept, count(*) FILTER (text = '') AS skipped
FROM cleaned GROUP BY branch_id""")
def cleaning_counters(spark, sf):
    return reports.cleaning_counts(marked(spark, sf), ["branch_id"])


LABEL_SQL = """CASE doc_id % 8 WHEN 0 THEN (doc_id % 12) || ' stars' WHEN 1 THEN (doc_id % 6) || '.5 stars'
  WHEN 2 THEN '٤ نجوم' WHEN 3 THEN (doc_id % 5) || '/5' WHEN 4 THEN 'rating OF ' || (doc_id % 7)
  WHEN 5 THEN (doc_id % 9) || 'نجوم' WHEN 6 THEN '٣/٥' ELSE '' END"""
DIGITS = "'٠١٢٣٤٥٦٧٨٩', '0123456789'"


def sql_first_number(text: str, digits: str) -> str:
    return (
        f"TRY_CAST(nullif(regexp_extract(translate({text}, {DIGITS}), "
        f"'({digits})(\\.0)?(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') AS INT)"
    )


def sql_rating_v2(text: str) -> str:
    stripped = sql_strip(text)
    return f"""coalesce(
      TRY_CAST(nullif(translate(regexp_extract({stripped}, '(\\p{{Nd}}+)[{SPACE}]*/[{SPACE}]*5', 1), {DIGITS}), '') AS INT),
      TRY_CAST(nullif(translate(regexp_extract({stripped}, '(?i)Rating of[{SPACE}]*(\\p{{Nd}}+)', 1), {DIGITS}), '') AS INT),
      {sql_first_number(stripped, '\\p{Nd}+')})"""


@query(f"""SELECT doc_id, {sql_first_number(LABEL_SQL, '[0-9]')} AS from_label, {sql_first_number('text', '[0-9]')} AS from_text
FROM documents""")
def rating_v1(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        rating_single_digit(F.expr(LABEL_SQL)).alias("from_label"),
        rating_single_digit(F.col("text")).alias("from_text"),
    )


@query(f"""SELECT doc_id, {sql_rating_v2(LABEL_SQL)} AS from_label, {sql_rating_v2('text')} AS from_text FROM documents""")
def rating_v2(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        rating_from_label(F.expr(LABEL_SQL)).alias("from_label"),
        rating_from_label(F.col("text")).alias("from_text"),
    )


# a number of units before the event, in several spellings
RAW_DATE_SQL = """CASE event_id % 8 WHEN 0 THEN (user_id % 40) || ' days ago' WHEN 1 THEN (user_id % 9) || ' Weeks ago on Google'
  WHEN 2 THEN (user_id % 14) || ' months ago' WHEN 3 THEN (user_id % 20) || ' years ago'
  WHEN 4 THEN 'قبل ' || (user_id % 30) || ' يوم' WHEN 5 THEN 'a week ago' WHEN 6 THEN 'قبل ' || user_id || ' أشهر' ELSE '' END"""


@query(f"""WITH e AS (SELECT event_id, ts, user_id, event_type, {RAW_DATE_SQL} AS raw FROM events)
SELECT event_id, CASE event_id % 8
  WHEN 0 THEN strftime(CAST(ts AS DATE) - CAST(user_id % 40 AS INT), '%Y-%m-%d')
  WHEN 1 THEN strftime(CAST(ts AS DATE) - CAST(user_id % 9 * 7 AS INT), '%Y-%m-%d')
  WHEN 2 THEN strftime(CAST(ts AS DATE) - CAST(user_id % 14 * 30 AS INT), '%Y-%m-%d')
  WHEN 3 THEN strftime(CAST(ts AS DATE) - CAST(user_id % 20 * 365 AS INT), '%Y-%m-%d')
  WHEN 4 THEN strftime(CAST(ts AS DATE) - CAST(user_id % 30 AS INT), '%Y-%m-%d')
  ELSE lower(raw) END AS review_date FROM e""")
def relative_dates(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", relative_date(F.expr(RAW_DATE_SQL), F.col("ts")).alias("review_date")
    )


LINK_SQL = """url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || CASE page_id % 5 WHEN 0 THEN 'cid=' || page_id
  WHEN 1 THEN 'cid=&y=1' WHEN 2 THEN 'cid=a%20' || page_id || '&cid=9' WHEN 3 THEN 'acid=' || page_id ELSE 'x#cid=1' END"""


@query(f"""WITH links AS (SELECT page_id, {LINK_SQL} AS link FROM pages), found AS (
  SELECT page_id, link, regexp_extract(regexp_extract(link, '^[^?#]*\\?([^#]*)', 1), '(?:^|&)cid=([^&]+)', 1) AS cid FROM links)
SELECT page_id, coalesce(nullif(url_decode(cid), ''), link) AS place_id FROM found""")
def place_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", place_id(F.expr(LINK_SQL)).alias("place_id"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 2 THEN url ELSE regexp_extract(url, '^[^&]*') END AS target FROM pages""")
def unwrapped_redirects(spark, sf):
    # a redirected link is cut at its first '&', a plain one is not
    kind = F.col("page_id") % 3
    href = (
        F.when(kind == 0, F.concat(F.lit("/url?q="), "url", F.lit("&sa=U&ved=2")))
        .when(kind == 1, F.concat(F.lit("/url?q="), "url"))
        .otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", unwrap_redirect(href).alias("target"))


@query(f"""WITH {REVIEWS} SELECT review_id, substring(text, 1, 160) AS opening, length(substring(text, 1, 2000)) AS head_length,
  sha256(text) AS text_key, coalesce(nullif(CASE WHEN rating = 0 THEN '' ELSE author END, ''), source) AS shown_author,
  strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at,
  '{{"min_topic_size":5,"ngram_range":[1,2],"min_share":0.0,"max_share":1.0,"stop_words":"english"}}' AS parameters FROM reviews""")
def text_keys_and_defaults(spark, sf):
    return reviews(spark, sf).select(
        "review_id",
        snippet(F.col("text")).alias("opening"),
        F.length(snippet(F.col("text"), 2000)).alias("head_length"),
        text_key(F.col("text")).alias("text_key"),
        or_default(F.when(F.col("rating") == 0, "").otherwise(F.col("author")), F.col("source")).alias("shown_author"),
        F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"),
        settings_json(TopicSettings()).alias("parameters"),
    )


@query(f"""WITH r AS (SELECT doc_id, text, replace(replace(text, chr(92), '/'), '"', '''') AS plain, doc_id % 7 AS kind FROM documents)
SELECT doc_id,
  CASE WHEN kind IN (0, 1) THEN lower(lang) WHEN kind IN (2, 3, 6) THEN '{UNPARSED["aspect"]}' WHEN kind = 4 THEN '' END AS aspect,
  CASE WHEN kind IN (0, 1) THEN 'positive' WHEN kind IN (2, 3, 6) THEN 'mixed' ELSE '' END AS sentiment,
  CASE WHEN kind IN (0, 1, 4, 5) THEN text
       WHEN kind = 2 THEN '{UNPARSED["summary"]}```' || chr(10) || '{{"aspect":"x"}}' || chr(10) || '```'
       WHEN kind = 3 THEN '{UNPARSED["summary"]}{{"aspect": ' || text
       ELSE '{UNPARSED["summary"]}["' || doc_id || '"]' END AS summary,
  CASE WHEN kind IN (0, 1) THEN 'keep' WHEN kind IN (2, 3, 6) THEN '{UNPARSED["recommendation"]}' ELSE '' END AS recommendation
FROM r JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
def analysis_replies(spark, sf):
    kind, text = F.col("doc_id") % 7, F.col("text")
    full = F.to_json(
        F.struct(
            F.lower("lang").alias("aspect"), F.lit("positive").alias("sentiment"), text.alias("summary"),
            F.lit("keep").alias("recommendation"),
        )
    )
    only_summary = F.to_json(F.struct(text.alias("summary")))
    reply = (
        F.when(kind == 0, F.concat(F.lit(" ```json\n"), full, F.lit("\n```\n")))
        .when(kind == 1, full)
        .when(kind == 2, F.lit('```\n{"aspect":"x"}\n```'))
        .when(kind == 3, F.concat(F.lit('{"aspect": '), text))
        .when(kind == 4, only_summary)
        .when(kind == 5, F.concat(F.lit('{"aspect":null,'), F.substring(only_summary, 2, 2_000_000_000)))
        .otherwise(F.concat(F.lit('["'), "doc_id", F.lit('"]')))
    )
    return table(spark, sf, "documents").select("doc_id", parse_reply(reply).alias("r")).select("doc_id", "r.*")


@query(f"""WITH {REVIEWS} SELECT review_id,
  round(length(regexp_replace(text, '[^\\x{{0620}}-\\x{{064A}}\\x{{066E}}-\\x{{06D3}}]+', '', 'g'))
    / nullif(length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')), 0), 6) AS arabic_share FROM (
  SELECT review_id, CASE WHEN rating = 1 THEN 'نادي رائع ' || author WHEN rating = 2 THEN text || ' نادي' ELSE text END AS text
  FROM reviews)""")
def arabic_shares(spark, sf):
    mixed = F.expr("CASE WHEN rating = 1 THEN 'نادي رائع ' || author WHEN rating = 2 THEN text || ' نادي' ELSE text END")
    return reviews(spark, sf).select("review_id", F.round(arabic_share(mixed), 6).alias("arabic_share"))
