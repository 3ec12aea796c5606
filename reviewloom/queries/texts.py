"""Language, terms, topics and their analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions.replies import FAILED, REQUEST_HEAD, REQUEST_SAMPLES, REQUEST_TASK, UNPARSED
from reviewloom.functions.text import is_arabic
from reviewloom.operators import reports
from reviewloom.operators.analysis import analysis_requests, analysis_results, run_headers
from reviewloom.operators.language import agreement, detect_language, fit_language, pending_translations, translate_from
from reviewloom.operators.similarity import SimilaritySettings, review_vectors, similar_pairs, similarity_topics
from reviewloom.operators.terms import first_texts, keyword_lists, term_counts, topic_terms
from reviewloom.operators.topics import TopicSettings, all_outliers, assign_topics, overview_head, topic_overview, topic_shares, topics_by_size
from reviewloom.operators.upsert import assign_ids
from reviewloom.queries.registry import query
from reviewloom.queries.views import REVIEWS, STOP_LIST, STOP_WORDS, reviews, table
from reviewloom.session import land

SETTINGS = TopicSettings(stop_words=STOP_WORDS)

SETTINGS_SQL = "'{\"min_topic_size\":5,\"ngram_range\":[1,2],\"min_share\":0.0,\"max_share\":1.0,\"stop_words\":[" + ",".join(
    f'"{w}"' for w in STOP_WORDS
) + "]}'"

# --- language and translation -------------------------------------------------------------

GRAMS_SQL = """grams AS (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, len(chars) - 1), lambda i: chars[i] || chars[i + 1] || chars[i + 2])) AS gram
  FROM (SELECT doc_id, lang, substr(md5(text), 1, 1) < '4' AS held_out, string_split(lower(text), '') AS chars FROM documents) WHERE len(chars) >= 3)"""


HELD_OUT_SQL = "substr(md5(text), 1, 1) < '4'"
GUESS_SQL = f"""{GRAMS_SQL}, known AS (SELECT * FROM grams WHERE NOT held_out), counts AS (SELECT lang, gram, count(*) AS n FROM known GROUP BY ALL),
vocabulary AS (SELECT DISTINCT gram FROM counts), langs AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM documents WHERE NOT {HELD_OUT_SQL})) AS prior
  FROM documents WHERE NOT {HELD_OUT_SQL} GROUP BY lang),
bases AS (SELECT lang, -ln(sum(n) + (SELECT count(*) FROM vocabulary)) AS base FROM counts GROUP BY lang),
texts AS (SELECT doc_id, gram, count(*) AS times FROM grams JOIN vocabulary USING (gram) GROUP BY ALL),
scores AS (SELECT doc_id, b.lang, sum(times * (ln(1 + coalesce(n, 0)) + base)) + any_value(prior) AS score
  FROM texts CROSS JOIN bases b JOIN langs USING (lang) LEFT JOIN counts c ON c.lang = b.lang AND c.gram = texts.gram GROUP BY ALL),
best AS (SELECT doc_id, max_by(lang, score) AS lang_guess FROM scores GROUP BY doc_id),
guesses AS (SELECT doc_id, lang, {HELD_OUT_SQL} AS held_out, lang_guess FROM documents LEFT JOIN best USING (doc_id))"""


def _guesses(spark, sf):
    """Language of all documents by a model of those whose text hash is not held out; copies stay on one side."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", F.expr(HELD_OUT_SQL).alias("held_out"))
    return detect_language(documents, fit_language(documents.filter(~F.col("held_out")))).drop("text")


@query(f"WITH {GUESS_SQL} SELECT doc_id, held_out, lang_guess FROM guesses")
def language_id(spark, sf):
    return _guesses(spark, sf).select("doc_id", "held_out", "lang_guess")


@query(f"""WITH {GUESS_SQL} SELECT held_out, lang, count(*) AS texts, count(*) FILTER (lang_guess = lang) AS "right" FROM guesses GROUP BY ALL""")
def language_agreement(spark, sf):
    return agreement(_guesses(spark, sf), ["held_out", "lang"])


def _bilingual(spark, sf):
    text = F.when(F.col("rating") == 1, F.concat(F.lit("نادي رائع "), "author")).otherwise(F.col("text"))
    rows = reviews(spark, sf).select("review_id", "branch_id", text.alias("original_text"), "author")
    known = rows.filter(is_arabic(F.col("original_text"))).filter(F.length("author") == 9)
    return rows, known.select(F.col("original_text").alias("text"), F.concat(F.lit("Great club "), "author").alias("translated"))


@query(f"""WITH {REVIEWS} SELECT review_id, branch_id, CASE WHEN rating <> 1 THEN text
  WHEN length(author) = 9 THEN 'Great club ' || author ELSE 'نادي رائع ' || author END AS normalized_text FROM reviews""")
def translated_reviews(spark, sf):
    rows, memory = _bilingual(spark, sf)
    return translate_from(rows, memory, is_arabic(F.col("original_text"))).select("review_id", "branch_id", "normalized_text")


@query(f"""WITH {REVIEWS} SELECT DISTINCT 'نادي رائع ' || author AS text FROM reviews WHERE rating = 1 AND length(author) <> 9""")
def untranslated_texts(spark, sf):
    rows, memory = _bilingual(spark, sf)
    return pending_translations(rows, memory, is_arabic(F.col("original_text")))


# --- terms of given topics ------------------------------------------------------------------

TERMS_SQL = f"""words AS (
  SELECT review_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP_LIST})) AS w FROM texts),
terms AS (SELECT review_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words)"""

CTFIDF_SQL = """counts AS (SELECT branch_id, topic, term, count(*) AS tf FROM terms JOIN topics USING (review_id) GROUP BY ALL),
per_topic AS (SELECT branch_id, topic, sum(tf) AS words FROM counts GROUP BY ALL),
means AS (SELECT branch_id, floor(avg(words)) AS a FROM per_topic GROUP BY ALL),
across AS (SELECT branch_id, term, sum(tf) AS f FROM counts GROUP BY ALL),
weights AS (SELECT branch_id, topic, term, tf, tf / words * ln(1 + a / f) AS weight
  FROM counts JOIN per_topic USING (branch_id, topic) JOIN means USING (branch_id) JOIN across USING (branch_id, term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY branch_id, topic ORDER BY weight DESC, term) AS rank FROM weights),
top_terms AS (SELECT * FROM ranked WHERE rank <= 10),
keywords AS (SELECT branch_id, topic, string_agg(term, ', ' ORDER BY rank) AS top_keywords FROM top_terms GROUP BY ALL)"""

GIVEN_SQL = """topics AS (SELECT review_id, branch_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE -1 END AS topic
  FROM reviews), texts AS (SELECT review_id, text FROM reviews)"""


def _given_topics(spark, sf):
    topic = F.expr("CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE -1 END")
    return reviews(spark, sf).select("review_id", "branch_id", F.col("text").alias("normalized_text"), topic.alias("topic"))


@query(f"""WITH {REVIEWS}, {GIVEN_SQL}, {TERMS_SQL}, {CTFIDF_SQL}
SELECT branch_id, topic, rank, term, tf, round(weight, 6) AS weight FROM top_terms""")
def topic_terms_ctfidf(spark, sf):
    terms = topic_terms(_given_topics(spark, sf), stop_words=STOP_WORDS)
    return terms.select("branch_id", "topic", "rank", "term", "tf", F.round("weight", 6).alias("weight"))


@query(f"""WITH {REVIEWS}, {GIVEN_SQL}, {TERMS_SQL}, {CTFIDF_SQL},
sizes AS (SELECT branch_id, topic, count(*) AS size FROM topics GROUP BY ALL)
SELECT branch_id, topic, size, top_keywords FROM sizes LEFT JOIN keywords USING (branch_id, topic)""")
def topics_overview(spark, sf):
    return topic_overview(_given_topics(spark, sf), SETTINGS)


@query(f"""WITH {REVIEWS}, {GIVEN_SQL}, {TERMS_SQL}, {CTFIDF_SQL},
sizes AS (SELECT branch_id, topic, count(*) AS size FROM topics GROUP BY ALL)
SELECT branch_id, topic, size, top_keywords FROM sizes LEFT JOIN keywords USING (branch_id, topic)
ORDER BY size DESC, branch_id, topic LIMIT 5""")
def topics_overview_head(spark, sf):
    return overview_head(topic_overview(_given_topics(spark, sf), SETTINGS))


@query("""WITH c AS (SELECT vec_id % 20 AS branch_id, label AS topic, count(*) AS size FROM embeddings GROUP BY ALL)
SELECT branch_id, topic, size, CAST(round(CAST(size AS DECIMAL(18,0)) * 100 / sum(size) OVER (PARTITION BY branch_id), 2) AS DECIMAL(5,2)) AS percentage
FROM c""")
def topic_share(spark, sf):
    labelled = table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("branch_id"), F.col("label").alias("topic"))
    return topic_shares(labelled)


@query("""WITH c AS (SELECT vec_id % 20 AS branch_id, label AS topic, count(*) AS size FROM embeddings GROUP BY ALL)
SELECT branch_id, topic, size, CAST(round(CAST(size AS DECIMAL(18,0)) * 100 / sum(size) OVER (PARTITION BY branch_id), 2) AS DECIMAL(5,2)) AS percentage,
  row_number() OVER (ORDER BY branch_id, size DESC, topic) - 1 AS place FROM c""")
def topics_largest_first(spark, sf):
    labelled = table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("branch_id"), F.col("label").alias("topic"))
    # the place shows the order that is kept in the rows
    ordered = topics_by_size(labelled)
    return assign_ids(ordered, ["branch_id", F.desc("size"), "topic"], "place", -1)


@query(f"""WITH {REVIEWS}, {GIVEN_SQL}, firsts AS (
  SELECT branch_id, topic, review_id, text, row_number() OVER (PARTITION BY branch_id, topic ORDER BY review_id) AS n
  FROM topics JOIN texts USING (review_id))
SELECT branch_id, topic, string_agg(text, '~' ORDER BY review_id) AS samples FROM firsts WHERE n <= 20 GROUP BY ALL""")
def topic_samples(spark, sf):
    samples = first_texts(_given_topics(spark, sf), ["branch_id", "topic"], "normalized_text", n=20)
    return samples.withColumn("samples", F.array_join("samples", "~"))


# --- topics found in the texts ----------------------------------------------------------------

ASSIGN_SQL = """tf AS (SELECT branch_id, review_id, term, count(*) AS tf FROM terms JOIN reviews USING (review_id) GROUP BY ALL),
sizes AS (SELECT branch_id, count(*) AS n FROM reviews GROUP BY ALL),
df AS (SELECT branch_id, term, count(*) AS df FROM tf GROUP BY ALL),
candidates AS (SELECT branch_id, term, ln(n / df) AS idf FROM df JOIN sizes USING (branch_id) WHERE df >= 5),
scored AS (SELECT branch_id, review_id, term, tf * idf AS score FROM tf JOIN candidates USING (branch_id, term)),
first_choice AS (SELECT branch_id, review_id, max(struct_pack(score := score, term := term)).term AS anchor FROM scored GROUP BY ALL),
kept AS (SELECT branch_id, anchor AS term FROM first_choice GROUP BY ALL HAVING count(*) >= 5),
chosen AS (SELECT branch_id, review_id, max(struct_pack(score := score, term := term)).term AS anchor
  FROM scored JOIN kept USING (branch_id, term) GROUP BY ALL),
numbered AS (SELECT branch_id, anchor, row_number() OVER (PARTITION BY branch_id ORDER BY count(*) DESC, anchor) - 1 AS topic
  FROM chosen GROUP BY branch_id, anchor),
assigned AS (SELECT branch_id, review_id, coalesce(topic, -1) AS topic, anchor FROM reviews
  LEFT JOIN chosen USING (branch_id, review_id) LEFT JOIN numbered USING (branch_id, anchor))"""
FOUND_SQL = f"""{REVIEWS}, texts AS (SELECT review_id, text FROM reviews), {TERMS_SQL}, {ASSIGN_SQL}"""


def _found_topics(spark, sf):
    rows = reviews(spark, sf).select("branch_id", "review_id", F.col("text").alias("normalized_text"))
    return rows, assign_topics(rows, SETTINGS)


@query(f"WITH {FOUND_SQL} SELECT branch_id, review_id, topic, anchor FROM assigned")
def topic_assignment(spark, sf):
    return _found_topics(spark, sf)[1]


@query(f"""WITH {FOUND_SQL} SELECT branch_id, count(*) AS reviews, count(DISTINCT CASE WHEN topic <> -1 THEN topic END) AS topics
FROM assigned GROUP BY branch_id""")
def topic_run_counts(spark, sf):
    return reports.topic_counts(_found_topics(spark, sf)[1])


SIMILAR = SimilaritySettings(min_topic_size=3, similarity=0.3, neighbours=5, stop_words=STOP_WORDS)

SIMILAR_SQL = f"""{REVIEWS}, firsts AS (SELECT branch_id, text, min(review_id) AS review_id FROM reviews WHERE branch_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
words AS (SELECT branch_id, review_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP_LIST}))) AS term FROM firsts),
tf AS (SELECT branch_id, review_id, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT branch_id, term, count(*) AS df FROM tf GROUP BY ALL), sizes AS (SELECT branch_id, count(*) AS n FROM firsts GROUP BY ALL),
raw AS (SELECT branch_id, review_id, term, (1 + ln(tf)) * ln(1 + n / df) AS w FROM tf JOIN df USING (branch_id, term) JOIN sizes USING (branch_id)),
lengths AS (SELECT review_id, sqrt(sum(w * w)) AS length FROM raw GROUP BY ALL),
unit AS (SELECT branch_id, review_id, term, w / length AS w FROM raw JOIN lengths USING (review_id)),
pairs AS (SELECT a.branch_id, a.review_id AS a, b.review_id AS b, round(sum(a.w * b.w), 9) AS cosine FROM unit a JOIN unit b
  ON a.branch_id = b.branch_id AND a.term = b.term AND a.review_id <> b.review_id GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.3)"""
GROUPS_SQL = f"""{SIMILAR_SQL}, near AS (SELECT *, row_number() OVER (PARTITION BY branch_id, a ORDER BY cosine DESC, b) AS place FROM pairs),
edges AS (SELECT x.a, x.b FROM near x JOIN near y ON x.a = y.b AND x.b = y.a WHERE x.place <= 5 AND y.place <= 5),
reach AS (SELECT DISTINCT review_id AS a, review_id AS b FROM unit UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
labels AS (SELECT a AS review_id, min(b) AS anchor FROM reach GROUP BY a),
members AS (SELECT r.branch_id, r.review_id, anchor FROM reviews r JOIN firsts f ON r.branch_id = f.branch_id AND r.text = f.text JOIN labels l ON l.review_id = f.review_id),
numbered AS (SELECT branch_id, anchor, CAST(row_number() OVER (PARTITION BY branch_id ORDER BY count(*) DESC, anchor) - 1 AS INT) AS topic
  FROM members GROUP BY branch_id, anchor HAVING count(*) >= 3)"""


@query(f"WITH {SIMILAR_SQL} SELECT branch_id, a, b, cosine FROM pairs WHERE a < b")
def similar_review_pairs(spark, sf):
    """All pairs of different texts of a branch with a cosine of 0.3 or more."""
    rows = reviews(spark, sf).filter("branch_id IS NOT NULL AND text IS NOT NULL").select("branch_id", "review_id", F.col("text").alias("normalized_text"))
    firsts = land(rows.groupBy("branch_id", "normalized_text").agg(F.min("review_id").alias("review_id")), "similar-texts", "zstd")
    return similar_pairs(review_vectors(firsts, SIMILAR), SIMILAR.similarity)


@query(f"""WITH RECURSIVE {GROUPS_SQL} SELECT r.branch_id, r.review_id, coalesce(n.topic, -1) AS topic, n.anchor
FROM reviews r LEFT JOIN members m USING (review_id) LEFT JOIN numbered n ON n.branch_id = m.branch_id AND n.anchor = m.anchor""")
def similarity_topic_assignment(spark, sf):
    """Every review with its topic of similar reviews."""
    rows = reviews(spark, sf).select("branch_id", "review_id", F.col("text").alias("normalized_text"))
    return similarity_topics(rows, SIMILAR)


@query(f"WITH {REVIEWS} SELECT branch_id, review_id, -1 AS topic, CAST(NULL AS VARCHAR) AS anchor FROM reviews")
def topics_switched_off(spark, sf):
    return all_outliers(reviews(spark, sf))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


REQUESTS_SQL = f"""{FOUND_SQL}, topics AS (SELECT * FROM assigned), {CTFIDF_SQL},
parts AS (SELECT branch_id, topic, count(*) AS size FROM topics WHERE topic <> -1 GROUP BY ALL),
shares AS (SELECT branch_id, topic, size,
  CAST(round(CAST(size AS DECIMAL(18,0)) * 100 / sum(size) OVER (PARTITION BY branch_id), 2) AS DECIMAL(5,2)) AS percentage FROM parts),
firsts AS (SELECT branch_id, topic, review_id, text, row_number() OVER (PARTITION BY branch_id, topic ORDER BY review_id) AS n
  FROM topics JOIN texts USING (review_id)),
samples AS (SELECT branch_id, topic, string_agg(text, chr(10) || '- ' ORDER BY review_id) AS samples FROM firsts WHERE n <= 20 GROUP BY ALL),
requests AS (SELECT branch_id, topic, size, percentage, top_keywords,
  {_sql_text(REQUEST_HEAD)} || top_keywords || {_sql_text(REQUEST_SAMPLES)} || samples || {_sql_text(REQUEST_TASK)} AS request
  FROM shares JOIN keywords USING (branch_id, topic) JOIN samples USING (branch_id, topic))"""


def _requests(spark, sf):
    rows = reviews(spark, sf).select("branch_id", "review_id", F.col("text").alias("normalized_text"))
    counted = term_counts(rows, "normalized_text", SETTINGS.words(), SETTINGS.ngram_max)
    topics = land(rows.join(assign_topics(rows, SETTINGS, counted=counted), ["branch_id", "review_id"]), "topics")
    return topics, analysis_requests(topics, SETTINGS, counted=counted)


@query(f"WITH {REQUESTS_SQL} SELECT * FROM requests")
def topic_analysis_requests(spark, sf):
    return _requests(spark, sf)[1].drop("samples")


def _responses(requests):
    """Replies derived from the requests: most parse, some are broken, some calls failed."""
    kind = F.col("topic") % 4
    reply = F.to_json(F.struct(F.col("top_keywords").alias("aspect"), F.lit("mixed").alias("sentiment")))
    return requests.select(
        "branch_id",
        F.col("topic").alias("topic_id"),
        F.when(kind < 2, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).when(kind == 2, "no answer").alias("reply"),
        F.when(kind == 3, F.concat(F.lit("timeout "), "size")).alias("error"),
    )


RESULTS_SQL = f"""{REQUESTS_SQL}, results AS (SELECT branch_id, topic, percentage, top_keywords,
  CASE WHEN topic % 4 < 2 THEN top_keywords WHEN topic % 4 = 2 THEN {_sql_text(UNPARSED["aspect"])} ELSE {_sql_text(FAILED["aspect"])} END AS gemini_aspect,
  'mixed' AS gemini_sentiment,
  CASE WHEN topic % 4 < 2 THEN '' WHEN topic % 4 = 2 THEN {_sql_text(UNPARSED["summary"] + "no answer")}
    ELSE {_sql_text(FAILED["summary"] + "timeout ")} || size END AS gemini_summary,
  CASE WHEN topic % 4 < 2 THEN '' WHEN topic % 4 = 2 THEN {_sql_text(UNPARSED["recommendation"])} ELSE {_sql_text(FAILED["recommendation"])} END AS gemini_recommendation
  FROM requests)"""


@query(f"WITH {RESULTS_SQL} SELECT * FROM results")
def topic_analysis_results(spark, sf):
    requests = land(_requests(spark, sf)[1], "requests")
    return analysis_results(requests, _responses(requests))


@query(f"""WITH {RESULTS_SQL}, analysed AS (SELECT branch_id, CAST(count(*) AS INT) AS number_of_topics FROM results GROUP BY ALL),
processed AS (SELECT branch_id, CAST(count(*) AS INT) AS number_of_reviews_processed FROM topics GROUP BY ALL)
SELECT branch_id, number_of_topics, number_of_reviews_processed, s_name AS branch_name,
  {SETTINGS_SQL} AS bertopic_parameters
FROM analysed JOIN processed USING (branch_id) JOIN supplier ON s_suppkey = branch_id""")
def analysis_run_headers(spark, sf):
    topics, requests = _requests(spark, sf)
    requests = land(requests, "requests")
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return run_headers(topics, analysis_results(requests, _responses(requests)), names, SETTINGS)


@query(f"""WITH {REVIEWS}, {GIVEN_SQL}, {TERMS_SQL}, {CTFIDF_SQL} SELECT branch_id, topic, top_keywords FROM keywords""")
def topic_keywords(spark, sf):
    return keyword_lists(topic_terms(_given_topics(spark, sf), stop_words=STOP_WORDS), ["branch_id", "topic"])
