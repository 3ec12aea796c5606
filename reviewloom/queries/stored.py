"""Stored tables: upserts, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions.text import text_key
from reviewloom.operators import reports, upsert
from reviewloom.queries.registry import query
from reviewloom.plans.stages import review_rows
from reviewloom.queries.collected import pages_v2
from reviewloom.queries.views import BRANCHES, INSIGHTS, META, PAGED, REVIEWS, branches, insights, meta, reviews, table
from reviewloom.queries.scalars import MARKED_SQL, SQL_ENGLISH, marked
from reviewloom.schemas import INSIGHTS_CSV, REVIEW_CSV, TABLES
from reviewloom.session import cut, land, remove_folder, scratch_path
from reviewloom.sinks.files import export_insights_csv, nested_json, read_reviews_csv, write_nested_json, write_reviews_csv
from reviewloom.sinks.store import ReviewStore
from reviewloom.operators.extract import parsed_v2
from reviewloom.sources.branch_list import read_branch_lines, write_branch_list
from reviewloom.sources.pages import stream_pages
from reviewloom.streaming.snapshots import each_batch, land_first, land_reviews, read_landed, run_to_parquet, unique_over_time

# --- reports --------------------------------------------------------------------------------


@query(f"""WITH {REVIEWS}, {MARKED_SQL}, cleaned AS (SELECT review_id, {SQL_ENGLISH} AS text FROM marked),
unique_texts AS (SELECT branch_id, min(review_id) AS review_id FROM cleaned JOIN (SELECT review_id, branch_id FROM reviews) USING (review_id)
  WHERE length(cleaned.text) >= 10 GROUP BY branch_id, cleaned.text),
kept AS (SELECT r.review_id, r.branch_id, r.rating, r.scraped_at, c.text,
  row_number() OVER (PARTITION BY r.branch_id ORDER BY r.review_id) AS n
  FROM unique_texts u JOIN reviews r USING (review_id) JOIN cleaned c USING (review_id))
SELECT branch_id, count(*) AS reviews, count(*) FILTER (rating > 0) AS rated,
  round(avg(rating) FILTER (rating > 0), 4) AS avg_rating,
  count(*) FILTER (rating = 1) AS stars_1, count(*) FILTER (rating = 2) AS stars_2, count(*) FILTER (rating = 3) AS stars_3,
  count(*) FILTER (rating = 4) AS stars_4, count(*) FILTER (rating = 5) AS stars_5,
  strftime(min(scraped_at), '%Y-%m-%d %H:%M') AS first_scraped, strftime(max(scraped_at), '%Y-%m-%d %H:%M') AS last_scraped,
  string_agg(text, '~' ORDER BY review_id) FILTER (n <= 5) AS samples
FROM kept GROUP BY branch_id""")
def reviews_by_branch(spark, sf):
    kept = reports.english_reviews(marked(spark, sf)).filter(F.length("text") >= 10)
    columns = ["review_id", "branch_id", "rating", "scraped_at", "text"]
    # the report reads the unique reviews twice: for its counts and for its samples
    once = cut(reports.keep_first(kept.select(*columns), ["branch_id", text_key(F.col("text"))], ["review_id"]))
    report = reports.reviews_by_branch(once)
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("first_scraped", "last_scraped")}
    return report.withColumns({**shown, "samples": F.array_join("samples", "~")})


@query(f"""WITH {META}, {INSIGHTS} SELECT topic_id, percentage, top_keywords, gemini_aspect, gemini_sentiment, gemini_summary,
  gemini_recommendation FROM insights JOIN meta USING (meta_id) WHERE branch_id = 7 ORDER BY topic_id""")
def insights_of_branch(spark, sf):
    return reports.branch_insights(insights(spark, sf), meta(spark, sf), 7)


@query(f"""WITH {META}, {INSIGHTS} SELECT branch_id, topic_id, percentage, top_keywords, gemini_aspect, gemini_sentiment,
  gemini_summary, gemini_recommendation FROM insights JOIN meta USING (meta_id)""")
def insights_of_all_branches(spark, sf):
    return reports.all_insights(insights(spark, sf), meta(spark, sf))


LATEST_SQL = f"""{META}, latest AS (SELECT * FROM meta ORDER BY analysis_date DESC NULLS FIRST, meta_id DESC LIMIT 20)"""


@query(f"""WITH {LATEST_SQL}, {INSIGHTS}, nested AS (
  SELECT meta_id, to_json(list(struct_pack(topic_id := topic_id, percentage := CAST(percentage AS DOUBLE), top_keywords := top_keywords,
    aspect := gemini_aspect, sentiment := gemini_sentiment, summary := gemini_summary, recommendation := gemini_recommendation)
    ORDER BY topic_id, percentage, top_keywords, gemini_aspect, gemini_sentiment, gemini_summary, gemini_recommendation)) AS topics
  FROM insights GROUP BY meta_id)
SELECT '{{"branch_id":' || branch_id || ',"branch_name":"' || branch_name || '","analysis_date":"'
  || CASE WHEN microsecond(analysis_date) % 1000000 = 0 THEN strftime(analysis_date, '%Y-%m-%dT%H:%M:%S') ELSE strftime(analysis_date, '%Y-%m-%dT%H:%M:%S.%f') END || '","topics":' || coalesce(CAST(topics AS VARCHAR), '[]') || '}}' AS value
FROM latest LEFT JOIN nested USING (meta_id)""")
def insights_nested(spark, sf):
    return nested_json(reports.nested_insights(insights(spark, sf), meta(spark, sf), 20))


@query(f"WITH {LATEST_SQL} SELECT meta_id, branch_id, branch_name FROM latest")
def latest_runs(spark, sf):
    return reports.latest_runs(meta(spark, sf), 20).select("meta_id", "branch_id", "branch_name")


@query(f"WITH {BRANCHES} SELECT id, name, url FROM branches ORDER BY scraped_at DESC NULLS FIRST, id")
def branches_by_date(spark, sf):
    return reports.branches_by_date(branches(spark, sf)).select("id", "name", "url")


@query(f"""WITH {BRANCHES} SELECT name, id FROM (SELECT name, id,
  row_number() OVER (PARTITION BY name ORDER BY scraped_at ASC NULLS LAST, id) AS n FROM branches) WHERE n = 1""")
def branch_choice_oldest(spark, sf):
    return reports.branch_choice(branches(spark, sf))


@query(f"""WITH {BRANCHES} SELECT name, id FROM (SELECT name, id,
  row_number() OVER (PARTITION BY name ORDER BY scraped_at DESC NULLS FIRST, id) AS n FROM branches) WHERE n = 1""")
def branch_choice_newest(spark, sf):
    return reports.branch_choice(branches(spark, sf), keep="newest")


# --- upserts ----------------------------------------------------------------------------------


@query(f"""WITH {REVIEWS}, batch AS (SELECT conv_id AS review_id, role AS author, text, turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT review_id, author, text AS normalized_text FROM reviews WHERE review_id NOT IN (SELECT review_id FROM batch)
UNION ALL SELECT review_id, author, text FROM batch WHERE n = 1""")
def upsert_normalized(spark, sf):
    base = reviews(spark, sf).select("review_id", "author", F.col("text").alias("normalized_text"))
    batch = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("review_id"), F.col("role").alias("author"), F.col("text").alias("normalized_text"), "turn"
    )
    return upsert.upsert(base, batch, ["review_id"], ["turn"])


def _found_reviews(spark, sf):
    """A batch that repeats the stored reviews and brings the turns of conversations."""
    stored = reviews(spark, sf).select(
        "review_id", "branch_id", "author", "rating", "text", "review_date", "scraped_at"
    )
    talks = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"),
        (F.col("conv_id") % 20).alias("branch_id"),
        F.col("role").alias("author"),
        F.when(F.col("turn") > 0, F.col("turn").cast("int")).alias("rating"),
        "text",
        F.when(F.col("turn") > 0, "today").alias("review_date"),
        F.expr("timestamp_ntz'2025-10-20 00:00:00' + turn * interval '1' minute").alias("scraped_at"),
    )
    return stored, stored.unionByName(talks)


@query(f"""WITH {REVIEWS}, batch AS (
  SELECT review_id AS key, branch_id, author, rating, text, review_date, scraped_at FROM reviews UNION ALL
  SELECT conv_id * 1000 + turn, conv_id % 20, role, CASE WHEN turn > 0 THEN CAST(turn AS INT) END, text,
    CASE WHEN turn > 0 THEN 'today' END, TIMESTAMP '2025-10-20 00:00:00' + turn * INTERVAL 1 MINUTE FROM conversations),
fresh AS (SELECT *, row_number() OVER (PARTITION BY branch_id, text ORDER BY key) AS n FROM batch
  WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.branch_id = batch.branch_id AND r.text = batch.text))
SELECT branch_id, author, coalesce(rating, 0) AS rating, text, coalesce(review_date, '') AS review_date,
  (SELECT max(review_id) FROM reviews) + row_number() OVER (ORDER BY branch_id, scraped_at, text) AS review_id
FROM fresh WHERE n = 1""")
def insert_if_absent(spark, sf):
    stored, batch = _found_reviews(spark, sf)
    order = [F.col("review_id")]
    return upsert.new_reviews(batch, stored, order).drop("scraped_at")


@query(f"""WITH {BRANCHES}, batch AS (
  SELECT o_orderkey AS seq, CASE WHEN o_totalprice < 100000 THEN '' ELSE 'order ' || o_orderkey END AS name,
    'https://maps.example/place/' || o_custkey AS url, o_orderdate AS visited FROM orders UNION ALL
  SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END, 'https://maps.example/supplier/' || s_suppkey, TIMESTAMP '2025-10-20' FROM supplier),
seen AS (SELECT url, arg_max(nullif(name, ''), seq) FILTER (name <> '') AS new_name, arg_max(visited, seq) AS new_at FROM batch GROUP BY url)
SELECT b.id, coalesce(new_name, name) AS name, url, place_id, strftime(coalesce(new_at, scraped_at), '%Y-%m-%d %H:%M:%S') AS scraped_at
FROM branches b LEFT JOIN seen USING (url)
UNION ALL
SELECT (SELECT max(id) FROM branches) + row_number() OVER (ORDER BY url), coalesce(new_name, url), url, url,
  strftime(new_at, '%Y-%m-%d %H:%M:%S') FROM seen WHERE url NOT IN (SELECT url FROM branches)""")
def upsert_branches_by_link(spark, sf):
    link = lambda kind, key: F.concat(F.lit(f"https://maps.example/{kind}/"), key)
    visits = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_totalprice") < 100000, "").otherwise(F.concat(F.lit("order "), "o_orderkey")).alias("name"),
        link("place", F.col("o_custkey")).alias("url"),
        F.col("o_orderdate").alias("scraped_at"),
    )
    others = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("seq"),
        F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_name")).alias("name"),
        link("supplier", F.col("s_suppkey")).alias("url"),
        F.expr("timestamp_ntz'2025-10-20 00:00:00'").alias("scraped_at"),
    )
    result = upsert.upsert_branches_by_url(branches(spark, sf), visits.unionByName(others), ["seq"])
    shown = F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at")
    return result.select("id", "name", "url", "place_id", shown)


PLACE_SQL = """CASE o_orderkey % 3 WHEN 0 THEN 'https://maps.example/place/' || o_custkey
  WHEN 1 THEN 'https://maps.example/m?cid=' || o_custkey ELSE 'https://maps.example/m?cid=x' || o_custkey || '&v=' || (o_orderkey % 5) END"""


@query(f"""WITH {BRANCHES}, batch AS (SELECT o_orderkey AS seq, 'order ' || o_orderkey AS name, o_orderdate AS visited, {PLACE_SQL} AS url,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://maps.example/place/' || o_custkey WHEN 1 THEN CAST(o_custkey AS VARCHAR)
    ELSE 'x' || o_custkey END AS place_id FROM orders),
hits AS (SELECT seq, visited, b.id FROM batch JOIN branches b USING (place_id) UNION ALL
  SELECT seq, visited, b.id FROM batch JOIN branches b ON b.url = batch.url),
dates AS (SELECT id, max(visited) AS new_at FROM hits GROUP BY id),
added AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY seq) AS n FROM batch WHERE seq NOT IN (SELECT seq FROM hits))
SELECT id, name, url, place_id, strftime(coalesce(new_at, scraped_at), '%Y-%m-%d %H:%M:%S') AS scraped_at FROM branches LEFT JOIN dates USING (id)
UNION ALL
SELECT (SELECT max(id) FROM branches) + row_number() OVER (ORDER BY url), name, url, place_id, strftime(visited, '%Y-%m-%d %H:%M:%S')
FROM added WHERE n = 1""")
def upsert_branches_by_place_or_link(spark, sf):
    batch = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("order "), "o_orderkey").alias("name"),
        F.expr(PLACE_SQL).alias("url"),
        F.col("o_orderdate").alias("scraped_at"),
    )
    result = upsert.upsert_branches_by_place(branches(spark, sf), batch, ["seq"])
    shown = F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at")
    return result.select("id", "name", "url", "place_id", shown)


@query(f"""WITH {REVIEWS} SELECT review_id, branch_id FROM reviews
WHERE branch_id IS NULL OR branch_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def cascade_delete(spark, sf):
    removed = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("branch_id"))
    _, kept = upsert.delete_branches(branches(spark, sf), reviews(spark, sf), removed)
    return kept.select("review_id", "branch_id")


@query("""WITH t AS (SELECT c_custkey AS id, repeat(c_name, CAST(c_custkey % 40 AS INT)) AS name, c_mktsegment AS phone FROM customer)
SELECT id, CASE WHEN length(name) > 512 THEN 'name' ELSE '' END AS oversize FROM t""")
def oversize_rows(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.expr("repeat(c_name, cast(c_custkey % 40 AS INT))").alias("name"),
        F.col("c_mktsegment").alias("phone"),
    )
    fits, rejected = upsert.split_oversize(rows, {"name": 512, "phone": 64})
    return fits.select("id", F.lit("").alias("oversize")).unionByName(
        rejected.select("id", F.array_join("oversize", ",").alias("oversize"))
    )


# --- streams ------------------------------------------------------------------------------------


def _stream(spark, sf, name):
    path = f"{sf}/{name}.parquet"
    # the pattern lets a stream take the table whether it is one file or a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


@query(f"WITH {REVIEWS} SELECT DISTINCT branch_id, sha256(text) AS review_key FROM reviews")
def stream_unique_reviews(spark, sf):
    rows = _stream(spark, sf, "documents").select(
        F.expr("try_cast(substring(source, 4) AS BIGINT)").alias("branch_id"), text_key(F.col("text")).alias("review_key")
    )
    out = scratch_path(spark, "stream-unique")
    unique = unique_over_time(rows, ["branch_id", "review_key"])
    run_to_parquet(unique, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _in_rounds(rows, path, rounds, part):
    """Rounds as they arrive, each written by all its tasks: round r holds the parts up to r, so later ones repeat rows."""
    for r in range(rounds):
        rows.filter(part <= r).withColumn("round", F.lit(r)).write.mode("append").parquet(path)
        yield r


@query("""WITH rows AS (SELECT TRY_CAST(substr(source, 4) AS BIGINT) AS branch_id, text, doc_id % 3 AS part FROM documents),
rounds AS (SELECT unnest(range(3)) AS round), seen AS (SELECT * FROM rows JOIN rounds ON part <= round),
firsts AS (SELECT branch_id, text, min(part) AS round FROM rows GROUP BY ALL),
fresh AS (SELECT branch_id, round, count(*) AS new FROM firsts GROUP BY ALL)
SELECT branch_id, round, count(*) AS found, any_value(coalesce(new, 0)) AS new FROM seen LEFT JOIN fresh USING (branch_id, round) GROUP BY ALL""")
def stream_landed_counts(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.expr("try_cast(substring(source, 4) AS BIGINT)").alias("branch_id"),
        F.lit("author").alias("author"),
        F.lit(0).alias("rating"),
        "text",
        F.lit("").alias("review_date"),
        F.expr("timestamp'2025-10-15 00:00:00' + doc_id * interval '1' minute").alias("scraped_at"),
    )
    out = scratch_path(spark, "stream-landed")
    handler = land_reviews(ReviewStore(spark, f"{out}/store"), f"{out}/counts", ["review_id"])
    for _ in _in_rounds(rows, f"{out}/in", 3, F.col("review_id") % 3):
        # whatever has arrived since the last run is one batch
        stream = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).parquet(f"{out}/in")
        each_batch(stream, handler, f"{out}/progress").awaitTermination()
    for spent in ("in", "progress", "store"):
        remove_folder(spark, f"{out}/{spent}")
    return spark.read.parquet(f"{out}/counts/*")


@query(f"""WITH {PAGED}, read AS (SELECT url, page_no, review_id AS n, stripped AS text, CASE WHEN review_id % 4 = 3 THEN 'Unknown' ELSE author END AS author
  FROM paged WHERE length(stripped) >= 10)
SELECT DISTINCT url, CASE WHEN page_no % 4 = 0 THEN 'r' || (n % 160) ELSE 'text:' || sha256(text) || '|author:' || author END AS review_id,
  CAST(page_no % 3 AS INT) AS snapshot_no FROM read""")
def stream_page_reviews(spark, sf):
    """Pages that arrive in three snapshots: parsed, de-duplicated behind a watermark, landed batch by batch."""
    pages = pages_v2(spark, sf)
    number = F.expr("cast(page_id / 1000 AS BIGINT)") % 3
    out = scratch_path(spark, "stream-pages")
    land = lambda batch, batch_id: land_first(batch, batch_id, f"{out}/rows", ["url", "review_id"], ["block_no"])
    for r in range(3):
        arrived = pages.filter(number <= r).withColumn("snapshot_no", F.lit(r))
        later = F.col("fetched_at") + F.make_dt_interval(mins=F.lit(r))
        arrived.withColumn("fetched_at", later).write.mode("append").parquet(f"{out}/in")
        unique = unique_over_time(parsed_v2(stream_pages(spark, f"{out}/in")), ["url", "review_id"], "fetched_at", "1 day")
        each_batch(unique, land, f"{out}/progress").awaitTermination()
    for spent in ("in", "progress"):
        remove_folder(spark, f"{out}/{spent}")
    return read_landed(spark, f"{out}/rows").select("url", "review_id", "snapshot_no")


# --- writers: written, read back, compared ----------------------------------------------------------


@query(f"""WITH {PAGED}, read AS (SELECT page_id, url, block_no, CASE WHEN review_id % 4 = 3 THEN 'Unknown' ELSE author END AS author,
    stripped AS text, CASE WHEN page_no % 4 = 0 THEN 'r' || (review_id % 160) END AS given FROM paged WHERE length(stripped) >= 10),
keyed AS (SELECT page_id, url, block_no, author, coalesce(given, 'text:' || sha256(text) || '|author:' || author) AS review_id, {SQL_ENGLISH} AS text FROM read),
once AS (SELECT *, row_number() OVER (PARTITION BY url, review_id ORDER BY block_no) AS nth FROM keyed WHERE text <> '')
SELECT 'place ' || page_id AS branch_name, url AS branch_url, review_id, author, text, '2025-10-15 12:00:00' AS scraped_at FROM once WHERE nth = 1""")
def review_csv(spark, sf):
    pages = pages_v2(spark, sf).withColumn("name", F.concat(F.lit("place "), "page_id"))
    path = scratch_path(spark, "review-csv")
    write_reviews_csv(review_rows(pages), path)
    return read_reviews_csv(spark, path, REVIEW_CSV).select(
        "branch_name", "branch_url", "review_id", "author", "text", "scraped_at"
    )


@query(f"""WITH {META}, {INSIGHTS} SELECT branch_id, topic_id, gemini_summary FROM insights JOIN meta USING (meta_id)""")
def insights_csv(spark, sf):
    path = scratch_path(spark, "insights-csv")
    export_insights_csv(insights(spark, sf), meta(spark, sf), path)
    back = spark.read.schema(INSIGHTS_CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("branch_id", "topic_id", "gemini_summary")


@query("""SELECT coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN '' ELSE 'page ' || page_id END, ''), url) AS name, url FROM pages""")
def branch_list_file(spark, sf):
    path = scratch_path(spark, "branch-list")
    name = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("page "), "page_id"))
    write_branch_list(table(spark, sf, "pages").select(name.alias("name"), "url"), path)
    return read_branch_lines(spark, path)


@query(f"""WITH {LATEST_SQL}, counted AS (SELECT meta_id, count(*) AS n FROM insights_rows GROUP BY meta_id)
SELECT latest.branch_id, branch_name, coalesce(n, 0) AS topics FROM latest LEFT JOIN counted USING (meta_id)""".replace(
    "counted AS", f"{INSIGHTS.replace('insights AS', 'insights_rows AS')}, counted AS"))
def nested_json_file(spark, sf):
    path = scratch_path(spark, "nested-json")
    write_nested_json(reports.nested_insights(insights(spark, sf), meta(spark, sf), 20), path)
    kinds = "branch_id BIGINT, branch_name STRING, analysis_date STRING, topics ARRAY<STRUCT<topic_id: INT>>"
    return spark.read.schema(kinds).json(path).select("branch_id", "branch_name", F.size("topics").cast("long").alias("topics"))


@query("""SELECT 'branches' AS name, count(*) AS before, 0 AS after FROM customer UNION ALL SELECT 'reviews', count(*), 0 FROM documents
UNION ALL SELECT 'normalized_reviews', 0, 0 UNION ALL SELECT 'insights_meta', count(*), 0 FROM orders UNION ALL SELECT 'insights', 0, 0""")
def tables_created_and_reset(spark, sf):
    store = ReviewStore(spark, scratch_path(spark, "tables"))
    store.ensure()
    store.append("branches", branches(spark, sf), "a")
    store.append("reviews", reviews(spark, sf), "a")
    headers = meta(spark, sf).withColumns(
        {"number_of_reviews_processed": F.lit(1), "number_of_topics": F.lit(0), "bertopic_parameters": F.lit("{}")}
    )
    store.append("insights_meta", headers, "a")
    before = _table_sizes(store).withColumnRenamed("n", "before")
    before = land(before, "sizes")
    store.reset()
    return before.join(_table_sizes(store).withColumnRenamed("n", "after"), "name")


def _table_sizes(store):
    sizes = [store.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in TABLES]
    total = sizes[0]
    for size in sizes[1:]:
        total = total.unionByName(size)
    return total
