"""Tables by bucket, change digests, sketches, observed counters, documents and rounds with state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Observation
from pyspark.sql import functions as F

from reviewloom.functions import variants
from reviewloom.operators import changes, extract, metrics, sketches
from reviewloom.operators.extract import parsed_v2
from reviewloom.operators.kmeans import KMeansSettings, kmeans_topics
from reviewloom.plans import stages
from reviewloom.queries.collected import DATE_V1, STARS_V1, pages_search, pages_v1, pages_v2
from reviewloom.queries.registry import query
from reviewloom.queries.scalars import MARKED_SQL, SQL_ENGLISH, marked
from reviewloom.queries.views import PAGED, REVIEWS, STOP_LIST, STOP_WORDS, reviews, table
from reviewloom.schemas import REVIEWS as REVIEW_ROWS
from reviewloom.session import land, remove_folder, scratch_path
from reviewloom.sinks.buckets import BucketTable
from reviewloom.sinks.store import ReviewStore
from reviewloom.sources import block_function, snapshots
from reviewloom.streaming import rounds
from reviewloom.streaming.snapshots import each_batch, land_first, read_landed, run_to_parquet

# --- tables by bucket -------------------------------------------------------------------------


def _stored(spark, sf):
    return reviews(spark, sf).select("review_id", "branch_id", "author", "rating", "text", "review_date", "scraped_at")


@query(f"""WITH {REVIEWS}, later AS (SELECT review_id, branch_id, 'second ' || author AS author, text FROM reviews WHERE branch_id % 3 = 0 AND review_id % 7 = 0
  UNION ALL SELECT review_id + 10000000, branch_id, author, text FROM reviews WHERE branch_id % 3 = 0 AND review_id % 5 = 0)
SELECT branch_id, review_id, author, sha256(text) AS text_key FROM reviews WHERE NOT (branch_id % 3 = 0 AND review_id % 7 = 0)
UNION ALL SELECT branch_id, review_id, author, sha256(text) FROM later""")
def bucket_upsert(spark, sf):
    """Reviews by bucket after a batch that changes some rows of every third branch and adds others, applied twice."""
    rows = _stored(spark, sf)
    store = BucketTable(spark, scratch_path(spark, "bucket-upsert"), REVIEW_ROWS, 32, "text")
    store.upsert(rows, ["review_id"], ["scraped_at"])
    third = rows.filter("branch_id % 3 = 0")
    batch = third.filter("review_id % 7 = 0").withColumn("author", F.concat(F.lit("second "), "author")).unionByName(
        third.filter("review_id % 5 = 0").withColumn("review_id", F.col("review_id") + 10_000_000)
    )
    for _ in range(2):
        store.upsert(batch, ["review_id"], ["scraped_at"])
    return store.stored().select("branch_id", "review_id", "author", "text_key")


@query(f"""WITH {REVIEWS}, batch AS (SELECT CASE WHEN review_id % 11 = 0 THEN NULL ELSE branch_id END AS branch_id, text FROM reviews
  UNION ALL SELECT branch_id, 'again ' || text FROM reviews WHERE review_id % 4 = 0),
stored AS (SELECT branch_id, text FROM reviews WHERE review_id % 2 = 0),
added AS (SELECT DISTINCT branch_id, text FROM batch WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.branch_id IS NOT DISTINCT FROM batch.branch_id AND s.text IS NOT DISTINCT FROM batch.text))
SELECT branch_id, count(*) FILTER (before) AS before, count(*) FILTER (NOT before) AS added, CAST(0 AS BIGINT) AS added_again FROM
  (SELECT DISTINCT branch_id, text, true AS before FROM stored UNION ALL SELECT branch_id, text, false FROM added) GROUP BY branch_id""")
def bucket_insert_absent(spark, sf):
    """Reviews that are not stored yet, null branches among them, added by bucket; a second time adds none."""
    rows = _stored(spark, sf)
    store = BucketTable(spark, scratch_path(spark, "bucket-insert"), REVIEW_ROWS, 32, "text")
    before = store.insert_absent(rows.filter("review_id % 2 = 0"), ["review_id"])
    batch = rows.withColumn("branch_id", F.when(F.col("review_id") % 11 != 0, F.col("branch_id"))).unionByName(
        rows.filter("review_id % 4 = 0").withColumn("text", F.concat(F.lit("again "), "text"))
    )
    added = store.insert_absent(batch, ["review_id"])
    again = store.insert_absent(batch, ["review_id"])
    step = before.select("branch_id", F.lit(0).alias("step")).unionByName(added.select("branch_id", F.lit(1).alias("step")))
    step = step.unionByName(again.select("branch_id", F.lit(2).alias("step")))
    return step.groupBy("branch_id").agg(
        *(F.count_if(F.col("step") == k).alias(name) for k, name in enumerate(("before", "added", "added_again")))
    )


# --- changes --------------------------------------------------------------------------------------

EARLIER_SQL = f"""{REVIEWS}, now AS (SELECT branch_id, review_id, text FROM reviews WHERE branch_id % 5 <> 4),
earlier AS (SELECT branch_id, review_id, CASE WHEN branch_id % 5 = 1 AND review_id % 3 = 0 THEN 'old ' || text ELSE text END AS text
  FROM reviews WHERE branch_id % 5 <> 2 UNION ALL SELECT branch_id, review_id, text FROM reviews WHERE branch_id % 5 = 3)"""


def _two_states(spark, sf):
    """Reviews now and earlier: by branch modulo 5 unchanged, other texts, not there yet, every row twice, gone since."""
    rows = reviews(spark, sf).select("branch_id", "review_id", "text")
    kind = F.col("branch_id") % 5
    old = F.when((kind == 1) & (F.col("review_id") % 3 == 0), F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    earlier = rows.filter(kind != 2).withColumn("text", old).unionByName(rows.filter(kind == 3))
    return rows.filter(kind != 4), earlier


@query(f"""WITH {EARLIER_SQL},
counted AS (SELECT branch_id, review_id, text, sum(n) AS n, sum(m) AS m FROM (
  SELECT *, 1 AS n, 0 AS m FROM now UNION ALL SELECT *, 0, 1 FROM earlier) GROUP BY ALL)
SELECT branch_id, CASE WHEN sum(m) = 0 THEN 'new' WHEN sum(n) = 0 THEN 'gone' ELSE 'changed' END AS change
FROM counted GROUP BY branch_id HAVING bool_or(n <> m)""")
def changed_branches(spark, sf):
    """Branches whose reviews are not the same multiset as before."""
    now, earlier = _two_states(spark, sf)
    return changes.changed_branches(changes.branch_digests(now), changes.branch_digests(earlier))


@query(f"""WITH {EARLIER_SQL}, counted AS (SELECT branch_id, review_id, text, sum(n) AS n, sum(m) AS m FROM (
  SELECT *, 1 AS n, 0 AS m FROM now UNION ALL SELECT *, 0, 1 FROM earlier) GROUP BY ALL),
moved AS (SELECT branch_id FROM counted GROUP BY branch_id HAVING bool_or(n <> m) AND sum(n) > 0)
SELECT 1 AS run, branch_id, count(*) AS rows FROM earlier GROUP BY branch_id
UNION ALL SELECT 3, branch_id, count(*) FROM now JOIN moved USING (branch_id) GROUP BY branch_id""")
def stage_work_by_run(spark, sf):
    """Rows that a stage is given: all in its first run, none in a second over the same rows, changed branches in a third."""
    now, earlier = _two_states(spark, sf)
    out = scratch_path(spark, "stage-work")
    state = changes.StageDigests(spark, f"{out}/digests")
    for run, rows in ((1, earlier), (2, earlier), (3, now)):
        def work(moved, gone, run=run):
            counts = moved.groupBy("branch_id").agg(F.count("*").alias("rows")).withColumn("run", F.lit(run))
            counts.write.mode("append").parquet(f"{out}/work")

        state.run("normalise", rows, work)
    return spark.read.parquet(f"{out}/work").select("run", "branch_id", "rows")


# --- sketches, counters, documents ----------------------------------------------------------------


@query(f"""WITH {REVIEWS}, seen AS (SELECT branch_id, text AS id, review_id % 3 AS round FROM reviews UNION ALL
  SELECT branch_id, text, 3 FROM reviews WHERE review_id % 2 = 0)
SELECT branch_id, count(DISTINCT id) AS ids, count(*) AS sightings, true AS within_bound, true AS merge_is_one_pass FROM seen GROUP BY branch_id""")
def distinct_ids_by_sketches(spark, sf):
    """Distinct ids per branch from the sketches of four rounds, held against the exact count and against one pass."""
    rows = reviews(spark, sf).select("branch_id", F.col("text").alias("id"), (F.col("review_id") % 3).alias("round"))
    seen = rows.unionByName(reviews(spark, sf).filter("review_id % 2 = 0").select("branch_id", F.col("text").alias("id"), F.lit(3).cast("long").alias("round")))
    kept = land(sketches.id_sketches(seen, ["branch_id", "round"], "id"), "sketches")
    merged = sketches.distinct_estimates(kept, ["branch_id"])
    once = sketches.distinct_estimates(sketches.id_sketches(seen, ["branch_id"], "id"), ["branch_id"])
    exact = seen.groupBy("branch_id").agg(F.count_distinct("id").alias("exact"))
    off = F.abs(F.col("m.ids") - F.col("exact")) <= F.ceil(sketches.error_bound() * F.col("exact"))
    return merged.alias("m").join(once.alias("o"), "branch_id").join(exact, "branch_id").select(
        "branch_id", F.col("exact").alias("ids"), F.col("m.sightings").alias("sightings"),
        off.alias("within_bound"), (F.col("m.ids") == F.col("o.ids")).alias("merge_is_one_pass"),
    )


@query(f"""WITH {REVIEWS}, {MARKED_SQL}, cleaned AS (SELECT {SQL_ENGLISH} AS text FROM marked)
SELECT count(*) AS found, count(*) FILTER (text <> '') AS kept, count(*) FILTER (coalesce(text, '') = '') AS skipped,
  count(*) FILTER (text <> '') AS written FROM cleaned""")
def observed_cleaning(spark, sf):
    """Counters of the English cleaning, observed while its result was written, beside the rows that were written."""
    seen = Observation("cleaning")
    kept = land(metrics.observed_cleaning(marked(spark, sf), seen), "observed")
    counters = seen.get
    return kept.agg(
        *(F.lit(counters[name]).cast("long").alias(name) for name in ("found", "kept", "skipped")), F.count("*").alias("written")
    )


@query("""WITH runs AS (SELECT o_orderkey AS meta_id, o_custkey AS branch_id, o_orderkey % 5 AS kind, o_orderkey % 4 + 3 AS size FROM orders)
SELECT meta_id, branch_id, CASE WHEN kind = 4 THEN NULL ELSE size END AS min_topic_size,
  CASE kind WHEN 0 THEN 'value' WHEN 1 THEN 'null' WHEN 4 THEN 'no document' ELSE 'missing' END AS note_state,
  CASE WHEN kind = 0 THEN 'note ' || meta_id END AS note FROM runs WHERE kind = 4 OR size = 5""")
def runs_by_parameter(spark, sf):
    """Run headers whose parameters are a stored VARIANT: those of one topic size, and those whose text is no JSON."""
    orders = table(spark, sf, "orders")
    size = (F.col("o_orderkey") % 4 + 3).cast("string")
    note = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN ',"note":"note ' || o_orderkey || '"' WHEN 1 THEN ',"note":null' ELSE '' END""")
    text = F.when(F.col("o_orderkey") % 5 == 4, "min_topic_size: 5").otherwise(
        F.concat(F.lit('{"min_topic_size":'), size, F.lit(',"ngram_range":[1,2]'), note, F.lit("}"))
    )
    runs = orders.select(F.col("o_orderkey").alias("meta_id"), F.col("o_custkey").alias("branch_id"), variants.as_variant(text).alias("parameters"))
    path = scratch_path(spark, "runs")
    runs.write.parquet(path)
    stored = spark.read.parquet(path)
    chosen = variants.with_parameter(stored, "$.min_topic_size", "int", 5).unionByName(stored.filter("parameters IS NULL"))
    return chosen.select(
        "meta_id", "branch_id", variants.field(F.col("parameters"), "$.min_topic_size", "long").alias("min_topic_size"),
        variants.field_state(F.col("parameters"), "$.note").alias("note_state"), variants.field(F.col("parameters"), "$.note", "string").alias("note"),
    )


# --- rounds with state, snapshots by offset ---------------------------------------------------------


@query(f"""WITH {REVIEWS}, seen AS (SELECT branch_id, text AS id, round FROM reviews JOIN (SELECT unnest(range(3)) AS round) ON review_id % 3 <= round),
firsts AS (SELECT branch_id, id, min(round) AS round FROM seen GROUP BY ALL),
fresh AS (SELECT branch_id, round, count(*) AS new_ids FROM firsts GROUP BY ALL)
SELECT branch_id, round, count(*) AS sightings, any_value(coalesce(new_ids, 0)) AS new_ids FROM seen LEFT JOIN fresh USING (branch_id, round) GROUP BY ALL""")
def stateful_rounds(spark, sf):
    """Sightings and new ids of three rounds, the stream being started again for each; state holds what was seen."""
    rows = reviews(spark, sf).select("branch_id", F.sha2("text", 256).alias("id"), "review_id")
    out = scratch_path(spark, "stateful-rounds")
    for number in range(3):
        arrived = rows.filter(F.col("review_id") % 3 <= number).select("branch_id", "id", F.lit(number).cast("long").alias("round"))
        arrived.write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{out}/in")
        run_to_parquet(rounds.new_ids_by_round(stream), f"{out}/rows", f"{out}/progress").awaitTermination()
    for spent in ("in", "progress"):
        remove_folder(spark, f"{out}/{spent}")
    return rounds.rounds_of_parts(spark.read.parquet(f"{out}/rows"))


@query(f"""WITH {PAGED}, read AS (SELECT url, page_no, review_id AS n, stripped AS text, CASE WHEN review_id % 4 = 3 THEN 'Unknown' ELSE author END AS author
  FROM paged WHERE length(stripped) >= 10)
SELECT DISTINCT url, CASE WHEN page_no % 4 = 0 THEN 'r' || (n % 160) ELSE 'text:' || sha256(text) || '|author:' || author END AS review_id,
  CAST(page_no % 3 AS INT) AS snapshot_no FROM read""")
def snapshot_source_reviews(spark, sf):
    """Pages read as a stream by snapshot number, each run after a restart; reviews land with their first snapshot."""
    pages = pages_v2(spark, sf)
    number = F.expr("cast(page_id / 1000 AS BIGINT)") % 3
    out = scratch_path(spark, "snapshot-source")
    snapshots.register(spark)
    land_new = lambda batch, batch_id: land_first(batch, batch_id, f"{out}/rows", ["url", "review_id"], ["block_no"])
    for r in range(3):
        arrived = pages.filter(number <= r).withColumn("snapshot_no", F.lit(r))
        snapshots.write_snapshot(arrived, f"{out}/in", r)
        parsed = parsed_v2(spark.readStream.format(snapshots.NAME).load(f"{out}/in"))
        each_batch(parsed, land_new, f"{out}/progress").awaitTermination()
    for spent in ("in", "progress"):
        remove_folder(spark, f"{out}/{spent}")
    return read_landed(spark, f"{out}/rows").select("url", "review_id", "snapshot_no")


# --- blocks in SQL -----------------------------------------------------------------------------------


@query(f"""WITH {PAGED} SELECT page_id, url, block_no, CASE WHEN review_id % 5 = 0 THEN 'Unknown' ELSE author END AS author,
  {STARS_V1} AS label, stripped AS text, coalesce({DATE_V1}, '') AS date_raw FROM paged""")
def review_blocks_in_sql(spark, sf):
    """Blocks of the first rule set from SQL text alone, by a table function."""
    block_function.register(spark)
    pages_v1(spark, sf).createOrReplaceTempView("reviewloom_pages_v1")
    return spark.sql(
        "SELECT p.page_id, p.url, b.block_no, b.author, b.label, b.text, b.date_raw "
        "FROM reviewloom_pages_v1 p, LATERAL review_blocks(p.html) b"
    )


@query(f"""WITH {PAGED} SELECT page_id, url, block_no, CASE WHEN page_no % 4 = 0 THEN 'r' || (review_id % 160) END AS given_id,
  CASE WHEN review_id % 4 = 3 THEN 'Unknown' ELSE author END AS author, stripped AS text, true AS same_as_columns FROM paged WHERE length(stripped) >= 10""")
def review_blocks_v2_in_sql(spark, sf):
    """Usable blocks of the second rule set from SQL text alone, held against the column rules row by row."""
    block_function.register(spark)
    pages = pages_v2(spark, sf)
    pages.createOrReplaceTempView("reviewloom_pages_v2")
    found = spark.sql(
        "SELECT p.page_id, p.url, b.* FROM reviewloom_pages_v2 p, LATERAL review_blocks_v2(p.html) b WHERE length(b.text) >= 10"
    )
    same = ["page_id", "block_no", "given_id", "author", "text", "date_raw"]
    columns = extract.review_blocks_v2(pages).filter("length(text) >= 10").select(*same, F.lit(True).alias("met"))
    met = reduce(lambda a, b: a & b, (F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in same))
    return found.alias("f").join(columns.alias("c"), met, "left").select(
        "f.page_id", "url", "f.block_no", "f.given_id", "f.author", "f.text", F.coalesce("met", F.lit(False)).alias("same_as_columns")
    )


@query(f"""WITH {PAGED} SELECT page_id, url, count(*) AS blocks, count(*) FILTER (length(stripped) < 10) AS left_out FROM paged GROUP BY ALL""")
def left_out_blocks(spark, sf):
    """Blocks per page, and those left out because their text is too short."""
    return extract.left_out_blocks(pages_v1(spark, sf))


# --- search flow ---------------------------------------------------------------------------------------


@query(f"""WITH {PAGED} SELECT url, page_id % 7 = 3 AS skipped, CASE WHEN page_id % 7 = 3 THEN 'captcha' END AS reason,
  CASE WHEN page_id % 7 <> 3 THEN count(*) END AS found, CASE WHEN page_id % 7 <> 3 THEN count(DISTINCT stripped) END AS new,
  CASE WHEN page_id % 7 <> 3 THEN 0 END AS errors, page_id % 7 <> 3 AS stored FROM paged GROUP BY url, page_id""")
def collected_places(spark, sf):
    """Status of a search run per link: blocked pages skipped, found and new reviews, and whether the place is stored."""
    blocked = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("<p>unusual traffic</p>"), "html")).otherwise(F.col("html"))
    pages = pages_search(spark, sf).withColumn("html", blocked)
    store = ReviewStore(spark, scratch_path(spark, "collected-places"))
    store.ensure()
    status = stages.collect_places(store, pages, "one")
    known = store.read("branches").select("url", F.lit(True).alias("stored"))
    return status.drop("name").join(known, "url", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


# --- topics by k-means ------------------------------------------------------------------------------

KMEANS = KMeansSettings(min_topic_size=5, topics=4, stop_words=STOP_WORDS)


@query(f"""WITH {REVIEWS}, words AS (SELECT branch_id, review_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP_LIST}))) > 0 AS worded FROM reviews)
SELECT branch_id, count(*) AS reviews, count(*) FILTER (worded) AS in_topics, count(*) FILTER (NOT worded) AS outliers,
  true AS at_most_four, true AS large_enough, true AS numbered_by_size FROM words GROUP BY branch_id HAVING count(*) FILTER (worded) >= 5""")
def kmeans_topic_checks(spark, sf):
    """Topics by bisecting k-means of every branch, as what must hold for them."""
    rows = reviews(spark, sf).select("branch_id", "review_id", F.col("text").alias("normalized_text"))
    found = land(kmeans_topics(rows, KMEANS), "kmeans-topics")
    sizes = found.filter("topic >= 0").groupBy("branch_id", "topic").agg(F.count("*").alias("size"))
    facts = sizes.groupBy("branch_id").agg(
        F.sum("size").alias("in_topics"), (F.count("*") <= KMEANS.topics).alias("at_most_four"),
        (F.min("size") >= KMEANS.min_topic_size).alias("large_enough"),
        F.array_sort(F.collect_list(F.struct("topic", "size"))).alias("order"),
    )
    falling = F.forall(F.sequence(F.lit(1), F.size("order")), lambda k: (k == 1) | (F.get(F.col("order.size"), k - 2) >= F.get(F.col("order.size"), k - 1)))
    counts = found.groupBy("branch_id").agg(F.count("*").alias("reviews"), F.count_if(F.col("topic") < 0).alias("outliers"))
    return counts.join(facts, "branch_id").select(
        "branch_id", "reviews", "in_topics", "outliers", "at_most_four", "large_enough",
        (falling & (F.get(F.col("order.topic"), F.lit(0)) == 0)).alias("numbered_by_size"),
    )
