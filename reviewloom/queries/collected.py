"""Branch lists, pages and what is extracted from them."""

from __future__ import annotations

from pyspark.sql import functions as F


from reviewloom.functions.text import text_key
from reviewloom.operators import extract, reports
from reviewloom.operators.dedupe import first_n, keep_first, new_per_round, not_seen, union_first_seen
from reviewloom.plans import stages
from reviewloom.queries.registry import query
from reviewloom.queries.views import PAGED, REVIEWS, escaped, pages_of, reviews, table
from reviewloom.session import scratch_path
from reviewloom.sinks.store import ReviewStore
from reviewloom.sources.branch_list import branches_of
from reviewloom.sources.tables import branch_ids_of, normalized_texts, reviews_for_normalising

# --- branch lists ---------------------------------------------------------------------


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'page ' || page_id ELSE url END AS name, url FROM pages
UNION ALL SELECT page_id, url || '#b', url || '#b' FROM pages
UNION ALL SELECT page_id, url || '#c', url || '#c' FROM pages""")
def branch_list_items(spark, sf):
    named = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("page "), "page_id"))
    entry = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    items = F.array(
        entry(name=named, url=F.col("url")),
        F.concat(F.lit('"'), "url", F.lit('#b"')),
        entry(name=F.lit(""), url=F.concat("url", F.lit("#c"))),
        entry(name=F.col("url")), entry(url=F.lit("")), F.lit("7"), F.lit("null"), F.lit("[1]"),
    )
    lists = table(spark, sf, "pages").withColumn("document", F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
    return branches_of(lists.select("page_id", "document"), F.col("document")).select("page_id", "name", "url")


# --- reads ----------------------------------------------------------------------------


@query(f"WITH {REVIEWS} SELECT review_id, branch_id, author, rating, text AS original_text FROM reviews")
def reviews_renamed(spark, sf):
    return reviews_for_normalising(reviews(spark, sf)).drop("review_date", "scraped_at")


@query(f"WITH {REVIEWS} SELECT branch_id, review_id, text AS normalized_text FROM reviews WHERE branch_id = 7")
def normalized_texts_of_branch(spark, sf):
    stored = reviews(spark, sf).withColumnRenamed("text", "normalized_text")
    return normalized_texts(stored, branch_id=7)


@query("""SELECT o_orderkey, o_url AS url, min(id) AS branch_id FROM (
  SELECT o_orderkey, 'https://maps.example/' || (o_custkey % 700) AS o_url FROM orders) o
LEFT JOIN (SELECT c_custkey AS id, 'https://maps.example/' || (c_custkey % 600) AS url FROM customer) b ON o_url = b.url
GROUP BY ALL""")
def branch_of_link(spark, sf):
    link = lambda key, n: F.concat(F.lit("https://maps.example/"), F.col(key) % n)
    orders = table(spark, sf, "orders").select("o_orderkey", link("o_custkey", 700).alias("url"))
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), link("c_custkey", 600).alias("url"))
    return branch_ids_of(orders, stored)


# --- place pages, first rule set --------------------------------------------------------

STARS_V1 = """CASE review_id % 7 WHEN 0 THEN '5 stars' WHEN 1 THEN '4.5 stars' WHEN 2 THEN '٤ نجوم' WHEN 3 THEN '10 stars'
  WHEN 4 THEN NULL WHEN 5 THEN '3.0 stars' ELSE 'no number' END"""
DATE_V1 = """CASE review_id % 6 WHEN 0 THEN '2 weeks ago' WHEN 1 THEN '3 days ago on Tripadvisor' WHEN 2 THEN '1 month ago'
  WHEN 3 THEN 'A week ago' WHEN 4 THEN 'قبل 3 يوم' END"""
READ_DATE_V1 = """CASE review_id % 6 WHEN 0 THEN '2025-10-01' WHEN 1 THEN '2025-10-12' WHEN 2 THEN '2025-09-15'
  WHEN 3 THEN 'a week ago' WHEN 4 THEN '2025-10-12' ELSE '' END"""


def _span(value, start, end="</span>"):
    return F.coalesce(F.concat(F.lit(start), value, F.lit(end)), F.lit(""))


def pages_v1(spark, sf):
    author = F.when(F.col("review_id") % 5 != 0, F.col("author"))
    block = F.concat(
        F.lit('<div class="jJc9Ad" data-review-id="r'), "review_id", F.lit('"><p>'),
        _span(author, '<div class="d4r55 fontTitleMedium"> ', "</div>"),
        _span(F.expr(STARS_V1), '<span role="img" aria-label="', '"></span>'),
        _span(F.expr(DATE_V1), '<span class="xRkPPb">'),
        F.lit('<br><div class="MyEned"><span class="wiI7pd">'), escaped(F.col("text")), F.lit("</span></div><button>More</button></div>"),
    )
    return pages_of(spark, sf, block)


@query(f"""WITH {PAGED}, usable AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, stripped ORDER BY block_no) AS nth
  FROM paged WHERE length(stripped) >= 10)
SELECT page_id, url, block_no, CASE WHEN review_id % 5 = 0 THEN 'Unknown' ELSE author END AS author,
  CASE review_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 5 THEN 3 ELSE 0 END AS rating,
  stripped AS text, {READ_DATE_V1} AS review_date FROM usable WHERE nth = 1""")
def page_reviews_v1(spark, sf):
    found = extract.reviews_v1(pages_v1(spark, sf))
    return found.select("page_id", "url", "block_no", "author", "rating", "text", "review_date")


# --- place pages, second rule set ---------------------------------------------------------


def pages_v2(spark, sf):
    number = F.col("review_id")
    layout = F.col("page_no") % 4
    opening = (
        F.when(layout == 0, F.concat(F.lit('<div data-review-id="r'), number % 160, F.lit('">')))
        .when(layout == 1, '<div class="x jftiEf y">')
        .when(layout == 2, '<div class="hjmQqc">')
        .otherwise('<div class="VjjEkf"><div class="plain">')
    )
    author = (
        F.when(number % 4 == 0, F.concat(F.lit('<b class="kyCNSe">'), "author", F.lit("</b>")))
        .when(number % 4 == 1, F.concat(F.lit('<i id="ml-reviews-page-user-review-name-'), number, F.lit('"> '), "author", F.lit(" </i>")))
        .when(number % 4 == 2, F.concat(F.lit('<button aria-label="Open Profile">'), "author", F.lit("</button>")))
        .otherwise("")
    )
    stars = (
        F.when(number % 5 == 0, '<i role="img" aria-label="4/5"></i>')
        .when(number % 5 == 1, '<i role="img" aria-label="unrated"></i><i role="img" aria-label="Rating of 3"></i>')
        .when(number % 5 == 2, '<span class="kvMYJc">2 stars</span>')
        .when(number % 5 == 3, '<i role="img" aria-label="12 stars"></i>')
        .otherwise('<span class="fontBodyLarge fzvQIb">٥</span>')
    )
    date = (
        F.when(number % 3 == 0, '<span class="bHyEBc"> 2 weeks ago </span>')
        .when(number % 3 == 1, "<time>March 2024</time>")
        .otherwise("<span>edited 2 days ago</span>")
    )
    body = escaped(F.col("text"))
    text = (
        F.when((number % 3 == 0) & (F.length(F.expr("trim(text)")) > 60), F.concat(F.lit("<p>"), body, F.lit("</p>")))
        .when(number % 3 == 1, F.concat(F.lit("<p data-review-text>"), body, F.lit("</p>")))
        .otherwise(F.concat(F.lit('<div class="MyEned"><span class="wiI7pd">'), body, F.lit("</span></div>")))
    )
    closing = F.when(layout == 3, "</div></div>").otherwise("</div>")
    return pages_of(spark, sf, F.concat(opening, author, stars, date, text, closing))


@query(f"""WITH {PAGED}, read AS (
  SELECT page_id, url, block_no, stripped AS text,
    CASE WHEN review_id % 4 = 3 THEN 'Unknown' ELSE author END AS author,
    CASE review_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 12 ELSE 5 END AS rating,
    CASE review_id % 3 WHEN 0 THEN '2 weeks ago' WHEN 1 THEN 'March 2024' ELSE 'edited 2 days ago' END AS date_raw,
    CASE review_id % 3 WHEN 0 THEN '2025-10-01' WHEN 1 THEN 'march 2024' ELSE '2025-10-13' END AS review_date,
    CASE WHEN page_no % 4 = 0 THEN 'r' || (review_id % 160) END AS given FROM paged WHERE length(stripped) >= 10),
keyed AS (SELECT *, coalesce(given, 'text:' || sha256(text) || '|author:' || author) AS review_id FROM read),
once AS (SELECT *, row_number() OVER (PARTITION BY page_id, review_id ORDER BY block_no) AS nth FROM keyed)
SELECT page_id, url, block_no, review_id, author, rating, text, date_raw, review_date, '2025-10-15 12:00:00' AS scraped_at
FROM once WHERE nth = 1""")
def page_reviews_v2(spark, sf):
    found = extract.reviews_v2(pages_v2(spark, sf))
    return found.select(
        "page_id", "url", "block_no", "review_id", "author", "rating", "text", "date_raw", "review_date", "scraped_at"
    )


# --- search pages -----------------------------------------------------------------------


def pages_search(spark, sf):
    rated = F.concat(
        F.lit('<span role="link">'), "author", F.lit('</span><i>x</i><div aria-label="Rated '), F.col("review_id") % 6,
        F.lit(' stars">'), escaped(F.col("text")), F.lit("</div>"),
    )
    head = F.concat(F.lit("<html><head><title> Place "), "branch_id", F.lit(" </title></head>"))
    return pages_of(spark, sf, rated, head)


SEARCH_ROWS = f"""{PAGED}, found AS (
  SELECT page_id, url, branch_id, block_no, author, CAST(review_id % 6 AS INT) AS rating, stripped AS text,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS source_text FROM paged)"""


@query(f"WITH {SEARCH_ROWS} SELECT page_id, url, block_no, author, rating, text, '' AS review_date FROM found")
def search_page_reviews(spark, sf):
    return extract.reviews_search(pages_search(spark, sf))


@query(f"""WITH {SEARCH_ROWS} SELECT page_id, 'Place ' || branch_id AS name, url, url AS place_id,
  string_agg(author || '|' || rating || '|' || text, '~' ORDER BY block_no) AS reviews,
  sha256('<html><head><title> Place ' || branch_id || ' </title></head>' || string_agg('<span role="link">' || author
    || '</span><i>x</i><div aria-label="Rated ' || rating || ' stars">' || source_text || '</div>', '' ORDER BY block_no)
    || '<p>end</body></html>') AS raw_sha256
FROM found GROUP BY page_id, branch_id, url""")
def place_records(spark, sf):
    records = extract.place_records(pages_search(spark, sf))
    lines = F.transform("reviews", lambda r: F.concat_ws("|", r["author"], r["rating"], r["text"]))
    return records.select(
        "page_id", "name", "url", "place_id", F.array_join(lines, "~").alias("reviews"), F.sha2("raw_html", 256).alias("raw_sha256")
    )


@query(f"""WITH {PAGED}, hrefs AS (
  SELECT page_id, url, 2 * block_no AS link_no, 'https://www.google.com/maps/place/' || (review_id % 7) AS href FROM paged
  WHERE review_id % 3 <> 2), firsts AS (
  SELECT page_id, url, href, min(link_no) AS link_no FROM hrefs GROUP BY ALL)
SELECT page_id, url, link_no, href FROM firsts""")
def place_links(spark, sf):
    target = F.concat(F.lit("https://www.google.com/maps/place/"), F.col("review_id") % 7)
    kind = F.col("review_id") % 3
    href = (
        F.when(kind == 0, F.concat(F.lit("/url?q="), target, F.lit("&amp;sa=U&amp;x=1")))
        .when(kind == 1, target)
        .otherwise(F.concat(F.lit("/search/"), "review_id"))
    )
    block = F.concat(F.lit("<a href='"), href, F.lit("'>place</a><a href=/help>help</a><a>none</a>"))
    return extract.place_links(pages_of(spark, sf, block))


@query("""SELECT page_id, url, CAST(i - 1 AS INT) AS link_no, hrefs[i] AS href FROM (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages) t, range(1, 100) r(i)
WHERE i <= len(hrefs)""")
def page_links(spark, sf):
    return extract.links(table(spark, sf, "pages"))


# --- ids, counts and status while pages grow ------------------------------------------------


def pages_growing(spark, sf):
    number = F.col("review_id")
    kind = number % 4
    block = (
        F.when(kind == 0, F.concat(F.lit('<div data-review-id="'), number, F.lit('"><span aria-label="5 stars"></span></div>')))
        .when(kind == 1, F.concat(F.lit('<div data-review-id="review-number-'), number, F.lit('">'), escaped(F.col("text")), F.lit("</div>")))
        .when(kind == 2, F.concat(
            F.lit('<div class="jftiEf"><b class="user-name">'), "author", F.lit('</b><i aria-label="4 stars"></i>'),
            escaped(F.col("text")), F.lit("</div>")))
        .otherwise(F.concat(F.lit('<div role="article">'), number, F.lit("</div>")))
    )
    return pages_of(spark, sf, block)


@query(f"""WITH {PAGED}, ids AS (SELECT page_id, CAST(CASE review_id % 4 WHEN 0 THEN CAST(review_id AS VARCHAR)
    WHEN 1 THEN 'review-number-' || review_id
    WHEN 2 THEN author || ' ' || stripped || '|4 stars|' || author
    ELSE review_id || '||' END AS VARCHAR) AS review_key FROM paged)
SELECT page_id, review_key FROM ids WHERE length(review_key) > 10""")
def dialog_review_ids(spark, sf):
    return extract.modal_review_ids(pages_growing(spark, sf)).select("page_id", "review_key")


@query(f"""WITH {PAGED} SELECT page_id, CASE review_id % 4 WHEN 0 THEN CAST(review_id AS VARCHAR)
    WHEN 1 THEN 'review-number-' || review_id ELSE author || ' ' || stripped END AS review_key
FROM paged WHERE review_id % 4 <> 3""")
def scrolled_review_ids(spark, sf):
    return extract.live_review_ids(pages_growing(spark, sf)).select("page_id", "review_key")


@query(f"""WITH {PAGED} SELECT page_id, url, CAST(count(*) FILTER (review_id % 4 <> 3) AS INT) AS blocks,
  CAST(count(*) FILTER (review_id % 4 = 0 OR (review_id % 4 = 1 AND length(text) > 20)
    OR (review_id % 4 = 2 AND length(author) + length(text) > 20)) AS INT) AS filled_blocks
FROM paged GROUP BY page_id, url""")
def loaded_block_counts(spark, sf):
    return extract.loaded_counts(pages_growing(spark, sf))


@query("""SELECT page_id, url, regexp_matches(html, '(?i)unusual traffic|to continue, please|help us confirm|please show you''re not a robot|recaptcha') AS blocked
FROM (SELECT page_id, url, html || CASE page_id % 6 WHEN 0 THEN 'UNUSUAL traffic' WHEN 1 THEN 'reCAPTCHA' WHEN 2 THEN 'To continue, please'
  WHEN 3 THEN 'please show you''re not a ROBOT' ELSE '' END AS html FROM pages)""")
def blocked_pages(spark, sf):
    ending = F.expr("""CASE page_id % 6 WHEN 0 THEN 'UNUSUAL traffic' WHEN 1 THEN 'reCAPTCHA' WHEN 2 THEN 'To continue, please'
      WHEN 3 THEN "please show you're not a ROBOT" ELSE '' END""")
    pages = table(spark, sf, "pages").withColumn("html", F.concat("html", ending))
    return pages.select("page_id", "url", extract.is_blocked(F.col("html")).alias("blocked"))


def _status(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html", F.concat(F.lit("place "), "page_id").alias("name"))
    before = pages.withColumn("snapshot_no", F.lit(0)).withColumn(
        "html", F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("recaptcha"))).otherwise(F.col("html"))
    )
    after = pages.withColumn("snapshot_no", F.lit(1)).withColumn(
        "html", F.when(F.col("page_id") % 7 == 1, F.concat("html", F.lit("recaptcha"))).otherwise(F.col("html"))
    )
    fresh = F.count_if(F.col("link_no") % 2 == 0).alias("new")
    found = extract.links(pages).groupBy("url").agg(F.count("*").alias("found"), fresh)
    return reports.collection_status(before.unionByName(after), found)


STATUS_SQL = """status AS (SELECT 'place ' || page_id AS name, url, page_id % 7 IN (0, 1) AS skipped,
  CASE page_id % 7 WHEN 0 THEN 'captcha' WHEN 1 THEN 'captcha_after_scroll' END AS reason,
  CASE WHEN page_id % 7 > 1 THEN len(regexp_extract_all(html, '<a href=')) END AS found,
  CASE WHEN page_id % 7 > 1 THEN (len(regexp_extract_all(html, '<a href=')) + 1) // 2 END AS new,
  CASE WHEN page_id % 7 > 1 THEN 0 END AS errors FROM pages)"""


@query(f"WITH {STATUS_SQL} SELECT * FROM status")
def collection_status(spark, sf):
    return _status(spark, sf)


@query(f"""WITH {STATUS_SQL} SELECT CAST(floor(count(*) FILTER (NOT skipped) / greatest(1, count(*)) * 100) AS INT) AS percent FROM status""")
def completed_share(spark, sf):
    return reports.completed_percent(_status(spark, sf))


# --- whole collections ------------------------------------------------------------------------


def _broken(pages, every):
    """Some pages end in markup that the parser gives up on."""
    return pages.withColumn("html", F.when(F.col("page_id") % every == 0, F.concat("html", F.lit("<![foo[x]]>"))).otherwise(F.col("html")))


@query("""SELECT page_id, url, 'AssertionError' AS error FROM pages WHERE page_id % 5 = 0""")
def page_errors(spark, sf):
    return extract.page_errors(_broken(table(spark, sf, "pages"), 5))


def _collection(spark, sf):
    """Three snapshots of every page: the first half of its reviews, all of them, and one that some branches are blocked at."""
    pages = pages_v1(spark, sf)
    named = pages.withColumn("name", F.concat(F.lit("place "), "page_id"))
    again = named.withColumn("snapshot_no", F.lit(1)).withColumn("page_id", F.col("page_id") + 1_000_000)
    last = named.withColumn("snapshot_no", F.lit(2)).withColumn("page_id", F.col("page_id") + 2_000_000).withColumn(
        "html", F.when(F.col("page_id") % 3 == 0, "Recaptcha").otherwise(F.col("html"))
    )
    return named.unionByName(again).unionByName(last)


COLLECTED_SQL = f"""{PAGED}, passed AS (SELECT * FROM paged WHERE (page_id + 2000000) % 3 <> 0 AND length(stripped) >= 10),
usable AS (SELECT *, row_number() OVER (PARTITION BY url, stripped ORDER BY block_no) AS nth FROM passed)"""


@query(f"""WITH {COLLECTED_SQL} SELECT url, page_id, block_no, stripped AS text FROM usable WHERE nth = 1""")
def collected_reviews(spark, sf):
    _, found = stages.collected_reviews(_collection(spark, sf), stages.RunOptions())
    return found.select("url", "page_id", "block_no", "text")


@query(f"""WITH {COLLECTED_SQL}, urls AS (SELECT DISTINCT url, page_id FROM paged),
found AS (SELECT url, count(*) AS found FROM usable WHERE nth = 1 GROUP BY url)
SELECT 'place ' || page_id AS name, url, (page_id + 2000000) % 3 = 0 AS skipped,
  CASE WHEN (page_id + 2000000) % 3 = 0 THEN 'captcha_after_scroll' END AS reason,
  CASE WHEN (page_id + 2000000) % 3 <> 0 THEN coalesce(found, 0) END AS found,
  CASE WHEN (page_id + 2000000) % 3 <> 0 THEN coalesce(found, 0) END AS new,
  CASE WHEN (page_id + 2000000) % 3 <> 0 THEN 0 END AS errors,
  (page_id + 2000000) % 3 <> 0 AS stored FROM urls LEFT JOIN found USING (url)""")
def collected_branches(spark, sf):
    pages = _collection(spark, sf)
    store = ReviewStore(spark, scratch_path(spark, "collected-branches"))
    listed = pages.filter("snapshot_no = 0").select("name", "url")
    status = stages.collect(store, listed, pages.drop("name"), stages.RunOptions(), "one")
    known = store.read("branches").select("url", F.lit(True).alias("stored"))
    return status.join(known, "url", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


# --- first-wins choices over tables ---------------------------------------------------------


@query(f"""WITH {REVIEWS} SELECT branch_id, substring(text, 1, 160) AS opening, min(review_id) AS review_id
FROM reviews WHERE length(text) >= 10 GROUP BY ALL""")
def dedupe_by_opening(spark, sf):
    rows = reviews(spark, sf).filter(F.length("text") >= 10).withColumn("opening", extract.snippet(F.col("text")))
    return keep_first(rows, ["branch_id", "opening"], ["review_id"]).select("branch_id", "opening", "review_id")


@query(f"""WITH {REVIEWS} SELECT 'text:' || sha256(text) || '|author:' || source AS review_key, min(review_id) AS review_id
FROM reviews GROUP BY ALL""")
def dedupe_by_review_key(spark, sf):
    key = extract.review_key(F.lit(""), F.col("text"), F.col("source"))
    rows = reviews(spark, sf).withColumn("review_key", key)
    return keep_first(rows, ["review_key"], ["review_id"]).select("review_key", "review_id")


@query(f"""WITH {REVIEWS} SELECT branch_id, review_id FROM (
  SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY review_id) AS n FROM reviews) WHERE n <= 10""")
def first_reviews_per_branch(spark, sf):
    return first_n(reviews(spark, sf), ["branch_id"], ["review_id"], 10).select("branch_id", "review_id")


def _sightings(spark, sf):
    docs = reviews(spark, sf).select(
        "branch_id", (F.col("review_id") % 12).alias("snapshot_no"), text_key(F.col("text")).alias("review_key")
    )
    talks = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 20).alias("branch_id"), "turn", text_key(F.col("text")).alias("review_key")
    )
    return docs, talks.withColumnRenamed("turn", "snapshot_no")


SIGHTINGS_SQL = f"""{REVIEWS}, sightings AS (
  SELECT branch_id, review_id % 12 AS snapshot_no, sha256(text) AS review_key FROM reviews
  UNION ALL SELECT conv_id % 20, turn, sha256(text) FROM conversations)"""


@query(f"WITH {SIGHTINGS_SQL} SELECT branch_id, review_key, min(snapshot_no) AS snapshot_no FROM sightings GROUP BY ALL")
def union_first_sighting(spark, sf):
    return union_first_seen(_sightings(spark, sf), ["branch_id", "review_key"], ["snapshot_no"])


@query(f"""WITH {SIGHTINGS_SQL}, firsts AS (SELECT branch_id, review_key, min(snapshot_no) AS snapshot_no FROM sightings GROUP BY ALL),
rounds AS (SELECT branch_id, snapshot_no, count(*) AS sightings FROM sightings GROUP BY ALL),
fresh AS (SELECT branch_id, snapshot_no, count(*) AS new_ids FROM firsts GROUP BY ALL)
SELECT branch_id, snapshot_no, sightings, coalesce(new_ids, 0) AS new_ids,
  CAST(sum(coalesce(new_ids, 0)) OVER (PARTITION BY branch_id ORDER BY snapshot_no) AS BIGINT) AS seen_ids
FROM rounds LEFT JOIN fresh USING (branch_id, snapshot_no)""")
def new_ids_per_round(spark, sf):
    docs, talks = _sightings(spark, sf)
    return new_per_round(docs.unionByName(talks), ["review_key"], "branch_id", "snapshot_no")


@query(f"""WITH {SIGHTINGS_SQL} SELECT branch_id, count(DISTINCT review_key) AS ids FROM sightings GROUP BY branch_id""")
def distinct_ids_per_branch(spark, sf):
    docs, talks = _sightings(spark, sf)
    return reports.distinct_ids(docs.unionByName(talks), "branch_id", "review_key")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def ids_not_seen(spark, sf):
    return not_seen(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])
