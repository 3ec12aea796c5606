"""Upserts, the store, streams and whole runs on small tables."""

import datetime as dt
import math
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import bags, terms, topics, upsert
from reviewloom.operators.language import detect_language, fit_language
from reviewloom.operators.reports import branch_choice, collection_status, nested_insights
from reviewloom.operators.topics import TopicSettings, assign_topics, topic_shares
from reviewloom.operators.terms import read_stop_words
from reviewloom.plans import stages
from reviewloom.plans.stages import RunOptions, insights_or_run, run, stored_insights
from reviewloom.sinks.files import read_reviews_csv, write_reviews_csv
from reviewloom.sinks.store import ReviewStore
from reviewloom.schemas import BRANCHES, INSIGHTS, INSIGHTS_META, PAGES, REVIEW_CSV, REVIEWS
from reviewloom.sources.branch_list import read_branch_lines, read_branch_list, write_branch_list
from reviewloom.streaming.snapshots import each_batch, land_reviews, upsert_each_batch

T0 = dt.datetime(2025, 10, 15)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def review(i, branch, text, minute=0):
    return (i, branch, "a", 3, text, "", at(minute))


def test_upsert_twice_equals_once(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    once = upsert.upsert(base, batch, ["k"], ["n"])
    assert as_set(once, "k", "v") == {(1, "a"), (2, "y"), (3, "z")}
    assert as_set(upsert.upsert(once, batch, ["k"], ["n"]), "k", "v") == as_set(once, "k", "v")


def test_new_reviews_skip_stored_and_repeated(spark):
    stored = spark.createDataFrame([review(7, 1, "old"), review(8, 1, None)], REVIEWS)
    batch = spark.createDataFrame(
        [review(0, 1, "old"), review(1, 2, "old"), review(2, 1, "new", 1), review(3, 1, "new", 2), review(4, 1, None)], REVIEWS
    )
    got = upsert.new_reviews(batch, stored, ["review_id"])
    assert as_set(got, "review_id", "branch_id", "text") == {(9, 1, "new"), (10, 2, "old")}


def test_assigned_ids_are_dense_and_ordered(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = upsert.assign_ids(rows, ["k"], "n", 10)
    assert got.filter("n <> k + 11").count() == 0 and got.count() == 5000


def test_branches_by_link_and_place(spark):
    stored = spark.createDataFrame(
        [(1, "A", None, "p1", None, None, None, "u1", at(0)), (2, "B", None, "55", None, None, None, "u2", None)], BRANCHES
    )
    batch = spark.createDataFrame(
        [("", "u1", at(5)), ("N", "u3", at(1)), ("", "u3", at(2)), ("", "u4", at(3))], "name string, url string, scraped_at timestamp"
    )
    got = upsert.upsert_branches_by_url(stored, batch, ["scraped_at"])
    assert as_set(got, "id", "name", "place_id", "url", "scraped_at") == {
        (1, "A", "p1", "u1", at(5)), (2, "B", "55", "u2", None), (3, "N", "u3", "u3", at(2)), (4, "u4", "u4", "u4", at(3)),
    }
    places = spark.createDataFrame(
        [("x", "h?cid=55", at(9)), ("y", "u1", at(8)), ("z", "h?cid=6", at(7)), ("w", "i?cid=6", at(7))],
        "name string, url string, scraped_at timestamp",
    )
    got = upsert.upsert_branches_by_place(stored, places, ["name"])
    assert as_set(got, "id", "name", "place_id", "scraped_at") == {
        (1, "A", "p1", at(8)), (2, "B", "55", at(9)), (3, "w", "6", at(7)),
    }


def test_branch_choice_with_missing_dates(spark):
    rows = spark.createDataFrame([(1, "n", None), (2, "n", at(1)), (3, "n", at(0))], "id int, name string, scraped_at timestamp")
    assert as_set(branch_choice(rows), "id") == {(3,)}
    assert as_set(branch_choice(rows, "newest"), "id") == {(1,)}


def test_nested_keeps_runs_without_topics(spark):
    meta = spark.createDataFrame([(i, 1, "b", at(i), 1, 1, "") for i in (1, 2, 3)], INSIGHTS_META)
    from decimal import Decimal

    rows = spark.createDataFrame([(i, 2, 9 - i, Decimal("1.50"), "k", "a", "s", "u", "r") for i in (1, 2)], INSIGHTS)
    got = {r.meta_id: [(t.topic_id, t.percentage) for t in r.topics] for r in nested_insights(rows, meta, 2).collect()}
    assert got == {3: [], 2: [(7, 1.5), (8, 1.5)]}


def test_status_reasons(spark):
    pages = spark.createDataFrame(
        [("a", "u1", "ok", 0), ("a", "u1", "recaptcha", 1), ("b", "u2", "recaptcha", 0), ("c", "u3", "ok", 0)],
        "name string, url string, html string, snapshot_no int",
    )
    found = spark.createDataFrame([("u3", 4, 2)], "url string, found long, new long")
    assert as_set(collection_status(pages, found), "url", "skipped", "reason", "found", "new", "errors") == {
        ("u1", True, "captcha_after_scroll", None, None, None), ("u2", True, "captcha", None, None, None),
        ("u3", False, None, 4, 2, 0),
    }


def test_topics_keep_their_contract(spark):
    words = ["pool water", "staff rude", "parking lot"]
    rows = [(1, i, f"{words[i % 3]} unique{i}") for i in range(20)] + [(1, 99, "nothing shared"), (2, 100, "pool"), (1, 101, None)]
    reviews = spark.createDataFrame(rows, "branch_id long, review_id long, normalized_text string")
    topics = assign_topics(reviews, TopicSettings(stop_words=()))
    assert topics.count() == len(rows)
    sizes = {r.topic: r["count"] for r in topics.filter("branch_id = 1").groupBy("topic").count().collect()}
    assert sizes.pop(-1) == 2 and set(sizes) == {0, 1, 2} and sizes[0] >= sizes[1] >= sizes[2] >= 5
    # nine reviews that say the same are one topic, and so is the smaller part of ten
    small = spark.createDataFrame(
        [(3, i, "pool") for i in range(9)] + [(4, i, "pool" if i < 6 else "sauna here") for i in range(11)],
        "branch_id long, review_id long, normalized_text string",
    )
    chosen = as_set(assign_topics(small, TopicSettings(stop_words=())), "branch_id", "topic")
    assert chosen == {(3, 0), (4, 0), (4, 1)}
    total = topic_shares(topics).filter("branch_id = 1").agg(F.sum("percentage")).first()[0]
    assert abs(float(total) - 100) <= 0.03


def test_language_of_unknown_and_short_texts(spark):
    known = spark.createDataFrame([("the gym is great", "en"), ("das ist sehr gut", "de")], "text string, lang string")
    texts = spark.createDataFrame([(1, "great gym"), (2, "ist gut"), (3, "ab"), (4, None), (5, "xyzxyz")], "k int, text string")
    model = fit_language(known)
    plan = detect_language(texts, model)
    got = as_set(plan, "k", "lang_guess")
    assert got >= {(1, "en"), (2, "de"), (3, None), (4, None)} and len(got) == 5
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_language_knows_every_run(spark):
    """More distinct runs than 2 ** 18, each seen once; a text of unknown runs has no language."""
    draw = random.Random(4)
    rare = "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(100_000))
    common = ["".join(chr(draw.randrange(0xAC00, 0xD7A3)) for _ in range(100_000)) for _ in range(2)]
    model = fit_language(spark.createDataFrame([(rare, "z"), *((t, "a") for t in common)], "text string, lang string"))
    texts = spark.createDataFrame([(rare[i : i + 3],) for i in range(0, 99_000, 500)], "text string")
    assert {r.lang_guess for r in detect_language(texts, model).collect()} == {"z"}
    assert detect_language(spark.createDataFrame([("xyzxyz",)], "text string"), model).first().lang_guess is None
    with pytest.raises(ValueError, match="more than 3 runs"):
        fit_language(spark.createDataFrame([("abcdef", "a"), ("ghi", "b")], "text string, lang string"), max_runs=3)


def test_branch_list_files(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text('[{"name":"A","url":"u1"},{"url":"u2"},{"name":"","url":"u3"},"u4",{"name":"B"},{"url":""},7,null]')
    got = read_branch_list(spark, str(path))
    assert as_set(got, "name", "url") == {("A", "u1"), ("u2", "u2"), ("u3", "u3"), ("u4", "u4")}
    write_branch_list(got, str(tmp_path / "lines"))
    assert as_set(read_branch_lines(spark, str(tmp_path / "lines")), "name", "url") == as_set(got, "name", "url")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_branch_list(spark, str(tmp_path / "missing.json"))


def test_csv_round_trip(spark, tmp_path):
    row = ("b", "u", "r1", "Ann", 5, 'two\nlines, "quoted"', "2025-10-01", "2 weeks ago", "2025-10-15 12:00:00")
    rows = spark.createDataFrame([row], REVIEW_CSV)
    path = str(tmp_path / "csv")
    write_reviews_csv(rows, path)
    write_reviews_csv(rows, path, append=True)
    assert [tuple(r) for r in read_reviews_csv(spark, path, REVIEW_CSV).collect()] == [row, row]


def test_store_versions_parts_and_failed_writes(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    assert store.read("reviews").count() == 0
    store.append("reviews", spark.createDataFrame([review(1, 1, "one")], REVIEWS), "a")
    store.append("reviews", spark.createDataFrame([review(2, 1, "two")], REVIEWS), "b")
    store.append("reviews", spark.createDataFrame([review(3, 1, "two again")], REVIEWS), "b")
    assert as_set(store.read("reviews"), "review_id") == {(1,), (3,)}
    assert as_set(store.read("reviews", without_part="b"), "review_id") == {(1,)}
    # a retry that breaks off leaves the part as it was
    torn = spark.createDataFrame([review(4, 1, "torn")], REVIEWS).withColumn("rating", F.raise_error(F.lit("torn")).cast("int"))
    with pytest.raises(Exception, match="torn"):
        store.append("reviews", torn, "b")
    assert as_set(store.read("reviews"), "review_id") == {(1,), (3,)}
    store.replace("reviews", store.read("reviews").filter("review_id = 1"))
    assert as_set(store.read("reviews"), "review_id") == {(1,)}
    broken = store.read("reviews").withColumn("rating", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        store.replace("reviews", broken)
    assert as_set(store.read("reviews"), "review_id") == {(1,)}
    store.reset()
    assert store.read("reviews").count() == 0
    store.reset()
    assert len(list((tmp_path / "store" / "reviews").iterdir())) <= 3


def test_landing_a_stream_twice_changes_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        rows = [review(i, i % 2, f"text {i // 2}", k) for i in range(k * 4, k * 4 + 8)]
        spark.createDataFrame(rows, REVIEWS).coalesce(1).write.mode("append").parquet(source)
    store = ReviewStore(spark, str(tmp_path / "store"))
    stream = lambda: spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", 1).parquet(source)
    handler = land_reviews(store, str(tmp_path / "counts"), ["review_id"])
    each_batch(stream(), handler, str(tmp_path / "progress")).awaitTermination()
    landed = as_set(store.read("reviews"), "branch_id", "text")
    assert landed == {(i % 2, f"text {i // 2}") for i in range(16)} and store.read("reviews").count() == len(landed)
    counts = spark.read.parquet(str(tmp_path / "counts") + "/*")
    assert counts.agg(F.sum("found"), F.sum("new")).first()[:] == (24, 16)
    # a batch that runs again finds its own rows replaced, not doubled
    last = spark.createDataFrame([review(50, 0, "text 0"), review(51, 0, "later")], REVIEWS)
    handler(last, 7)
    handler(last, 7)
    assert store.read("reviews").count() == len(landed) + 1
    nameless = spark.createDataFrame([review(None, 0, "no id")], REVIEWS)
    once = upsert.upsert(nameless, nameless, ["review_id"], ["scraped_at"])
    assert once.count() == 1
    merge = upsert_each_batch(store, "reviews", ["review_id"], ["scraped_at"])
    merge(store.read("reviews").limit(3), 0)
    assert store.read("reviews").count() == len(landed) + 1


def page_html(topic, count):
    block = '<div data-review-id="{i}"><div class="MyEned">The {t} here is note{i} {t} indeed</div></div>'
    return "".join(block.format(i=i, t=topic) for i in range(count))


def test_whole_run(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    branches = spark.createDataFrame([("One", "u1"), ("Two", "u2"), ("Three", "u3"), ("Four", "u4")], "name string, url string")
    html = page_html("swimming", 7) + page_html("parking", 6)
    pages = spark.createDataFrame(
        [(1, "u1", html, 0, T0), (2, "u2", "recaptcha", 0, T0), (3, "u3", page_html("swimming", 2), 0, T0),
         (4, "u1", html, 1, at(5)), (5, "u4", page_html("sauna", 3), 0, T0), (6, "u4", "recaptcha", 1, at(1)),
         (7, "u3", "<![foo[x]]>", 1, at(1))], PAGES
    )
    memory = spark.createDataFrame([], "text string, translated string")
    options = RunOptions(topics=TopicSettings(stop_words=("the", "here", "is", "indeed"), max_share=0.8))

    def answer(requests):
        reply = F.lit('{"aspect":"a","sentiment":"positive","summary":"s","recommendation":"r"}')
        return requests.select("branch_id", F.col("topic").alias("topic_id"), reply.alias("reply"), F.lit(None).cast("string").alias("error"))

    def compute(name="one"):
        return run(store, branches, pages, memory, answer, name, options)

    assert stored_insights(store)[0] == "aggregated_reviews"
    # snapshots accumulate without doubling; a branch blocked at any of them is neither stored nor dated
    assert as_set(compute(), "name", "reason", "found", "new", "errors") == {
        ("One", None, 13, 13, 0), ("Two", "captcha", None, None, None), ("Three", None, 2, 2, 1),
        ("Four", "captcha_after_scroll", None, None, None),
    }
    assert as_set(store.read("branches"), "name") == {("One",), ("Three",)}
    assert spark.read.parquet(store.rejected_folder("reviews", "run-one")).count() == 0
    kind, nested = insights_or_run(store, compute)
    rows = nested.collect()
    assert kind == "insights_table" and [r.branch_name for r in rows] == ["One"]
    assert [t.topic_id for t in rows[0].topics] == [0, 1] and {t.aspect for t in rows[0].topics} == {"a"}
    assert [t.percentage for t in rows[0].topics] == [53.85, 46.15]
    before = {t: store.read(t).count() for t in ("branches", "reviews", "normalized_reviews", "insights_meta", "insights")}
    assert before == {"branches": 2, "reviews": 15, "normalized_reviews": 15, "insights_meta": 1, "insights": 2}
    compute("one")
    assert {t: store.read(t).count() for t in before} == before
    compute("two")
    assert store.read("insights_meta").count() == 2 and store.read("reviews").count() == 15


def test_search_flow_and_fallback_normalising(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    store.ensure()
    html = "<title>Spa</title>" + "".join(f'<div aria-label="Rated {i} stars">A TEXT  of place {i}</div>' for i in range(3))
    pages = spark.createDataFrame([(1, "h?cid=7", html, 0, T0), (2, "i?cid=7", html, 1, at(1))], PAGES)
    stages.collect_places(store, pages, "one")
    stages.collect_places(store, pages, "one")
    assert as_set(store.read("branches"), "name", "place_id") == {("Spa", "7")}
    assert store.read("reviews").count() == 3
    stages.normalise(store, spark.createDataFrame([], "text string, translated string"), simple=True)
    assert as_set(store.read("normalized_reviews"), "normalized_text") == {(f"a text of place {i}",) for i in range(3)}


def test_normalising_by_language_model(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    store.append("reviews", spark.createDataFrame([review(1, 1, "das ist gut"), review(2, 1, "it is good")], REVIEWS), "a")
    model = fit_language(spark.createDataFrame([("das ist sehr gut", "de"), ("it is very good", "en")], "text string, lang string"))
    memory = spark.createDataFrame([("das ist gut", "that is good"), ("it is good", "wrong")], "text string, translated string")
    stages.normalise(store, memory, model=model, foreign=("de",))
    assert as_set(store.read("normalized_reviews"), "normalized_text") == {("that is good",), ("it is good",)}


def test_scratch_folder_without_a_preset(tmp_path):
    """A local session without any default gets a folder of its own; a cluster must name one."""
    code = (
        "from reviewloom.session import build_session, cut, land, scratch_root\n"
        "s = build_session('t', 'local[1]', spark__ui__enabled='false')\n"
        "assert cut(s.range(3)).count() == 3 and land(s.range(3), 'x').count() == 3\n"
        "assert scratch_root(s)\n"
    )
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=120)


def test_stop_words_from_a_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("The\n\n and \n")
    assert read_stop_words(spark, str(tmp_path / "words.txt")) == ("and", "the")


def test_texts_are_taken_apart_in_one_job(spark):
    rows = spark.createDataFrame([(1, i, "pool water") for i in range(9)], "branch_id long, review_id long, normalized_text string")
    plan = assign_topics(rows, TopicSettings())._jdf.queryExecution().executedPlan().toString()
    assert "split(lower(" not in plan and "term-counts" in plan


def _worded(spark):
    rows = [(i % 3, i, " ".join(f"w{(i * k * k + k) % 41}" for k in range(1, 30 + i % 7))) for i in range(90)] + [(None, 200, "w1 w2"), (1, None, "w1 w3")]
    return spark.createDataFrame(rows, "branch_id long, review_id long, normalized_text string")


def test_first_choices_of_more_candidates_than_are_sent(spark, monkeypatch):
    def chosen():
        return as_set(assign_topics(_worded(spark), TopicSettings(stop_words=())), "branch_id", "review_id", "topic", "anchor")

    every = chosen()
    joined = []
    monkeypatch.setattr(topics, "BROADCAST_ROW_LIMIT", 40)
    choice = topics._first_choice
    monkeypatch.setattr(topics, "_first_choice", lambda counted, candidates: joined.append(1) or choice(counted, candidates, 40))
    assert chosen() == every and joined and len({row[3] for row in every}) > 3


def test_terms_are_counted_where_their_texts_are(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(terms, "land", lambda df, *_: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    terms.term_counts(_worded(spark), "normalized_text", ())
    assert "hashpartitioning" not in plans[0] and "rangepartitioning" in plans[0]


@pytest.mark.parametrize("most", [8, 1, 10**9])
def test_top_terms_with_and_without_bounds(spark, monkeypatch, most):
    named = _worded(spark).withColumn("topic", (F.col("review_id") % 4).cast("int"))
    monkeypatch.setattr(terms, "MOST_FREQUENT", most)
    found = terms.topic_terms(named, top=5).orderBy("branch_id", "topic", "rank")
    counts = {}
    for r in named.collect():
        words = r.normalized_text.split()
        for term in words + [f"{x} {y}" for x, y in zip(words, words[1:])]:
            of = counts.setdefault(r.branch_id, {}).setdefault(r.topic, {})
            of[term] = of.get(term, 0) + 1
    expected = []
    for branch in range(3):
        mean = sum(sum(c.values()) for c in counts[branch].values()) // len(counts[branch])
        for topic in range(4):
            own = counts[branch][topic]
            weight = {t: n / sum(own.values()) * math.log(1 + mean / sum(c.get(t, 0) for c in counts[branch].values())) for t, n in own.items()}
            first = sorted(weight, key=lambda t: (-round(weight[t], 12), t))[:5]
            expected += [(branch, topic, k, t, own[t]) for k, t in enumerate(first, 1)]
    assert [(r.branch_id, r.topic, r["rank"], r.term, r.tf) for r in found.collect()] == expected


def test_topics_of_counts_in_many_small_shards(spark, monkeypatch):
    """A shard writes a row per review and per bucket, not one per review and term, and how reviews fall into shards changes nothing."""
    rows = _worded(spark).unionByName(_worded(spark).filter("review_id < 6"))
    named = rows.withColumn("topic", (F.col("review_id") % 4).cast("int"))
    settings = TopicSettings(stop_words=())
    columns = ("branch_id", "review_id", "topic", "anchor")
    whole = as_set(assign_topics(rows, settings), *columns)
    once = named.dropDuplicates(["branch_id", "review_id"])
    top = as_set(terms.topic_terms(named, top=5), "branch_id", "topic", "rank", "term", "tf")
    monkeypatch.setattr(bags, "SHARD_WORDS", 100)
    monkeypatch.setattr(bags, "BUCKET_CHARACTERS", 1000)
    counted = terms.term_counts(rows, "normalized_text", (), 2)
    assert counted.filter("bucket IS NULL").count() == 92 and counted.filter("bucket IS NULL").select("shard").distinct().count() > 20
    assert counted.select("bucket").distinct().count() > 5
    assert as_set(assign_topics(rows, settings, counted=counted), *columns) == whole
    assert as_set(terms.topic_terms(once, top=5, counted=counted), "branch_id", "topic", "rank", "term", "tf") == top


@pytest.mark.parametrize("longest", [0, 3, 10**12])
def test_packed_numbers_and_strings_come_back(longest):
    draw = random.Random(longest)
    lists = [sorted(draw.randrange(longest + 1) for _ in range(n)) for n in (0, 3, 0, 40, 1, 0)]
    begins = np.cumsum([0, *map(len, lists)])
    values = np.array([x for some in lists for x in some], np.int64)
    for rising in (False, True):
        back, ends = bags.unpacked(bags.packed(values, begins, rising), rising)
        assert back.tolist() == values.tolist() and ends.tolist() == begins.tolist()
    words = pa.array([f"é{x}" for x in values.tolist()], pa.string())
    texts, ends = bags.unzipped(bags.zipped(words, begins))
    assert texts.to_pylist() == words.to_pylist() and ends.tolist() == begins.tolist()


def test_pages_are_made_once_in_a_collection(spark, tmp_path):
    html = '<div data-review-id="1"><div class="MyEned">long enough a text</div></div>'
    pages = spark.createDataFrame([(1, "u1", html, 0, T0), (2, "u2", "recaptcha", 0, T0)], PAGES)
    status = stages.collect(ReviewStore(spark, str(tmp_path)), spark.createDataFrame([("a", "u1"), ("b", "u2")], "name string, url string"), pages, RunOptions(), "one")
    assert "ExistingRDD" not in status._jdf.queryExecution().executedPlan().toString()
    assert as_set(status, "url", "skipped", "found", "new") == {("u1", False, 1, 1), ("u2", True, None, None)}
