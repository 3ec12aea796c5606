"""Bucket tables, digests, sketches, counters, documents, stateful rounds, the snapshot source and topics by likeness."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from reviewloom.functions import variants
from reviewloom.operators import changes, kmeans, language, metrics, similarity, sketches, upsert
from reviewloom.operators.bags import packed
from reviewloom.operators.dedupe import not_seen
from reviewloom.plans import stages
from reviewloom.schemas import PAGES, REVIEWS
from reviewloom.sinks import buckets
from reviewloom.sinks.buckets import BucketTable
from reviewloom.sinks.files import export_insights_csv
from reviewloom.sinks.store import ReviewStore
from reviewloom.sources import block_function, snapshots
from reviewloom.streaming import rounds
from reviewloom.streaming.snapshots import each_batch
from test_tables import T0, as_set, at, review


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


# tables by bucket


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    store = BucketTable(spark, str(tmp_path / "t"), REVIEWS, 16, "text")
    store.upsert(spark.createDataFrame([review(i, i % 40, f"text {i}") for i in range(400)], REVIEWS), ["review_id"], ["scraped_at"])
    before = files(tmp_path / "t")
    batch = spark.createDataFrame([review(3, 3, "other", 1), review(900, 3, "more", 1)], REVIEWS)
    touched = store.touched(store.shaped(batch))
    assert len(touched) == 1
    plan = store.stored(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"IN ({touched[0]})" in plan.replace("#", "") or f"= {touched[0]})" in plan
    assert store.upsert(batch, ["review_id"], ["scraped_at"]) == touched
    after = files(tmp_path / "t")
    kept = {f for f in before if f"bucket={touched[0]}/" not in f}
    assert all(after.get(f) == before[f] for f in kept) and len(kept) < len(before)
    assert store.read().count() == 401 and as_set(store.read().filter("review_id = 3"), "text") == {("other",)}
    # no stored text is hashed again
    scan = upsert.absent_reviews(batch, store.stored(touched), ["review_id"])._jdf.queryExecution().executedPlan().toString()
    (read,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", scan))
    assert "text_key:" in read and "text:" not in read


def test_bucket_delete(spark, tmp_path):
    store = BucketTable(spark, str(tmp_path / "t"), REVIEWS, 4, "text")
    store.insert_absent(spark.createDataFrame([review(i, i % 3, f"text {i}") for i in range(30)] + [review(99, None, None)], REVIEWS), ["review_id"])
    store.delete(spark.createDataFrame([(1,), (2,), (None,)], "branch_id long"))
    assert as_set(store.read(), "branch_id") == {(0,)} and store.read().count() == 10


def test_null_keys_are_keys(spark):
    stored = spark.createDataFrame([review(7, None, "old"), review(8, 1, None)], REVIEWS)
    batch = spark.createDataFrame([review(1, None, "old"), review(2, 1, None), review(3, None, None), review(4, None, None)], REVIEWS)
    once = upsert.new_reviews(batch, stored, ["review_id"])
    assert as_set(once, "branch_id", "text") == {(None, None)} and once.count() == 1
    assert upsert.new_reviews(batch, stored.unionByName(once), ["review_id"]).count() == 0
    assert not_seen(batch, stored, ["branch_id", "text"]).count() == 2


# changes


def test_digests_see_every_change_and_no_order(spark):
    rows = [(1, "a", 1), (1, "a", 1), (1, None, 2), (2, "x", None), (None, "n", 0)]
    schema = "branch_id long, text string, n int"

    def changed(other):
        now, then = (changes.branch_digests(spark.createDataFrame(r, schema)) for r in (other, rows))
        return as_set(changes.changed_branches(now, then), "branch_id", "change")

    assert changed(list(reversed(rows))) == set()
    assert changed(rows + rows[:2]) == {(1, "changed")}
    assert changed([(1, "a", 1), (1, "a", 1), (1, "", 2), *rows[3:]]) == {(1, "changed")}
    assert changed([(1, "a", 1), (1, "a", 1), (1, "2", None), *rows[3:]]) == {(1, "changed")}
    assert changed(rows[:4]) == {(None, "gone")} and changed([*rows, (5, "q", 1)]) == {(5, "new")}


def test_second_run_has_no_work(spark, tmp_path):
    state = changes.StageDigests(spark, str(tmp_path / "d"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "branch_id long, text string")
    given = []
    work = lambda moved, gone: given.append((as_set(moved, "branch_id"), as_set(gone, "branch_id")))
    for df in (rows, rows, rows.filter("branch_id = 1").unionByName(rows.filter("branch_id = 1"))):
        state.run("s", df, work)
    assert given == [({(1,), (2,)}, set()), ({(1,)}, {(2,)})]

    def fails(moved, gone):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        state.run("s", rows, fails)
    state.run("s", rows, work)
    assert given[-1] == ({(1,), (2,)}, set())


def test_only_changed_branches_are_normalised(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    store.append("reviews", spark.createDataFrame([review(1, 1, "A  b"), review(2, 2, "C")], REVIEWS), "a")
    state = changes.StageDigests(spark, str(tmp_path / "d"))
    memory = spark.createDataFrame([], "text string, translated string")
    run = lambda: as_set(stages.normalise(store, memory, simple=True, digests=state), "branch_id", "change")
    assert run() == {(1, "new"), (2, "new")} and run() == set()
    version = store._parts("normalized_reviews")[0][0]
    assert run() == set() and store._parts("normalized_reviews")[0][0] == version
    store.append("reviews", spark.createDataFrame([review(3, 2, "D")], REVIEWS), "b")
    assert run() == {(2, "changed")}
    assert as_set(store.read("normalized_reviews"), "review_id", "normalized_text") == {(1, "a b"), (2, "c"), (3, "d")}


# sketches, counters, documents


def test_sketches_stay_within_the_bound(spark):
    seen = spark.range(60_000).select((F.col("id") % 3).alias("branch_id"), (F.col("id") % 7).alias("round"), (F.col("id") % 20_000).cast("string").alias("id"))
    kept = sketches.id_sketches(seen, ["branch_id", "round"], "id")
    for row in sketches.distinct_estimates(kept, ["branch_id"]).collect():
        exact = len({k % 20_000 for k in range(60_000) if k % 3 == row.branch_id})
        assert abs(row.ids - exact) <= sketches.error_bound() * exact and row.sightings == 20_000


def test_counters_beside_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("plain",), ("ñ",), (None,), ("two words",)], "text string")
    rows.write.parquet(str(tmp_path / "in"))
    seen = Observation("batch")
    assert metrics.observed_cleaning(rows, seen).count() == 2
    assert seen.get == {"found": 4, "kept": 2, "skipped": 2}
    listener = metrics.MetricsListener()
    spark.streams.addListener(listener)
    try:
        stream = metrics.observed_cleaning(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), "cleaning")
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if listener.totals["cleaning"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert dict(listener.totals["cleaning"]) == {"found": 4, "kept": 2, "skipped": 2}


def test_variant_fields(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a":{"b":2},"n":null}'), (2, '{"a":{"b":"2"}}'), (3, "no json"), (4, None)], "k int, text string")
    rows.select("k", variants.as_variant(F.col("text")).alias("parameters")).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    assert as_set(stored.select("k", variants.field_state(F.col("parameters"), "$.n").alias("s")), "k", "s") == {
        (1, "null"), (2, "missing"), (3, "no document"), (4, "no document")
    }
    assert as_set(variants.with_parameter(stored, "$.a.b", "int", 2), "k") == {(1,), (2,)}


# exports


def test_export_is_clustered(spark, tmp_path):
    insights = spark.range(6000).select(
        (F.col("id") % 300).alias("meta_id"), F.col("id").cast("int").alias("topic_id"), F.lit(1.5).cast("decimal(5,2)").alias("percentage"),
        *(F.lit("x").alias(c) for c in ("top_keywords", "gemini_aspect", "gemini_sentiment", "gemini_summary", "gemini_recommendation")),
    )
    meta = spark.range(300).select(F.col("id").alias("meta_id"), (F.col("id") % 250).alias("branch_id"))
    export_insights_csv(insights, meta, str(tmp_path / "all"))
    written = list((tmp_path / "all").rglob("*.csv"))
    assert 0 < len(written) <= 8 and spark.read.option("header", True).csv(str(tmp_path / "all")).count() == 6000
    export_insights_csv(insights, meta, str(tmp_path / "one"), branch_id=3)
    assert {r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "one")).select("branch_id").collect()} == {"3"}


# rounds with state, snapshots by offset


def test_state_forgets_after_its_time(spark, tmp_path):
    def arrive(number):
        rows = spark.createDataFrame([(1, f"r{i}", number) for i in range(5)], "branch_id long, id string, round long")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return rows.schema

    def counts():
        # the sink names its files when a batch is complete
        if not list((tmp_path / "out").glob("_spark_metadata/[0-9]*")):
            return {}
        return {r.round: r.new_ids for r in rounds.rounds_of_parts(spark.read.parquet(str(tmp_path / "out"))).collect()}

    def until(test):
        end = time.time() + 40
        while not test() and time.time() < end:
            time.sleep(0.5)
        return test()

    stream = spark.readStream.schema(arrive(0)).parquet(str(tmp_path / "in"))
    # with an expiry the stream goes on by itself, to clear its state; it is stopped, not awaited
    query = (
        rounds.new_ids_by_round(stream, ttl_ms=3_000, parts=2).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="1 second").start()
    )
    state = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    try:
        assert until(lambda: counts() == {0: 5})
        assert until(lambda: state() and state()[-1] < max(state()))
        arrive(1)
        # forgotten by now, so the ids count as new again
        assert until(lambda: counts() == {0: 5, 1: 5})
    finally:
        query.stop()


def test_snapshots_arrive_by_offset(spark, tmp_path):
    snapshots.register(spark)
    path = str(tmp_path / "pages")
    page = lambda n: spark.createDataFrame([(n, f"u{n}", "<p>x</p>", n, T0)], PAGES)
    got = []

    def batch(df, batch_id):
        got.append(sorted(r.page_id for r in df.collect()))

    def run():
        each_batch(spark.readStream.format(snapshots.NAME).load(path), batch, str(tmp_path / "progress")).awaitTermination()
        return [x for x in got if x]

    snapshots.write_snapshot(page(0), path, 0)
    (tmp_path / "pages" / "snapshot=1").mkdir()
    assert run() == [[0]]
    snapshots.write_snapshot(page(1), path, 1)
    snapshots.write_snapshot(page(2), path, 2)
    assert [k for x in run() for k in x] == [0, 1, 2] and [k for x in run() for k in x] == [0, 1, 2]
    assert spark.read.format(snapshots.NAME).load(path).count() == 3
    assert as_set(spark.read.format(snapshots.NAME).option("snapshot", 1).load(path), "page_id") == {(1,)}
    assert spark.read.format(snapshots.NAME).load(str(tmp_path / "none")).count() == 0


# search flow


def test_search_flow_sets_aside_and_reports(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    store.ensure()
    block = lambda who, text: f'<span role="link">{who}</span><div aria-label="Rated 4 stars">{text}</div>'
    good = "<title>Spa</title>" + block("ann", "a fine place") + block("b" * 300, "too wide a name")
    pages = spark.createDataFrame(
        [(1, "h?cid=7", good, 0, T0), (2, "i?cid=8", "<title>Blocked</title>unusual traffic", 0, at(1)), (3, "j?cid=9", "<title>Bare</title>", 0, at(2))], PAGES
    )
    status = {r.url: (r.skipped, r.reason, r.found, r.new, r.errors) for r in stages.collect_places(store, pages, "one").collect()}
    assert status == {
        "h?cid=7": (False, None, 2, 1, 0), "i?cid=8": (True, "captcha", None, None, None), "j?cid=9": (False, None, 0, 0, 0)
    }
    assert as_set(store.read("branches"), "name") == {("Spa",), ("Bare",)} and as_set(store.read("reviews"), "author") == {("ann",)}
    assert spark.read.parquet(store.rejected_folder("reviews", "run-one")).count() == 1
    again = {r.url: r.new for r in stages.collect_places(store, pages, "two").collect()}
    assert again == {"h?cid=7": 0, "i?cid=8": None, "j?cid=9": 0}


def test_block_function_on_odd_pages(spark):
    block_function.register(spark)
    pages = spark.createDataFrame([(1, None), (2, ""), (3, '<div data-review-id="a">x<div data-review-id="b">y'), (4, "<div data-review-id")], "k int, html string")
    pages.createOrReplaceTempView("odd_pages")
    assert as_set(spark.sql("SELECT k, block_no, author FROM odd_pages, LATERAL review_blocks(html)"), "k", "block_no") == {(3, 0), (3, 1)}
    assert as_set(spark.sql("SELECT k, given_id, text FROM odd_pages, LATERAL review_blocks_v2(html)"), "given_id", "text") == {("a", "x"), ("b", "y")}


# topics by likeness


def test_components_of_long_and_wide_graphs(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(draw.randrange(2000, 2200), draw.randrange(2000, 2200)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    lonely = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    expected = {x: find(x) for x in root if x not in lonely}
    got = {r.node: r.label for r in similarity.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected
    assert similarity.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_with_split_lists(spark, monkeypatch):
    """Short lists only per task: all pairs at or above the threshold, each once, against plain Python."""
    monkeypatch.setattr(similarity, "LIST_ROWS", 4)
    draw = random.Random(8)
    texts = {i: " ".join(draw.choices([f"w{k}" for k in range(30)], k=draw.randrange(3, 12))) for i in range(60)}
    settings = similarity.SimilaritySettings(min_topic_size=2, similarity=0.4, stop_words=())
    rows = spark.createDataFrame([(1, i, t) for i, t in texts.items()], "branch_id long, review_id long, normalized_text string")
    found = {(r.a, r.b): r.cosine for r in similarity.similar_pairs(similarity.review_vectors(rows, settings), 0.4).collect()}
    df, vectors = Counter(), {}
    for t in texts.values():
        df.update(set(t.split()))
    for i, t in texts.items():
        raw = {w: (1 + math.log(n)) * math.log(1 + len(texts) / df[w]) for w, n in Counter(t.split()).items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        vectors[i] = {w: x / length for w, x in raw.items()}
    expected = {}
    for a in texts:
        for b in range(a + 1, 60):
            cosine = sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items())
            if cosine >= 0.4:
                expected[a, b] = cosine
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in found)


def test_similar_pairs_write_no_candidates(spark, monkeypatch):
    """What is written on the way to the pairs has at most a row per review or term, however many reviews share terms."""
    written = {}
    real = similarity.land

    def counting(df, label, *more):
        out = real(df, label, *more)
        written[label] = out.count()
        return out

    monkeypatch.setattr(similarity, "land", counting)
    draw = random.Random(8)
    rows = [(1, i, " ".join(draw.choices([f"w{k}" for k in range(30)], k=draw.randrange(3, 12)))) for i in range(60)]
    settings = similarity.SimilaritySettings(min_topic_size=2, similarity=0.4, stop_words=())
    df = spark.createDataFrame([*rows, (2, 100, "alone"), (2, 101, "?")], "branch_id long, review_id long, normalized_text string")
    assert similarity.similar_pairs(similarity.review_vectors(df, settings), 0.4).count() > 60
    assert max(written.values()) <= 62


def test_vectors_to_be_copied_are_small(spark):
    """A term of a vector takes some bytes, not two numbers of eight; the weights follow from them."""
    draw = random.Random(5)
    rows = [(1, i, " ".join(draw.choices([f"w{k}" for k in range(200)], k=100))) for i in range(300)]
    settings = similarity.SimilaritySettings(similarity=0.4, stop_words=())
    vectors = similarity.review_vectors(spark.createDataFrame(rows, "branch_id long, review_id long, normalized_text string"), settings)
    held, size = vectors.selectExpr("sum(held)", "sum(length(terms) + length(tfs) + length(dfs))").first()
    assert held > 20_000 and size < 8 * held


@pytest.mark.parametrize("frequent, parts", [(28, False), (1, True), (10**9, True), (4, False)])
def test_near_reviews_block_by_block(monkeypatch, frequent, parts):
    """Terms as columns of a matrix or as lists, small blocks and strips: the same pairs as plain Python, each once."""
    for name, value in (("FREQUENT", frequent), ("BLOCK_ROWS", 16), ("STRIP", 50), ("PAIRS", 3)):
        monkeypatch.setattr(similarity, name, value)
    draw = random.Random(9)
    bags, df = [Counter(draw.choices(range(40), k=draw.randrange(1, 15))) for _ in range(70)], Counter()
    for bag in bags:
        df.update(bag.keys())
    raw = [{t: (1 + math.log(n)) * math.log(1 + 70 / df[t]) for t, n in bag.items()} for bag in bags]
    length = [math.sqrt(sum(w * w for w in r.values())) for r in raw]
    begins = np.cumsum([0, *map(len, bags)])
    lists = [[sorted(bag) for bag in bags], [[bag[t] for t in sorted(bag)] for bag in bags], [[df[t] for t in sorted(bag)] for bag in bags]]
    terms, tfs, dfs = (packed(np.array([x for some in of for x in some]), begins, rising=k == 0) for k, of in enumerate(lists))
    rows = pa.table({"terms": terms, "tfs": tfs, "dfs": dfs, "n": [70] * 70, "length": length})
    cut = 30 if parts else 0
    near = similarity._near(rows.slice(0, cut), rows.slice(cut), 0.3) if parts else similarity._near(rows, None, 0.3)
    found = [(int(a), int(b) + cut, float(c)) for x, y, cosines in near for a, b, c in zip(x, y, cosines)]
    cosine = lambda a, b: sum(w * raw[b].get(t, 0) for t, w in raw[a].items()) / length[a] / length[b]
    expected = {(a, b): c for a in range(cut or 70) for b in range(max(a + 1, cut), 70) if (c := cosine(a, b)) >= 0.3}
    assert len(expected) > 50 and len(found) == len(expected)
    assert all(expected[a, b] == pytest.approx(c, abs=1e-12) for a, b, c in found)


def test_kmeans_equals_plain_lloyd(spark):
    """Every branch's leaves equal those of the same steps in plain Python."""
    draw = random.Random(4)
    words = [[f"{x}{k}" for k in range(12)] for x in "abcd"]
    rows, n = [], 0
    for branch in (1, 2, 3):
        for _ in range(30):
            rows.append((branch, n, " ".join(draw.choices(words[draw.randrange(branch + 1)], k=8))))
            n += 1
    rows.append((2, n, "  ")), rows.append((None, n + 1, "a1 a2"))
    settings = kmeans.KMeansSettings(min_topic_size=4, topics=3, width=16, steps=6, stop_words=())
    df = spark.createDataFrame(rows, "branch_id long, review_id long, normalized_text string")
    vectors = kmeans.hashed_vectors(df, settings)
    points = defaultdict(dict)
    for r in vectors.collect():
        points[r.branch_id, r.review_id][r.dim] = r.x
    got = {(r.branch_id, r.review_id): r.cluster for r in kmeans.bisect(vectors, settings).collect()}

    def half_up(a, n):
        return (2 * a + n) // (2 * n)

    def mean(ids):
        sums = Counter()
        for i in ids:
            sums.update(points[i])
        return {d: half_up(x, len(ids)) for d, x in sums.items()}

    def far(i, centre):
        return sum(x * x for x in points[i].values()) - 2 * sum(x * centre.get(d, 0) for d, x in points[i].items()) + sum(c * c for c in centre.values())

    def split(ids):
        first = max(ids, key=lambda i: (far(i, mean(ids)), -i[1]))
        second = max(ids, key=lambda i: (far(i, points[first]), -i[1]))
        centres = [points[first], points[second]]
        sides = {i: min((0, 1), key=lambda s: (far(i, centres[s]), s)) for i in ids}
        for _ in range(settings.steps):
            centres = [mean([i for i in ids if sides[i] == s]) if any(sides[i] == s for i in ids) else None for s in (0, 1)]
            after = {i: min((s for s in (0, 1) if centres[s] is not None), key=lambda s: (far(i, centres[s]), s)) for i in ids}
            if after == sides:
                break
            sides = after
        return sides

    for branch in (1, 2, 3):
        leaves = {"r": [i for i in points if i[0] == branch]}
        closed = set()
        while True:
            spread = {k: round(sum(far(i, mean(v)) / kmeans.ONE for i in v)) for k, v in leaves.items()}
            wanted = sorted((k for k in leaves if len(leaves[k]) >= 8 and k not in closed), key=lambda k: (-spread[k], k))
            chosen = wanted[: max(0, settings.topics - len(leaves))]
            if not chosen:
                break
            for k in chosen:
                sides = split(leaves[k])
                parts = [[i for i in leaves[k] if sides[i] == s] for s in (0, 1)]
                if min(map(len, parts)) < settings.min_topic_size:
                    closed.add(k)
                    continue
                del leaves[k]
                leaves[f"{k}0"], leaves[f"{k}1"] = parts
        assert {i: k for k, v in leaves.items() for i in v} == {i: c for i, c in got.items() if i[0] == branch}
    topics = {r.review_id: r.topic for r in kmeans.kmeans_topics(df, settings).collect()}
    assert topics[n] == topics[n + 1] == -1 and len(topics) == len(rows)


def test_kmeans_steps_write_no_reviews(spark, monkeypatch):
    """A split's steps write rows per cluster; reviews are written once a round, with their clusters."""
    written = defaultdict(list)
    real = kmeans.land

    def counting(df, label, *more):
        out = real(df, label, *more)
        written[label].append(out.count())
        return out

    monkeypatch.setattr(kmeans, "land", counting)
    rows = [(1, i, " ".join(f"{'ab'[i % 2]}{(i * k) % 9}" for k in range(1, 5))) for i in range(40)] + [(1, None, "a1 a2"), (2, 50, "a1")]
    settings = kmeans.KMeansSettings(min_topic_size=4, topics=2, width=16, steps=4, stop_words=())
    df = spark.createDataFrame(rows, "branch_id long, review_id long, normalized_text string")
    got = {r.review_id: r.topic for r in kmeans.kmeans_topics(df, settings).collect()}
    assert got[None] == got[50] == -1 and {got[i] for i in range(40)} == {0, 1}
    reviews = written.pop("kmeans-vectors")
    assert len(reviews) <= 2 and max(n for ns in written.values() for n in ns) <= 4


def test_large_language_models_stay_a_table(spark, monkeypatch):
    """Scoring by a join gives the languages of the map step."""
    known = spark.createDataFrame([("the gym is great and the staff too", "en"), ("das ist sehr gut und die leute auch", "de"), ("x", "fr")], "text string, lang string")
    texts = spark.createDataFrame([(1, "great gym"), (2, "ist gut"), (3, "ab"), (4, None), (5, "xyzxyz"), (6, "the"), (6, "the")], "k int, text string")
    small = language.fit_language(known)
    monkeypatch.setattr(language, "MODEL_CELLS", 5)
    large = language.fit_language(known)
    assert small.runs is not None and large.runs is None
    one, two = (sorted(map(tuple, language.detect_language(texts, m).collect()), key=str) for m in (small, large))
    assert one == two and (1, "great gym", "en") in one and (5, "xyzxyz", None) in one


def test_stored_rows_go_before_the_choice_among_new_ones(spark, tmp_path, monkeypatch):
    plans = {}
    real = buckets.land
    monkeypatch.setattr(buckets, "land", lambda df, label, *a: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or real(df, label, *a))
    rows = spark.createDataFrame([(None, "x", 1), (1, "x", 2), (1, "x", 3), (1, None, 4)], "branch_id long, text string, review_id long")
    table = buckets.BucketTable(spark, str(tmp_path / "t"), rows.schema, 4, "text")
    assert sorted(r.review_id for r in table.insert_absent(rows.filter("review_id < 3"), ["review_id"]).collect()) == [1, 2]
    assert [r.review_id for r in table.insert_absent(rows, ["review_id"]).collect()] == [4]
    plan = plans["bucket-added"]
    assert plan.index("Window") < plan.index("LeftAnti")
