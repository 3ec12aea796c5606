"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewloom.llm import (
    conversation_trie, filter_audit, imatch, langid, license_scan, line_dedup, mixing, pieces, quality, simhash, substrings, tokens, warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASHING = ", ".join(f"{c} string" for c in (
    "id", "fp", "carry", "key", "size", "bucket", "place", "term", "mask", "n_lines", "of", "line", "_units", "section",
    "begin", "ids", "decoded", "kept", "lang_pred", "score", "copies", "salt", "draw", "record_id", "block", "edit", "edited_sha256",
))
LONG = " ".join(f"word{i % 977}x{i % 89}" for i in range(60_000)) + " " + "y" * 50_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t\n ", "en", "a", 6),
    (4, "One two three four five six seven eight nine ten. Released under the MIT License.", "en", "a", 80),
    (4, "One two three four five six seven eight nine ten. Released under the MIT License.", "en", "a", 80),
    (5, "One two three four five six seven eight nine ten. Released under the MIT License.", "fr", "b", 80),
    (None, "no identifier at all, ÄÖ ñ 漢字 \x00 😀", "de", "b", 30),
    (None, None, "de", "b", None),
    (6, LONG, "en", "a", len(LONG)),
    (7, "!!! 123 ???", None, None, 11),
    (8, "The QUICK brown fox\nThe quick BROWN fox\n\nend", "en", "c", 40),
]
ID, EMPTY = "doc_id", hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("?",) * len(CLASHING.split(", "))
    return spark.createDataFrame([r + extra for r in ROWS], f"{SCHEMA}, {CLASHING}")


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_tokens(docs, none):
    rows = tokens.count_tokens(docs).collect()
    assert sum(r.section == -1 for r in rows) == len(ROWS)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert tokens.count_tokens(none).count() == 0


def test_licenses(docs, none):
    found = table(license_scan.scan_licenses(docs), ID, "licenses")
    assert len(found) == len(ROWS) and found.count((4, "MIT")) == 2 and (5, "MIT") in found and (1, "") in found
    assert license_scan.scan_licenses(none).count() == 0


def test_simhash(docs, none):
    found = table(simhash.near_duplicates(docs), ID, "fp", "component_id")
    assert len(found) == len(ROWS)
    by = {i: (fp, c) for i, fp, c in found if i is not None}
    assert by[4] == by[5] and by[5][1] == 4
    # no words: fingerprint 0, one group, named by its smallest id; a null id takes part
    assert by[1] == by[2] == by[3] == (0, 1) and (None, 0, 1) in found
    assert simhash.near_duplicates(none).count() == 0


def test_quality(docs, none):
    found = table(quality.apply_rules(docs, carry=("lang",)), ID, "n_words", "base_failed", "kept", "lang")
    assert len(found) == len(ROWS) and (1, 0, True, False, None) in found and (None, 0, True, False, "de") in found
    assert quality.apply_rules(none).count() == 0


def test_language(docs, none):
    labelled = docs.filter("lang is not null").select("doc_id", "lang")
    found = table(langid.identify(docs, langid.fit(docs, labelled)), ID, "lang_pred", "score")
    assert len(found) == len(ROWS)
    assert {x for i, x, _ in found if i in (1, 2, 3, 7)} == {"und"} and all(0 <= s <= 1 for _, _, s in found)
    assert langid.fit(none, none.select("doc_id", "lang")) is None
    assert table(langid.identify(docs, None), "lang_pred") == [("und",)] * len(ROWS)
    assert langid.identify(none, None).count() == 0


def test_pieces(docs, none):
    decoded = pieces.decode(pieces.encode(docs, carry=("text",)), carry=("text", "ids"))
    rows = decoded.collect()
    assert len(rows) == len(ROWS) and all(r.decoded == (r.text or "") for r in rows)
    assert all(not r.ids for r in rows if r.doc_id in (1, 2))
    assert pieces.decode(pieces.encode(none)).count() == 0


def test_line_dedup(docs, none):
    found = table(line_dedup.dedupe_lines(docs, min_docs=2, carry=("lang",)), ID, "n_lines", "n_dropped", "kept_text")
    assert len(found) == len(ROWS) and found.count((4, 1, 1, "")) == 2 and (1, 1, 0, "") in found
    # twice in one document is not twice
    assert (8, 4, 0, ROWS[-1][1]) in found and (3, 3, 0, ROWS[2][1]) in found
    assert line_dedup.dedupe_lines(none).count() == 0


def test_line_dedup_counts_documents(spark):
    """Ten rows with one id are one document; rows without an id are one each."""
    def kept(ids):
        rows = spark.createDataFrame([(i, f"shared line\nown {n}") for n, i in enumerate(ids)], "doc_id long, text string")
        return {r.kept_text.split("\n")[0] for r in line_dedup.dedupe_lines(rows).collect()}

    assert kept([1] * 10) == {"shared line"} and kept([*range(9), 8]) == {"shared line"}
    assert "shared line" not in kept(range(10)) | kept([None] * 10) | kept([*range(6), *[None] * 4])


def test_substrings(docs, none):
    rows = substrings.drop_repeats(docs, min_words=4).collect()
    assert len(rows) == len(ROWS)
    found = sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in rows if r.doc_id in (1, 4, 5, 7, 8)))
    text = " ".join(ROWS[3][1].split())
    # the first of two equal rows stays, the other and the copy under the next id go
    assert sorted(found) == sorted([
        (1, 0, 0, ""), (4, 15, 0, text), (4, 15, 15, ""), (5, 15, 15, ""), (7, 3, 0, "!!! 123 ???"),
        (8, 9, 0, "The QUICK brown fox The quick BROWN fox end"),
    ])
    assert {(r.spans[0].start, r.spans[0].n_words) for r in rows if r.n_removed} >= {(0, 15)}
    assert [r.n_words for r in rows if r.doc_id == 6] == [len(LONG.split())]
    assert substrings.drop_repeats(none).count() == 0


def test_filter_audit(spark, docs, none):
    failed = {(r.id, r.part): r.failed for r in filter_audit.failed_filters(docs).collect()}
    a, b, d, e = 1, 2, 8, 16
    assert failed[1, ""] == a and failed[2, "en"] == a | e and failed[5, "fr"] == a | e and failed[4, "en"] == a
    assert failed[6, "en"] == 0 and failed[8, "en"] & (a | e) == a and failed[None, "de"] in (a, a | d)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(filter_audit.failed_filters(docs), labels).collect()
    assert len(rows) == 600 * len({r[2] or "" for r in ROWS})
    first = {(r.part, r.filter_order[0]): r for r in rows if r.step == 1}
    assert (first["en", "A"].removed, first["en", "A"].good_lost, first["en", "A"].toxic_lost) == (5, 2, 2)
    assert all(r.kept + r.removed + r.redundant <= sum((x[2] or "") == r.part for x in ROWS) for r in rows)
    assert filter_audit.audit(filter_audit.failed_filters(none), labels).count() == 0
    assert filter_audit.matrix(filter_audit.local_shards(none)).count() == 0


def test_conversation_trie(spark):
    rows = [(0, None, "u", "a"), (0, 2, None, None), (1, 1, "u", "a"), (None, 1, "u", "lost"), (2, 7, "u", "a"), (2, 7, "u", "a")]
    extra = ("?", "?")
    table_of = spark.createDataFrame([r + extra for r in rows], "conv_id long, turn int, role string, text string, depth string, p1 string")
    turns = conversation_trie.numbered_turns(table_of)
    convs = turns.groupBy("conv_id").count().withColumnRenamed("count", "n_turns")
    found = {(r.conv_id, r.depth): r for r in conversation_trie.conversation_trie(convs, turns).collect()}
    # "u a" by all three, then nothing, or the same turn again
    assert {k: (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for k, r in found.items()} == {
        (0, 0): (3, 1, 2, 2), (0, 1): (3, 2, 2, 2), (0, 2): (1, 0, 1, 0), (2, 2): (1, 0, 1, 0)
    }
    assert found[0, 1].ends_sha256 == hashlib.sha256(b"1").hexdigest() and found[0, 0].ends_sha256 == EMPTY
    bare = spark.createDataFrame([(5, 0), (6, 0)], "conv_id long, n_turns long")
    (root,) = conversation_trie.conversation_trie(bare, turns.limit(0)).collect()
    assert (root.conv_id, root.n_convs, root.n_leaves, root.ends_sha256) == (5, 2, 1, hashlib.sha256(b"5,6").hexdigest())
    assert conversation_trie.conversation_trie(bare.limit(0), turns.limit(0)).count() == 0
    assert conversation_trie.rebuilt(table_of.limit(0))[1].count() == 0


def test_similar_documents(spark, docs, none):
    found = {}
    for r in simhash.similar_documents(docs).collect():
        found.setdefault(r.group, []).append(r.id)
    assert sorted([sorted(ids, key=repr) for ids in found.values()], key=repr) == sorted(
        [[1, 2, 3, None], [4, 4, 5], [None], [6], [7], [8]], key=repr
    )
    kept = table(simhash.keep_one(docs, ("lang", "source")), ID, "text", "lang")
    assert len(kept) == 6 and {k[0] for k in kept} == {1, 4, 6, 7, 8, None} and simhash.keep_one(none).count() == 0
    # two texts under one id are two documents
    twins = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (None, "a b c d e f")], "doc_id long, text string")
    assert table(simhash.keep_one(twins), ID, "text") == [(1, "a b c d e f"), (1, "g h i j k l")]


def test_fingerprints(docs, none):
    rows = imatch.fingerprint_with_edits(docs).collect()
    assert len(rows) == len(ROWS)
    prints = {r.doc_id: r.fingerprint for r in rows if r.doc_id is not None}
    assert prints[4] == prints[5] and prints[1] == prints[2] == prints[3]
    assert {r.edited_sha256 for r in rows if r.n_chars == 0} == {EMPTY}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert all(r.near_edited == 1 for r in rows if r.n_chars < 2)
    assert imatch.fingerprint_with_edits(none).count() == 0
    named = docs.withColumn("doc_id", F.format_string("%05d", "doc_id"))
    assert {r.fingerprint for r in imatch.fingerprint_with_edits(named).collect()} == {r.fingerprint for r in rows}
    nameless = imatch.with_next_text(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert Counter(r.text for r in nameless) == Counter(r.next_text for r in nameless)


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs, carry=("lang",)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix_sources(none).count() == 0
    wordless = docs.filter("doc_id < 4")
    assert {(r.target, r.taken) for r in mixing.mix_sources(wordless).collect()} == {(0.0, 0)}


def test_warc(spark):
    rows = [(1, None, None), (2, "http://a.example/x", ""), (3, "::bad[", "<a href='http://[bad'>x</a>" + "<p>" * 5000),
            (3, "http://a.example/", "<title>T &amp; U</title><a href=b>l</a>"), (None, "http://a.example/", "<b>n")]
    pages = spark.createDataFrame([r + ("?", "?") for r in rows], "page_id long, url string, html string, id string, block string")
    made = warc.derivatives(warc.responses_from_pages(pages))
    assert made.count() == 2 * len(rows)
    assert warc.derivatives(warc.responses_from_pages(pages.limit(0))).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, none, name, stage):
    assert stage(spark, none, "").count() == 0
    out = stage(spark, docs, "")
    out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS


def test_imatch_shuffles_no_fingerprints(spark, monkeypatch):
    """Rows stay in their buckets: neither ids nor fingerprints are shuffled, but for one row per bucket."""
    plans = {}
    real = imatch.landed
    monkeypatch.setattr(imatch, "landed", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or real(df, label))
    rows = [(i if i % 9 else None, f"some words of text {i % 7} and {i}" * (i % 5)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = imatch.fingerprint_with_edits(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    assert "place" not in "".join(line for line in plans["fingerprints"].splitlines() if "Exchange hashpartitioning" in line)
    ordered = sorted((r for r in found if r.doc_id is not None), key=lambda r: r.doc_id)
    for r, following in zip(ordered, ordered[1:]):
        a, b = r.fingerprint.split("."), following.fingerprint.split(".")
        near = 1.0 if a == b else 2 * len(set(a) & set(b)) / (len(a) + len(b))
        assert r.near_next == pytest.approx(near)
