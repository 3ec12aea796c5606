"""The registered queries against their SQL, their plans, and the pipeline as a whole."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402
from reviewloom.llm import simhash, substrings  # noqa: E402
from reviewloom.llm.registry import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    good, note, _, _ = check_oracle.compare(spark, check_oracle.connect(SF), SF, name, QUERIES, ORACLES)
    assert good, note


@pytest.mark.parametrize("name", ["op2_license_scan", "op7_line_dedup", "op8_imatch"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


def similar_groups(texts, likeness=0.8):
    """The smallest id of every document's group, from all pairs of distinct sets of five-word shingles."""
    shingles = {}
    for i, text in texts.items():
        words = text.encode().lower().split()
        shingles.setdefault(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))), []).append(i)
    sets, root = list(shingles), list(range(len(shingles)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            common = len(one & sets[j])
            if common >= likeness * (len(one) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for i, members in enumerate(shingles.values()):
        names[find(i)] = min([names.get(find(i), members[0]), *members])
    return {k: names[find(i)] for i, members in enumerate(shingles.values()) for k in members}


def test_near_copies_are_joined(spark):
    """At least nine of ten pairs that share 0.8 or more of their shingles, and no others."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    texts, at = {}, 0
    for _ in range(150):
        base = [word() for _ in range(draw.randrange(60, 300))]
        texts[at], at = " ".join(base), at + 1
        for _ in range(2):
            edited = list(base)
            for k in draw.sample(range(len(base)), max(1, len(base) // draw.choice((20, 40, 60, 80)))):
                edited[k] = word()
            texts[at], at = " ".join(edited), at + 1
    rows = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    found = {r.id: r.group for r in simhash.similar_documents(rows).collect()}
    expected = similar_groups(texts)
    pairs = [(i, expected[i]) for i in texts if expected[i] != i]
    joined = [found[i] == found[j] for i, j in pairs]
    assert len(pairs) > 80 and sum(joined) >= 0.9 * len(pairs)
    first = {}
    for i, group in found.items():
        assert expected[first.setdefault(group, i)] == expected[i]


def test_pipeline(spark):
    docs = corpus_pipeline.documents(spark, SF)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.landed(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
    before, after = seen["quality_rules"]
    assert 0 < after.count() < before.count()
    before, after = seen["line_dedup"]
    assert after.count() == before.count()
    before, after = seen["simhash_near_dedup"]
    assert after.count() == len(set(similar_groups({r.doc_id: r.text for r in before.collect()}).values()))
    before, after = seen["mix_sources"]
    assert after.join(before, list(corpus_pipeline.COLUMNS), "left_anti").count() == 0
    assert after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 2
    assert docs.count() == after.count() and docs.filter("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_substrings_over_many_shards_and_groups(spark, monkeypatch):
    """Small limits: several shards, split prefix groups and anchor buckets give the same rows."""
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(substrings, "GROUP_SUFFIXES", 64)
    monkeypatch.setattr(substrings, "ANCHOR_WORDS", 4_000)
    good, note, _, _ = check_oracle.compare(spark, check_oracle.connect(SF), SF, "op12_substring_dedup", QUERIES, ORACLES)
    assert good, note
