"""The near-duplicate stage against brute force: shingle similarity, repeated and missing ids."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeframe.llm import overlap, session, simhash
from lodeframe.llm.decontaminate import shingles
from tests.conftest import TESTDATA
from tests.llm.test_corpus import union_find
from tests.llm.test_filters import docs


def brute_kept(rows, width=5, similarity=0.8):
    """Smallest ids of the components of (doc_id, text) by Jaccard similarity of word shingles."""
    sets = {}
    for d, t in rows:
        t = (t or "").encode()
        n = len(t.split())
        sets[d] = shingles(t, min(width, n)) if n else set()
    ids = sorted(sets)
    alike = lambda a, b: a == b or len(a & b) / len(a | b) >= similarity - 1e-9
    pairs = [(x, y) for i, x in enumerate(ids) for y in ids[:i] if alike(sets[x], sets[y])]
    return sorted(set(union_find(pairs, ids).values()))


@pytest.mark.parametrize("block", [overlap.BLOCK, 7])
def test_near_duplicates_at_a_similarity_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([30, 60, 100, 400]))) for _ in range(12)]
    texts = list(base)
    for _ in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            words[rng.randrange(len(words))] = f"z{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts += ["", None, " \n", "One", "one", "one two", base[0].upper(), base[0]] + [base[1] + " " + base[2]]
    rows = list(enumerate(texts))
    frame = docs(spark, texts)
    kept = simhash.drop_near_duplicates(frame, 5, 0.8)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows)
    assert len(brute_kept(rows)) < simhash.drop_near_duplicates(frame).count()
    assert simhash.drop_near_duplicates(frame.filter("false"), 5, 0.8).count() == 0


def test_the_stage_keeps_one_document_of_each_group_at_five_words_and_0_8(spark):
    frame = session.table(spark, TESTDATA, "documents")
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    want = brute_kept([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in stage(spark, frame, TESTDATA).collect()) == want


@pytest.mark.parametrize("limits", [(), (5, 0.8)])
def test_a_repeated_id_with_another_text_is_not_lost(spark, limits):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    frame = docs(spark, [one, two]).unionByName(docs(spark, [three, two], start=1)).unionByName(docs(spark, [one, three]))
    got = sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(frame, *limits).collect())
    assert got == [(0, one), (1, two), (1, three)]


@pytest.mark.parametrize("limits", [(), (5, 0.8)])
def test_rows_without_an_id_join_their_component(spark, limits):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    frame = docs(spark, [one, two])
    nameless = docs(spark, [one, three, three]).withColumn("doc_id", F.lit(None).cast("long"))
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(frame.unionByName(nameless), *limits).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(0, one), (1, two)]
    assert len([x for x in got if x[0] is None]) == 1 and got.count((None, one)) == 0


@pytest.mark.parametrize("chunk, pairs", [(overlap.CHUNK, overlap.PAIRS), (5, 2)])
def test_a_frequent_passage_loses_no_link_and_deals_out_no_pairs(spark, monkeypatch, chunk, pairs):
    monkeypatch.setattr(overlap, "CHUNK", chunk)
    monkeypatch.setattr(overlap, "PAIRS", pairs)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for _ in range(60):  # similar by the passage only, each with a chain of near copies
        words = passage + [f"w{rng.randrange(9**6)}" for _ in range(rng.choice([6, 14, 30]))]
        for _ in range(3):
            texts.append(" ".join(words))
            words[rng.randrange(40, len(words))] = f"z{rng.randrange(9**6)}"
    frame = docs(spark, texts)
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame, 5, 0.8).collect())
    assert got == brute_kept(list(enumerate(texts))) and 60 <= len(got) < 180
