"""Searches keep the best rows per task: what they hold and shuffle does not grow with postings times queries."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.operators import bm25, topk

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n=300):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([0, 2, 9, 40, 300]))) for _ in range(n)] + ["w1 w2 same"] * 50 + [None, "İx İX w1"]
    return spark.createDataFrame([(f"d{i:04}", t) for i, t in enumerate(texts)], "id string, text string").repartition(3)


def queries(spark):
    texts = [" ".join(WORDS[i : i + 20]) for i in range(0, 40, 5)] + ["w1 w2 same", "none", None, "i̇x"]
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def brute(docs, asked, limit):
    words = {r["id"]: Counter(re.findall(r"\w+", r["text"].lower().replace("̇", " "))) if r["text"] else Counter() for r in docs.collect()}
    average = sum(c.total() for c in words.values()) / len(words)
    df, out = Counter(t for c in words.values() for t in c), []
    for q in asked.collect():
        scores = {}
        for d, c in words.items():
            for t in set(re.findall(r"\w+", (q["text"] or "").lower().replace("̇", " "))) & set(c):
                idf = math.log1p((len(words) - df[t] + 0.5) / (df[t] + 0.5))
                scores[d] = scores.get(d, 0) + idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average))
        best = sorted((-round(s, 9), d) for d, s in scores.items())[:limit]
        out += [(q["qid"], d, i + 1) for i, (_, d) in enumerate(best)]
    return sorted(out)


def found(frame):
    return sorted((r["qid"], r["id"], r["rank"]) for r in frame.collect())


@pytest.fixture
def small(monkeypatch):
    """Tiles, blocks and buffers so small that all of them are met."""
    monkeypatch.setattr(bm25, "CELLS", 40)
    monkeypatch.setattr(bm25, "TILE_DOCS", 7)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 5)
    monkeypatch.setattr(bm25, "PRUNED_PAIRS", 0)


def test_a_text_search_keeps_no_postings_and_shuffles_only_the_best(spark, small):
    docs, asked = corpus(spark), queries(spark)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    hits = bm25.text_search(asked, docs, 6)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "Aggregate" not in plan and "Join" not in plan
    assert found(hits) == brute(docs, asked, 6)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def test_the_best_are_kept_in_bounded_room():
    rng, kept = np.random.default_rng(3), topk.Best(3, 4)
    kept.room, rows = 20, []
    for part in range(50):
        q, key = rng.integers(0, 3, 30), rng.integers(0, 5, 30).astype(float)
        ids = [f"{part * 7 % 50:02}-{i:02}" for i in range(30)]
        kept.add(q, key, np.arange(30), pa.array(ids))
        rows += zip(q.tolist(), key.tolist(), ids)
        assert kept.size <= 20
    want = [r for n in range(3) for r in sorted(r for r in rows if r[0] == n)[:4]]
    q, key, ids = kept.rows()
    assert list(zip(q.tolist(), key.tolist(), ids.to_pylist())) == want


def test_a_stored_index_adds_up_a_document_in_one_task(spark, small, tmp_path):
    docs, asked, key = corpus(spark), queries(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    bm25.build_index(docs).write(str(tmp_path), buckets=3)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 3)  # a document's postings go on in the next batch
        hits = bm25.text_search(asked, bm25.TextIndex.read(spark, str(tmp_path)), 6)
        assert "Aggregate" not in hits._jdf.queryExecution().optimizedPlan().toString()  # no sum over (query, document)
        assert found(hits) == brute(docs, asked, 6)
    finally:
        spark.conf.set(key, before)


def test_words_are_counted_in_the_row(spark):
    index = bm25.build_index(corpus(spark))
    assert "Aggregate" not in index.postings._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["id"], r["term"]): (r["tf"], r["length"]) for r in index.postings.collect()}
    want = {}
    for r in corpus(spark).collect():
        words = re.findall(r"\w+", (r["text"] or "").lower().replace("̇", " "))
        want |= {(r["id"], t): (n, len(words)) for t, n in Counter(words).items()}
    assert got == want


def test_texts_are_not_shuffled_to_meet_vectors_nobody_wants(spark):
    from lodeframe.plans import queries as core
    from tests.conftest import TESTDATA

    rows = core._rows(spark, TESTDATA)
    assert "Join" not in rows.select("id", "text", "sessionFile")._jdf.queryExecution().optimizedPlan().toString()
    assert rows.filter("vector IS NOT NULL").count() == rows.select("id").join(core._vectors(spark, TESTDATA), "id").count()


def test_nearest_neighbours_hold_tiles_whatever_the_batch(spark):
    import tracemalloc

    from lodeframe.operators.knn import _nearest_in_batch

    rng = np.random.default_rng(1)
    asked, rows = rng.normal(size=(2048, 8)), rng.normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(list(rows))], names=["id", "vector"])
    tracemalloc.start()
    out = list(_nearest_in_batch(list(range(2048)), asked, 5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and sum(len(b) for b in out) == 5 * 2048
    got = {}
    for b in out:
        for q, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got.setdefault(q, set()).add(i)
    for q in range(0, 2048, 300):
        assert got[q] == set(np.argsort(((rows - asked[q]) ** 2).sum(axis=1))[:5].tolist())
