"""Lists, fusion, ranking, searches and metrics against hand-worked cases and plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import bm25, evaluate, fusion, knn, ranking
from lodeframe.operators.embed import HashingEmbedder, embed_documents, with_retry
from lodeframe.plans import benchmark, search
from lodeframe.present import markdown, response, shown
from lodeframe.schema import NOTE_CONFIG, configure



def as_of():
    return F.lit("2024-02-01").cast("timestamp")


def listed(spark, pairs, qid=1):
    return spark.createDataFrame([(qid, i, float(s), r) for r, (i, s) in enumerate(pairs, 1)], "qid int, id string, score double, rank int")


VECTOR, TEXT = [("a", 0.9), ("b", 0.7), ("c", 0.5)], [("b", 0.8), ("d", 0.6), ("a", 0.4)]


def test_rrf(spark):
    got = {r["id"]: (r["score"], r["rank"]) for r in fusion.rrf(listed(spark, VECTOR), listed(spark, TEXT)).collect()}
    assert len(got) == 4 and got["a"][0] > got["d"][0]
    assert got["a"][0] == pytest.approx(0.7 / 61 + 0.3 / 63) and got["d"][0] == pytest.approx(0.3 / 62)
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1][1])] == ["b", "a", "c", "d"] if 0.7 / 62 + 0.3 / 61 > got["a"][0] else ["a", "b", "c", "d"]


def test_weighted_merge_and_ties_keep_input_order(spark):
    got = fusion.weighted_merge(listed(spark, VECTOR), listed(spark, TEXT)).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [("a", 0.75), ("b", 0.73), ("c", 0.35), ("d", 0.18)]
    tied = fusion.weighted_merge(listed(spark, [("z", 0.3), ("y", 0.3)]), listed(spark, [("x", 0.7), ("w", 0.7)]), 0.7, 0.3).orderBy("rank")
    assert [r["id"] for r in tied.collect()] == ["z", "y", "x", "w"]


@pytest.mark.parametrize("block", [2, 100])
def test_nearest_equals_numpy(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[0]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0])], "id long, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(q, x[q].tolist()) for q in range(5)], "qid long, vector array<float>")
    got = {}
    for r in knn.nearest(queries, corpus, 7, block=block).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    for q in range(5):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        want = sorted(range(300), key=lambda i: (d[i], i))[:7]
        assert [i for _, i, _ in sorted(got[q])] == want
        assert [s for _, _, s in sorted(got[q])] == pytest.approx([1 / (1 + d[i]) for i in want])
    best = queries.join(corpus.filter("size(vector) = 8").withColumnRenamed("vector", "v")).select(knn.sql_distances(F.col("vector"), F.col("v"), "l2").alias("d")).agg(F.min("d")).first()[0]
    assert best == 0.0


def test_rows_that_are_not_finite_hide_no_others(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [nan, 1.0]) for i in range(8)] + [(8, [inf, 0.0]), (9, [1.0, 0.0]), (10, [0.0, 1.0])]
    corpus = spark.createDataFrame(vectors, "id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0])], "qid long, vector array<double>")
    assert [(r["qid"], r["id"]) for r in knn.nearest(queries, corpus, 3).orderBy("rank").collect()] == [(1, 9), (1, 10)]


def test_large_vectors_are_ranked_as_they_are(spark):
    vectors = [(i, [1e8 + i, 0.0]) for i in range(40)]
    corpus = spark.createDataFrame(vectors, "id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1e8 + 20.2, 0.0])], "qid long, vector array<double>")
    assert [r["id"] for r in knn.nearest(queries, corpus, 3).orderBy("rank").collect()] == [20, 21, 19]


def test_nearest_without_queries_or_rows(spark):
    none = spark.createDataFrame([], "qid long, vector array<float>")
    corpus = spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")
    assert knn.nearest(none, corpus).count() == 0
    assert knn.nearest(corpus.withColumnRenamed("id", "qid"), none.withColumnRenamed("qid", "id")).count() == 0


def bm25_model(docs, query, k1=1.2, b=0.75):
    tok = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    n, avg = len(docs), sum(map(len, tok.values())) / len(docs)
    out = {}
    for term in set(re.findall(r"\w+", query.lower())):
        df = sum(term in t for t in tok.values())
        for i, t in tok.items():
            if tf := t.count(term):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return out


def test_bm25_equals_the_model_with_and_without_an_index(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(docs, "id long, text string")
    queries = spark.createDataFrame([(1, "alpha ALPHA zeta"), (2, "beta, gamma"), (3, "nothing")], "qid long, text string")
    index = bm25.build_index(df)
    index.write(str(tmp_path / "fts"))
    for source in (df, index, bm25.TextIndex.read(spark, str(tmp_path / "fts"))):
        got = {(r["qid"], r["id"]): r["score"] for r in bm25.text_search(queries, source, 100).collect()}
        want = {(q, i): s for q, t in ((1, "alpha zeta"), (2, "beta gamma")) for i, s in bm25_model(docs, t).items()}
        assert got == pytest.approx(want)
    ranks = bm25.text_search(queries, df, 3, "rank").collect()
    assert {r["score"] for r in ranks} == {1.0, 1 / 2, 1 / 3} and len(ranks) == 6


def mmr_model(rows, weight=0.7):
    """rows: (id, score, text) in input order."""
    words = {i: set(re.findall(r"\w+", t.lower())) for i, _, t in rows}
    hi, lo = max(s for _, s, _ in rows), min(s for _, s, _ in rows)
    scaled = lambda s: 1 if hi == lo else (s - lo) / (hi - lo)
    sim = lambda a, b: 1 if not words[a] and not words[b] else len(words[a] & words[b]) / len(words[a] | words[b])
    left, out = list(range(len(rows))), []
    while left:
        key = lambda k: (weight * scaled(rows[k][1]) - (1 - weight) * max([sim(rows[k][0], rows[j][0]) for j in out], default=0), rows[k][1], -k)
        out.append(max(left, key=key))
        left.remove(out[-1])
    return [rows[k][0] for k in out]


def test_mmr_equals_the_model(spark):
    rng = random.Random(2)
    data, frames = {}, []
    for q in range(6):
        rows = [(f"{q}-{i}", rng.choice([0.1, 0.4, 0.4, 0.9, 1.3]), " ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 2, 5])))) for i in range(1 + 4 * q)]
        rows.sort(key=lambda r: -r[1])
        data[q] = rows
        frames += [(q, i, float(s), r, t) for r, (i, s, t) in enumerate(rows, 1)]
    hits = spark.createDataFrame(frames, "qid int, id string, score double, rank int, text string")
    got = {}
    for r in ranking.mmr(hits).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: mmr_model(rows) for q, rows in data.items()}


def corpus(spark, embedder, n=30):
    configure(spark)
    words = "spark shuffle join window stream parquet vector search note session".split()
    rng = random.Random(4)
    rows = [(f"f{i}:1", " ".join(rng.choice(words) for _ in range(12)), f"/s/f{i}.jsonl", "p", 1, f"2024-01-{1 + i % 28:02d}T00:00:00.000Z", "user", "pi" if i % 2 else "claude", {"type": "x"}) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, text string, sessionFile string, project string, lineNumber int, timestamp string, role string, source string, metadata map<string,string>")
    return embed_documents(df, embedder)


def test_searches_end_to_end(spark):
    e = HashingEmbedder(64)
    chunks = corpus(spark, e)
    asked = spark.createDataFrame([(1, "shuffle join"), (2, "vector search")], "qid long, text string")
    found = search.session_search(asked, chunks, e, as_of(), limit=5)
    rows = found.orderBy("qid", "rank").collect()
    assert {r["qid"] for r in rows} == {1, 2} and all(r["rank"] <= 5 for r in rows)
    for q in (1, 2):
        scores = [r["score"] for r in rows if r["qid"] == q]
        assert scores == sorted(scores, reverse=True)
    only = search.session_search(asked, chunks, e, as_of(), limit=5, source="pi").collect()
    assert only and all(r["source"] == "pi" for r in only)
    notes = search.knowledge_search(asked, chunks, e, as_of(), limit=4).collect()
    assert sorted(r["rank"] for r in notes if r["qid"] == 1) == [1, 2, 3, 4]
    thin = search.session_search(asked, chunks.limit(1), e, as_of(), limit=6, notes=chunks, note_embedder=e).collect()
    assert all(r["fallback"] for r in thin) and max(r["rank"] for r in thin) >= 3


@pytest.mark.parametrize(("limit", "own"), [(10, 7), (5, 2), (3, 0), (2, 9), (1, 8)])
def test_splice_counts(spark, limit, own):
    hits = listed(spark, [(f"h{i}", 1 - i / 20) for i in range(10)])
    spare = listed(spark, [(f"s{i}", 0.5) for i in range(5)])
    got = [r["id"] for r in search.splice(hits, spare, limit).orderBy("rank").collect()]
    assert got == ([f"h{i}" for i in range(own)] + ["s0", "s1", "s2"])[:limit]


def test_expand_queries(spark):
    asked = spark.createDataFrame([(1, "보편 학문"), (2, "plain"), (3, "모름")], "qid long, text string")
    words = spark.createDataFrame([("보편", ["universal", "x"]), ("학문", ["x", "study"])], "term string, expansions array<string>")
    got = {r["qid"]: r["enriched"] for r in search.expand_queries(asked, words).collect()}
    assert got == {1: "보편 학문 universal x study", 2: "plain", 3: "모름"}


def test_rerank_replaces_order_and_score_or_keeps(spark):
    hits = listed(spark, [("a", 0.9), ("b", 0.5), ("c", 0.1)]).withColumn("text", F.concat(F.lit("t"), "id"))
    asked = spark.createDataFrame([(1, "q")], "qid int, text string")
    flipped = ranking.rerank(hits, asked, lambda q, texts: [(len(texts) - 1 - i, 1.0 / (i + 1)) for i in range(len(texts))], 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in flipped] == [("c", 1.0), ("b", 0.5)]
    assert [r["id"] for r in ranking.rerank(hits, asked, lambda q, t: None, 2).orderBy("rank").collect()] == ["a", "b"]
    assert ranking.rerank(hits, asked, None) is hits


def test_pipeline_filters_before_diversity(spark):
    v, t = listed(spark, VECTOR), listed(spark, TEXT)
    payload = spark.createDataFrame([(i, f"text {i}", "2024-01-31T00:00:00Z", "pi") for i in "abcd"], "id string, text string, timestamp string, source string")
    hits = search.retrieve(v, t, payload, as_of(), NOTE_CONFIG.but(min_score=0.3)).orderBy("rank").collect()
    assert {r["id"] for r in hits} == {"a", "b", "c"}


def test_metrics(spark):
    queries = spark.createDataFrame([(1, ["x", "y"], "c1", "easy"), (2, ["z"], "c2", "hard"), (3, [], "c1", "easy")], "qid long, expected array<string>, category string, difficulty string")
    results = spark.createDataFrame([(1, "/a", 1), (1, "/x1", 2), (1, "/x2", 3), (1, "/y", 7), (2, "/q", 1)], "qid long, path string, rank int")
    scored = evaluate.metrics(results, queries)
    got = {r["qid"]: (r["recall5"], r["recall10"], r["mrr"], r["hit"]) for r in scored.collect()}
    assert got == {1: (0.5, 1.0, 0.5, True), 2: (0.0, 0.0, 0.0, False), 3: (0.0, 0.0, 0.0, False)}
    by = {(r["level"], r["name"]): r for r in evaluate.summary(scored).collect()}
    assert by["overall", "all"]["hits"] == 1 and by["category", "c1"]["recall10"] == 0.5 and ("difficulty", "medium") not in by
    better = scored.withColumn("mrr", F.lit(0.5))
    assert {r["qid"]: r["delta"] for r in evaluate.changes(scored, better).collect()} == {2: 0.5, 3: 0.5}


def test_benchmark_runs_both_sides(spark, tmp_path):
    e = HashingEmbedder(64)
    notes = corpus(spark, e)
    queries = spark.createDataFrame([(1, "shuffle join", ["f3", "f4"], "c1", "easy"), (2, "vector search", ["nowhere"], "c2", "hard")], "qid long, text string, expected array<string>, category string, difficulty string")
    results = benchmark.run(queries, notes, e, as_of())
    got = {(r["qid"], r["mmr_on"]): r for r in results.collect()}
    assert len(got) == 4 and got[1, False]["hit"] == got[1, True]["hit"] and not got[2, False]["hit"] and len(got[1, True]["top"]) == 3
    report = benchmark.report(results, str(tmp_path / "log"))
    assert report["without"].filter("level = 'overall'").first()["queries"] == 2 and report["listing"].count() > 3
    assert spark.read.json(str(tmp_path / "log")).count() == 4 and report["changes"].count() <= 2


def test_retry(spark):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("embed (429): slow down")
        return "ok"

    assert with_retry(flaky, sleep=waits.append, jitter=lambda: 0.0) == "ok" and waits == [2.0, 4.0, 8.0]
    with pytest.raises(ValueError):
        with_retry(lambda: (_ for _ in ()).throw(ValueError("bad key")), sleep=waits.append)
    assert len(waits) == 3


def test_presentation(spark):
    hits = spark.createDataFrame([(1, 1, "x" * 900, "p", "user", "", 0.123456, "/f", 3, "t")], "qid int, rank int, text string, project string, role string, source string, score double, sessionFile string, lineNumber int, timestamp string")
    rows = shown(hits).collect()
    assert '"score": 0.1235' in response("q", rows, fallback=False) and '"source"' not in response("q", rows) and '"fallback"' not in response("q", rows)
    assert markdown("q", []) == 'No results for: "q"'
    assert "## 1. [p] user (score: 0.123)" in markdown("q", shown(hits, 500).collect(), ["e"])
