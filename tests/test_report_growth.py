"""The relevance report shuffles no postings and no words; its index answers as the texts do."""

import pytest
from pyspark.sql import functions as F

from jobs import queries, relevance_report
from lodeframe.operators import bm25
from tests.test_oracle import rows
from tests.test_search_growth import grown, shuffled  # noqa: F401


def test_a_report_shuffles_terms_and_the_best_only(spark, grown, tmp_path):  # noqa: F811
    import duckdb

    moved, results = [], []
    for times, folder in grown.items():
        paths = [f"{folder}/{name}.parquet" for name in ("documents", "embeddings", "benchmark")]
        out = str(tmp_path / str(times))
        moved.append(shuffled(spark, lambda paths=paths, out=out: relevance_report.run(spark, *paths, out))[1])
        found = relevance_report.results(spark, out)
        results.append(found.select("mode", "qid", "relevant", *[F.round(c, 6).alias(c) for c in ("recall5", "recall10", "mrr")], "hit").toPandas())
        con = duckdb.connect()
        for table in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet'")
        assert rows(results[-1]) == rows(con.sql(queries.JOB2_SQL).df())
        spark.catalog.clearCache()
    few, many = moved
    assert many < 1.5 * few and many < 400_000, moved


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """700 documents in one partition, some null or without words, and their index by document."""
    said = [None if i % 50 == 7 else " -- " if i % 50 == 9 else " ".join(f"w{(i * k) % 97}É" for k in range(1, i % 13 + 2)) + f", D_{i}!" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(said)), "id long, text string").coalesce(1)
    path = str(tmp_path_factory.mktemp("words"))
    bm25.WordIndex.write(docs, path)
    return said, docs, bm25.WordIndex.read(spark, path)


def asked(spark):
    return spark.createDataFrame([(1, "w3é w5É"), (2, "d_300"), (3, "nothing"), (4, None), (5, "w1é, w2é"), (6, "w0é"), (7, "2É")], "qid long, text string")


def hits(frame):
    return sorted(tuple(r) for r in frame.select("qid", "rank", "id", "score").collect())


def test_an_index_by_document_holds_all_words_and_terms(spark, stored):
    said, docs, index = stored
    built = bm25.build_index(docs)
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {r["term"]: r["df"] for r in built.terms.collect()}
    assert sum(r["tf"] for r in index.terms.collect()) == sum(r["tf"] for r in built.postings.collect())
    assert tuple(index.totals.first()) == pytest.approx(tuple(built.totals.first()))
    postings = ["term", "id", "tf", "length"]
    assert sorted(index.by_term().postings.select(postings).collect()) == sorted(built.postings.select(postings).collect())
    assert index.words.count() == len(said) and index.words.filter("words IS NULL").count() == 28


def test_an_index_by_document_is_searched_as_the_texts_are(spark, stored, monkeypatch):
    said, docs, index = stored
    want = hits(bm25.text_search(asked(spark), docs, 20))
    assert hits(bm25.text_search(asked(spark), index, 20)) == want and len({q for q, *_ in want}) == 4
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 64)  # as with more queries than can be told to tasks
    assert hits(bm25.text_search(asked(spark), index, 20)) == want


def test_phrases_are_found_whole_and_in_order(spark, stored, monkeypatch):
    said, docs, index = stored
    words = [f" {' '.join(''.join(c if c.isalnum() or c == '_' else ' ' for c in (s or '').lower()).split())} " for s in said]
    wanted = {1: "w3é w5é", 2: "d_300", 5: "w1é w2é", 6: "w0é"}
    want = sorted((q, i) for q, w in wanted.items() for i, s in enumerate(words) if f" {w} " in s)
    assert sorted(map(tuple, bm25.phrase_search(asked(spark), index).collect())) == want and len({q for q, _ in want}) >= 3
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 64)
    assert sorted(map(tuple, bm25.phrase_search(asked(spark), index).collect())) == want


def test_terms_that_a_task_passes_on_early_add_up(spark, stored, monkeypatch):
    said, docs, index = stored
    monkeypatch.setattr(bm25, "HELD_TERMS", 100)
    met = bm25._terms_met(index.words.coalesce(1))
    assert met.count() > index.terms.count()  # one task told them in parts
    added = met.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    assert sorted(added.collect()) == sorted(index.terms.select("term", "df", "tf").collect())


def test_an_empty_table_gives_an_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, text string")
    bm25.WordIndex.write(docs, str(tmp_path))
    index = bm25.WordIndex.read(spark, str(tmp_path))
    assert tuple(index.totals.first()) == (0, None) and index.terms.count() == 0
    assert bm25.text_search(asked(spark), index, 5).count() == 0 and bm25.phrase_search(asked(spark), index).count() == 0
