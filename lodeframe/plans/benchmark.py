"""The relevance benchmark: every query with and without diversity, in one plan per side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.operators.bm25 import text_search
from lodeframe.operators.embed import Embedder, embed_queries
from lodeframe.operators.evaluate import changes, listing, metrics, summary
from lodeframe.operators.knn import vector_search
from lodeframe.plans.search import retrieve
from lodeframe.schema import NOTE_CONFIG, PAYLOAD
from lodeframe.sources.files import append_log

EACH, LEAST = 20, 0.05


def run(queries: DataFrame, notes: DataFrame, embedder: Embedder, as_of: Column, fts_score: str = "bm25") -> DataFrame:
    """Metrics of queries (qid, text, expected, category, difficulty) over notes, once per `mmr`.

    Both sides share the vector and text lists of 20; `top` are the names of the first three files.
    """
    asked = embed_queries(queries.select("qid", "text"), embedder)
    vector = vector_search(asked.select("qid", "vector"), notes.select("id", "vector"), EACH, LEAST).persist()
    text = text_search(asked.select("qid", "text"), notes.select("id", "text"), EACH, fts_score).persist()
    sides = []
    for on in (False, True):
        hits = retrieve(vector, text, notes.select("id", *PAYLOAD), as_of, NOTE_CONFIG.but(mmr=on)).select("qid", F.col("sessionFile").alias("path"), "rank")
        name = F.left(F.element_at(F.split("path", "/"), -1), F.lit(60))
        top = hits.filter("rank <= 3").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name.alias("name")))), lambda x: x["name"]).alias("top"))
        scored = metrics(hits, queries).join(top, "qid", "left").withColumn("top", F.coalesce("top", F.array().cast("array<string>")))
        sides.append(scored.withColumn("mmr_on", F.lit(on)))
    return sides[0].unionByName(sides[1])


def report(results: DataFrame, log: str | None = None) -> dict[str, DataFrame]:
    """Summaries of both sides, the queries that diversity changed, and the listing; appended to a log if one is named."""
    off, on = results.filter("NOT mmr_on"), results.filter("mmr_on")
    if log:
        append_log(results.withColumn("timestamp", F.current_timestamp()), log)
    return {"without": summary(off), "with": summary(on), "changes": changes(off, on), "listing": listing(off)}
