"""Searches: merge, decay, filter, diversify; session search with fallback; note search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.text import hangul_terms
from lodeframe.operators.bm25 import TextIndex, text_search
from lodeframe.operators.embed import Embedder, embed_queries
from lodeframe.operators.fusion import rrf, weighted_merge
from lodeframe.operators.knn import vector_search
from lodeframe.operators.ranking import Scorer, apply_decay, filter_score, mmr, rerank, rerank_by_score
from lodeframe.schema import NOTE_CONFIG, PAYLOAD, SESSION_CONFIG, RetrieverConfig

#: Hits of all lists up to which they are broadcast past the chunks.
BROADCAST_HITS = 500_000
THIN_ROWS, THIN_SCORE, FALLBACK_ROWS = 3, 0.005, 3


def expand_queries(queries: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """queries (qid, text) with `expansions` and `enriched`: the text, and the expansions of its Hangul terms.

    dictionary: term, expansions.  Terms that it lacks are passed over.
    """
    if dictionary is None:
        return queries.withColumn("expansions", F.array().cast("array<string>")).withColumn("enriched", F.col("text"))
    terms = queries.select("qid", F.posexplode(hangul_terms(F.col("text"))).alias("at", "term"))
    met = terms.join(dictionary, "term").groupBy("qid").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "expansions"))), lambda x: x["expansions"]))).alias("expansions"))
    joined = queries.join(met, "qid", "left").withColumn("expansions", F.coalesce("expansions", F.array().cast("array<string>")))
    return joined.withColumn("enriched", F.when(F.size("expansions") > 0, F.concat_ws(" ", "text", F.array_join("expansions", " "))).otherwise(F.col("text")))


def retrieve(vector: DataFrame, text: DataFrame, payload: DataFrame, as_of: Column, config: RetrieverConfig = NOTE_CONFIG, queries: DataFrame | None = None, scorer: Scorer | None = None, few: bool = False) -> DataFrame:
    """Ranked hits of the fused lists with their payload (id, text, timestamp, ...).

    Merge, decay, order, least score, then diversity and an external scorer if asked for.
    few: the lists are known to be small enough to broadcast past the payload.
    """
    if config.strategy == "rrf":
        fused = rrf(vector, text, config.vector_weight, config.text_weight, config.rrf_k)
    else:
        fused = weighted_merge(vector, text, config.vector_weight, config.text_weight)
    hits = payload.join(F.broadcast(fused) if few else fused, "id")
    hits = filter_score(rerank_by_score(apply_decay(hits, as_of, config.half_life_days, config.parse_org_dates)), config.min_score)
    if config.mmr:
        hits = mmr(hits, config.mmr_lambda)
    return rerank(hits, queries, scorer, config.rerank_top) if scorer is not None and queries is not None else hits


def _hybrid(queries: DataFrame, chunks: DataFrame, index: TextIndex | None, embedder: Embedder, each: int, least: float, as_of: Column, config: RetrieverConfig, fts_score: str, scorer: Scorer | None = None) -> DataFrame:
    asked = embed_queries(queries.select("qid", F.col("enriched").alias("text")), embedder)
    vector = vector_search(asked.select("qid", "vector"), chunks.select("id", "vector"), each, least)
    text = text_search(queries.select("qid", "text"), index or chunks.select("id", "text"), each, fts_score)
    few = asked.count() * 2 * each <= BROADCAST_HITS
    return retrieve(vector, text, chunks.select("id", *PAYLOAD), as_of, config, queries, scorer, few)


def knowledge_search(queries: DataFrame, notes: DataFrame, embedder: Embedder, as_of: Column, limit: int = 10, dictionary: DataFrame | None = None, config: RetrieverConfig = NOTE_CONFIG, index: TextIndex | None = None, fts_score: str = "bm25", scorer: Scorer | None = None) -> DataFrame:
    """The best `limit` note chunks of each of queries (qid, text)."""
    asked = expand_queries(queries, dictionary)
    return _hybrid(asked, notes, index, embedder, 2 * limit, 0.05, as_of, config, fts_score, scorer).filter(F.col("rank") <= limit)


def thin_queries(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """qids with fewer than three hits or a best score below .005."""
    best = hits.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    return queries.select("qid").join(best, "qid", "left").filter((F.coalesce("n", F.lit(0)) < THIN_ROWS) | (F.coalesce("top", F.lit(0.0)) < THIN_SCORE)).select("qid")


def splice(hits: DataFrame, spare: DataFrame, limit: int) -> DataFrame:
    """Per query with spare hits: its first limit-3 hits, then the first 3 spare ones, not re-ordered.

    A limit below 3 drops that many of the last hits instead.  `fallback` tells such queries.
    """
    first = spare.filter(F.col("rank") <= FALLBACK_ROWS).withColumn("block", F.lit(1))
    has = first.select("qid").distinct().withColumn("fallback", F.lit(True))
    sized = hits.join(hits.groupBy("qid").agg(F.count("*").alias("_n")), "qid").join(has, "qid", "left").withColumn("fallback", F.coalesce("fallback", F.lit(False)))
    room = F.lit(limit - FALLBACK_ROWS) if limit >= FALLBACK_ROWS else F.col("_n") + F.lit(limit - FALLBACK_ROWS)
    own = sized.filter(~F.col("fallback") | (F.col("rank") <= room)).drop("_n").withColumn("block", F.lit(0))
    both = own.unionByName(first.withColumn("fallback", F.lit(True)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("block", "rank"))).drop("block").filter(F.col("rank") <= limit)


def session_search(
    queries: DataFrame,
    sessions: DataFrame,
    embedder: Embedder,
    as_of: Column,
    limit: int = 10,
    source: str | None = None,
    notes: DataFrame | None = None,
    note_embedder: Embedder | None = None,
    dictionary: DataFrame | None = None,
    config: RetrieverConfig = SESSION_CONFIG,
    index: TextIndex | None = None,
    fts_score: str = "bm25",
    note_index: TextIndex | None = None,
) -> DataFrame:
    """The best `limit` session chunks of each of queries (qid, text), eked out by notes where thin.

    The source filter stands after the top-k, so it may leave fewer rows.
    """
    asked = expand_queries(queries, dictionary)
    hits = _hybrid(asked, sessions, index, embedder, 2 * limit, 0.1, as_of, config, fts_score)
    if source:
        hits = rerank_by_score(hits.filter(F.col("source") == source))
    if notes is None or note_embedder is None:
        return hits.filter(F.col("rank") <= limit).withColumn("fallback", F.lit(False))
    # top-k rows per query, used several times below; a lost part is computed again
    hits = hits.persist()
    poor = asked.join(thin_queries(hits, queries), "qid", "left_semi").persist()
    spare = _hybrid(poor, notes, note_index, note_embedder, limit, 0.05, as_of, NOTE_CONFIG, fts_score).persist()
    return splice(hits, spare, limit)
