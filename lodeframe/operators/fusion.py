"""Fusion of a vector list and a text list per query: both are (qid, id, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _both(vector: DataFrame, text: DataFrame) -> DataFrame:
    v = vector.select("qid", "id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    t = text.select("qid", "id", F.col("score").alias("text_score"), F.col("rank").alias("text_rank"))
    return v.join(t, ["qid", "id"], "full_outer")


def _ranked(fused: DataFrame) -> DataFrame:
    """qid, id, score, seq, rank; ties keep the input order: vector hits by rank, then text-only hits."""
    first = Window.partitionBy("qid").orderBy(F.col("vector_rank").asc_nulls_last(), "text_rank")
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "seq")
    return fused.withColumn("seq", F.row_number().over(first)).withColumn("rank", F.row_number().over(best)).select("qid", "id", "score", "seq", "rank")


def weighted_merge(vector: DataFrame, text: DataFrame, vector_weight: float = 0.7, text_weight: float = 0.3) -> DataFrame:
    score = F.lit(vector_weight) * F.coalesce("vector_score", F.lit(0.0)) + F.lit(text_weight) * F.coalesce("text_score", F.lit(0.0))
    return _ranked(_both(vector, text).withColumn("score", score))


def rrf(vector: DataFrame, text: DataFrame, vector_weight: float = 0.7, text_weight: float = 0.3, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the sum of weight / (k + rank) over the lists, ranks from 1."""
    score = F.coalesce(F.lit(vector_weight) / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(F.lit(text_weight) / (k + F.col("text_rank")), F.lit(0.0))
    return _ranked(_both(vector, text).withColumn("score", score))
