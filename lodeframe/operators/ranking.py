"""Re-ranking of fused hits: recency decay, score filter, diversity, external rerank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.score import decay, min_max, parse_time
from lodeframe.functions.text import bind, token_set


def rerank_by_score(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "seq")))


def apply_decay(hits: DataFrame, as_of: Column, half_life_days: float, org_dates: bool = False) -> DataFrame:
    """Scores of hits (with a text `timestamp`) decayed by age at as_of; unparsable times leave the score."""
    if half_life_days <= 0:
        return hits
    return hits.withColumn("score", decay(F.col("score"), parse_time(F.col("timestamp"), org_dates), as_of, half_life_days))


def filter_score(hits: DataFrame, least: float) -> DataFrame:
    return hits.filter(F.col("score") >= least)


def _similar(hits: DataFrame) -> DataFrame:
    """qid, rank, sims: each hit's Jaccard to its query's hits, in rank order.

    Common words are counted by an equi-join on (qid, word), so long texts spread over tasks.
    """
    words = hits.select("qid", "rank", F.explode_outer(token_set(F.coalesce("text", F.lit("")))).alias("word")).filter("word IS NOT NULL")
    sizes = words.groupBy("qid", "rank").agg(F.count("*").alias("n"))
    a, b = words.select("qid", F.col("rank").alias("i"), "word"), words.select("qid", F.col("rank").alias("j"), "word")
    common = a.join(b, ["qid", "word"]).groupBy("qid", "i", "j").agg(F.count("*").alias("common"))
    sized = hits.select("qid", "rank").join(sizes, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("n", F.lit(0)).alias("n"))
    grid = sized.select("qid", F.col("rank").alias("i"), F.col("n").alias("ni")).join(sized.select("qid", F.col("rank").alias("j"), F.col("n").alias("nj")), "qid")
    shared = F.coalesce("common", F.lit(0))
    sim = F.when((F.col("ni") == 0) & (F.col("nj") == 0), 1.0).when((F.col("ni") == 0) | (F.col("nj") == 0), 0.0).otherwise(shared / (F.col("ni") + F.col("nj") - shared))
    pairs = grid.join(common, ["qid", "i", "j"], "left").select("qid", F.col("i").alias("rank"), F.struct("j", sim.alias("sim")).alias("s"))
    return pairs.groupBy("qid", "rank").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["sim"]).alias("sims"))


def mmr(hits: DataFrame, weight: float = 0.7) -> DataFrame:
    """hits (qid, id, score, rank, text, ...) with `rank` by maximal marginal relevance.

    Greedy: weight * scaled score - (1 - weight) * greatest Jaccard to those already
    picked; ties go to the higher score, then the earlier row.  No row is dropped and
    no score changed.  A query's hits are one array, as many as the top-k before it.
    """
    hits = hits.persist()  # top-k rows, used by each of the joins below; a lost part is computed again
    scaled = hits.select("qid", "id", "rank", "score", min_max(F.col("score"), "qid").alias("norm")).join(_similar(hits), ["qid", "rank"])
    lists = scaled.groupBy("qid").agg(F.collect_list(F.struct("rank", "norm", "score", "id", "sims")).alias("items"))

    def order(items):
        """ids in the order picked."""

        def step(state, _):
            def value(x, i):
                gain = F.lit(weight) * x["norm"] - F.lit(1 - weight) * F.get(state["near"], i)
                return F.struct((-gain).alias("gain"), (-x["score"]).alias("score"), i.alias("i"))

            open_ = F.filter(F.transform(items, value), lambda v: ~F.array_contains(state["picked"], v["i"]))

            def after(pick):
                near = F.zip_with(state["near"], F.get(items, pick)["sims"], lambda a, b: F.greatest(a, b))
                return F.struct(F.array_append(state["picked"], pick).alias("picked"), near.alias("near"))

            return bind(F.array_min(open_)["i"], after)

        start = F.struct(F.array().cast("array<int>").alias("picked"), F.transform(items, lambda _: F.lit(0.0)).alias("near"))
        return F.aggregate(F.sequence(F.lit(1), F.size(items)), start, step, lambda s: F.transform(s["picked"], lambda i: F.get(items, i)["id"]))

    # the sorted hits are bound, else every use in the fold would sort them again;
    # explode_outer: a plain explode would copy the fold into a filter below
    picks = lists.select("qid", F.posexplode_outer(bind(F.array_sort("items"), order)).alias("_at", "id")).select("qid", "id", (F.col("_at") + 1).alias("_rank"))
    return hits.join(picks, ["qid", "id"]).withColumn("rank", F.col("_rank")).drop("_rank")


Scorer = Callable[[str, Sequence[str]], Sequence[tuple[int, float]] | None]


def rerank(hits: DataFrame, queries: DataFrame, scorer: Scorer | None, top: int = 10) -> DataFrame:
    """hits re-ordered by an external scorer, which replaces order and score.

    scorer(query text, texts in rank order) gives (index, score) pairs, best first, or
    None on failure, which keeps the first `top` hits as they are.  Without a scorer
    hits pass through.
    """
    if scorer is None:
        return hits
    columns = hits.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank").reset_index(drop=True)
        found = scorer(frame["_query"].iloc[0], frame["text"].tolist())
        if found is None:
            return frame.head(top)[columns]
        out = frame.iloc[[i for i, _ in found[:top]]].copy()
        out["score"] = [float(s) for _, s in found[:top]]
        out["rank"] = range(1, len(out) + 1)
        return out[columns]

    asked = hits.join(queries.select("qid", F.col("text").alias("_query")), "qid")
    return asked.groupBy("qid").applyInPandas(run, hits.schema)
