"""Relevance metrics over ranked results of many queries.

results: qid, path, rank.  queries: qid, expected (array of strings), category,
difficulty.  A result is relevant if its path contains an expected string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIFFICULTIES = ("easy", "medium", "hard")


def metrics(results: DataFrame, queries: DataFrame, depths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """queries with recall<k> per depth, mrr over the whole list, and hit.

    Recall is the share of expected strings met among the first k results; no
    expected strings give 0.  Queries are few and meet only their own results.
    """
    expected = queries.select("qid", F.posexplode("expected").alias("e", "want"))
    met = expected.join(results.select("qid", "path", "rank"), "qid").filter(F.contains("path", F.col("want")))
    found = met.groupBy("qid").agg(*[F.countDistinct(F.when(F.col("rank") <= k, F.col("e"))).alias(f"found{k}") for k in depths], F.min("rank").alias("first"))
    out = queries.join(found, "qid", "left")
    size = F.size("expected")
    recalls = {f"recall{k}": F.when(size > 0, F.coalesce(f"found{k}", F.lit(0)) / size).otherwise(0.0) for k in depths}
    return out.withColumns({**recalls, "mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "hit": F.col("first").isNotNull()}).drop("first", *[f"found{k}" for k in depths])


def judged_metrics(results: DataFrame, judgments: DataFrame, queries: DataFrame, depths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """qid, relevant, recall<k>, mrr, hit for every row of queries (qid), by judgments (qid, id) of ranked results (qid, id, rank).

    Judged rows are joined by id and counted, so a query may have any number of them; one
    without any has recall and mrr 0.  Pairs that judgments repeat count once.
    """
    judged = judgments.select("qid", "id").distinct()
    sizes = judged.groupBy("qid").agg(F.count("*").alias("relevant"))
    met = judged.join(results.select("qid", "id", "rank"), ["qid", "id"])
    found = met.groupBy("qid").agg(*[F.countDistinct(F.when(F.col("rank") <= k, F.col("id"))).alias(f"found{k}") for k in depths], F.min("rank").alias("first"))
    out = queries.select("qid").join(sizes, "qid", "left").join(found, "qid", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0).cast("long")))
    recalls = [F.when(F.col("relevant") > 0, F.coalesce(f"found{k}", F.lit(0)) / F.col("relevant")).otherwise(0.0).alias(f"recall{k}") for k in depths]
    return out.select("qid", "relevant", *recalls, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.col("first").isNotNull().alias("hit"))


def summary(scored: DataFrame) -> DataFrame:
    """Means overall, by category and by difficulty: level, name, queries, recall5, recall10, mrr, hits, hit_rate."""
    grouped = scored.groupingSets([[], [F.col("category")], [F.col("difficulty")]], F.col("category"), F.col("difficulty")).agg(
        F.grouping("category").alias("no_category"),
        F.grouping("difficulty").alias("no_difficulty"),
        F.count("*").alias("queries"),
        F.avg("recall5").alias("recall5"),
        F.avg("recall10").alias("recall10"),
        F.avg("mrr").alias("mrr"),
        F.count_if("hit").alias("hits"),
    )
    level = F.when(F.col("no_category") == 0, "category").when(F.col("no_difficulty") == 0, "difficulty").otherwise("overall")
    place = F.array_position(F.array(*[F.lit(d) for d in DIFFICULTIES]), F.col("difficulty"))
    name = F.when(level == "category", F.col("category")).when(level == "difficulty", F.col("difficulty")).otherwise("all")
    out = grouped.select(level.alias("level"), name.alias("name"), place.alias("_place"), "queries", "recall5", "recall10", "mrr", "hits", (F.col("hits") / F.col("queries")).alias("hit_rate"))
    return out.orderBy("level", F.coalesce("_place", F.lit(0)), "name").drop("_place")


def changes(without: DataFrame, with_: DataFrame) -> DataFrame:
    """qid, before, after, delta of the queries whose mrr differs between two scored runs."""
    a, b = without.select("qid", F.col("mrr").alias("before")), with_.select("qid", F.col("mrr").alias("after"))
    return a.join(b, "qid").filter(F.col("before") != F.col("after")).withColumn("delta", F.col("after") - F.col("before"))


def listing(queries: DataFrame) -> DataFrame:
    """Queries per category and difficulty, with the totals."""
    return queries.cube("category", "difficulty").agg(F.count("*").alias("queries"))
