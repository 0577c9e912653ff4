"""Exact k-nearest neighbours of many queries at once.

Queries are broadcast in blocks of bounded size; the corpus streams past once per
block.  A partition of the corpus answers all queries of the block by matrix products
of bounded size and passes on its own k best, so what is shuffled is k rows per
query and partition.  `sql_distances` is the same distance as a Column, for a filter or
join where few pairs are compared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.score import similarity
from lodeframe.operators.topk import CELLS, Best

#: Queries held by a task at once.
QUERY_BLOCK = 2_048


def sql_distances(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Distance of two equally long arrays in double precision."""
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.sqrt(total) if metric == "l2" else total


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest_in_batch(qids: list, queries: np.ndarray, k: int):
    norms = (queries**2).sum(axis=1)
    tile = max(1, CELLS // len(qids))

    def run(batches):
        best = Best(len(qids), k)
        for rows in (batch.slice(lo, tile) for batch in batches for lo in range(0, len(batch), tile)):
            dims = np.diff(rows.column(1).fill_null([]).offsets.to_numpy())
            fit = np.flatnonzero(dims == queries.shape[1])
            if not len(fit):
                continue
            x = _matrix(rows.column(1).take(pa.array(fit)))
            finite = np.isfinite(x).all(axis=1)
            fit, x = fit[finite], x[finite]
            if not len(fit):
                continue
            near = queries @ x.T
            near *= -2
            near += norms[:, None]
            near += (x**2).sum(axis=1)[None, :]
            # the expanded square is off by rounding of its largest term
            slack = 1e-9 * (1 + norms + (x**2).sum(axis=1).max())
            edge = best.edge + slack
            if len(fit) > k:
                edge = np.minimum(edge, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack)
            q, at = np.nonzero(near <= edge[:, None])  # ties of the k-th stay
            for lo in range(0, len(q), 1 << 15):
                a, b = q[lo : lo + (1 << 15)], at[lo : lo + (1 << 15)]
                gap = queries[a] - x[b]
                best.add(a, np.einsum("ij,ij->i", gap, gap), fit[b], rows.column(0))
        kept = best.rows()
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in kept[0]]), kept[2], pa.array(kept[1])], names=["qid", "id", "distance"])

    return run


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "l2sq", block: int = QUERY_BLOCK) -> DataFrame:
    """qid, id, distance, score, rank: the k rows of corpus (id, vector) nearest to each of queries (qid, vector).

    Ties go to the smaller id; rows whose vector is null, not finite or of another length are left out.
    """
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, distance double"
    vectors = corpus.select("id", "vector")
    held = queries.filter("vector IS NOT NULL").select("qid", F.col("vector").cast("array<double>").alias("vector"))
    parts = []
    blocks = max(1, -(-held.count() // block))
    part = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    for i in range(blocks):
        rows = [r for r in (held if blocks == 1 else held.filter(part == i)).collect() if np.isfinite(np.array(r["vector"], dtype=np.float64)).all()]
        for dim in sorted({len(r["vector"]) for r in rows}):
            own = [r for r in rows if len(r["vector"]) == dim]
            parts.append(vectors.mapInArrow(_nearest_in_batch([r["qid"] for r in own], np.array([r["vector"] for r in own], dtype=np.float64), k), kinds))
    if not parts:
        parts = [vectors.limit(0).select(F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), "id", F.lit(0.0).alias("distance"))]
    found = reduce(DataFrame.unionByName, parts)
    if metric == "l2":
        found = found.withColumn("distance", F.sqrt("distance"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "id", "distance", similarity(F.col("distance")).alias("score"), "rank")


def vector_search(queries: DataFrame, chunks: DataFrame, limit: int = 10, min_score: float = 0.1, metric: str = "l2sq") -> DataFrame:
    """nearest() with the score filter applied after the top-k."""
    return nearest(queries, chunks, limit, metric).filter(F.col("score") >= min_score).drop("distance")
