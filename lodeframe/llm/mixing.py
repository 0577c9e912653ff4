"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of doc_id.  A source's target in
words becomes a quota of block draws: as many passes over all its blocks as the
target holds, then blocks of one more pass, in permuted order, until the target is
reached; the last block is taken in part, up to the document nearest the target.
The quotas of all sources are split exactly among the output shards by a binary
tree: at each node, the draws that go left are multivariate-hypergeometric given
the node's counts.  Every shard then takes the next draws of each source's permuted
blocks, so shards share no draw, and shuffles its documents by a hash of its own.

Per source the driver holds one total and one count per shard (sources are kinds of
origin, thousands at most; a column of urls is not one), and blocks are aggregated
before any shuffle; a source of a third of all rows is spread over BLOCKS blocks.

Defined results: doc_id is of any type with an order.  Very long texts are rows like others, so that a target may be missed by
half of one.  A null text has no words; documents without words are taken like
their block and add nothing.  A null source is a source, ordered last.  Rows that
repeat an id, or have none and repeat a text, are taken together or not.  An empty table gives no rows.  Extra
columns, whatever their names, are ignored by mix_table() and kept by mix().
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.session import ready, word_count
from lodeframe.sources.spread import spread

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
BLOCKS = 1024
SHARDS = 64
SEED = 17
#: Largest table of block draws that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """Words per source: `share` of all words by weight, none above `most` times its size."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    caps = most * np.array(sizes, dtype=float)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    left = share * float(sum(sizes))
    while free.any():
        out[free] = left * w[free] / w[free].sum()
        above = free & (out > caps)
        if not above.any():
            break
        out[above] = caps[above]
        left = max(0.0, left - caps[above].sum())
        free &= ~above
    return out.tolist()


def split_quotas(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) counts that add up to the quotas; shard totals differ by one at most."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = int(sum(quotas))
    room = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    todo = [(0, shards, np.array(quotas, dtype=np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(have, sum(room[a:mid]), method="marginals")
        todo += [(a, mid, left), (mid, b, have - left)]
    return out


def _keys(docs: DataFrame) -> list[Column]:
    # rows without an id are told apart by their text
    row = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))]
    return [
        F.col("source").isNull().alias("mix_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_name"),
        F.pmod(F.xxhash64(*row, F.lit(SEED)), F.lit(BLOCKS)).cast("int").alias("mix_block"),
        F.xxhash64(*row, F.lit(SEED + 1)).alias("mix_hash"),
    ]


_AT = ["mix_null", "mix_name", "mix_block"]


def plan(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> tuple[DataFrame, DataFrame, int]:
    """(rows, draws, number of draws rows): sized rows, and per source block its draws.

    rows: doc_id, size, mix_null, mix_name, mix_block, mix_hash.
    draws: the block, source_size, target, mix_draws: array of (pass, shard, cut_hash, cut_id), cut null for a whole block.
    """
    spark = ready(docs.sparkSession)
    rows = spread(docs.select("doc_id", "text", "source")).select("doc_id", word_count(F.col("text").cast("string")).alias("size"), *_keys(docs)).checkpoint()
    blocks = rows.groupBy(*_AT).agg(F.sum("size").alias("words")).checkpoint()
    sources = blocks.groupBy("mix_null", "mix_name").agg(F.sum("words").alias("words"), F.count("*").alias("blocks")).collect()
    sources.sort(key=lambda r: (r["mix_null"], r["mix_name"].encode()))
    goals = targets([r["words"] for r in sources], weights, share, most)
    table, quota_of = [], []
    for r, goal in zip(sources, goals):
        passes = int(goal // r["words"]) if r["words"] else 0
        table.append((r["mix_null"], r["mix_name"], int(r["words"]), float(goal), passes, float(goal - passes * r["words"]), int(r["blocks"])))
    known = spark.createDataFrame(table, "mix_null boolean, mix_name string, source_size long, target double, passes int, rest double, blocks long")
    each = blocks.join(known, ["mix_null", "mix_name"]).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    order = Window.partitionBy("mix_null", "mix_name", "pass").orderBy(F.xxhash64("mix_block", "pass", F.lit(SEED + 2)), "mix_block")
    each = each.withColumn("place", F.row_number().over(order) - 1).withColumn("below", F.sum("words").over(order) - F.col("words"))
    each = each.withColumn("whole", (F.col("pass") < F.col("passes")) | ((F.col("rest") > 0) & (F.col("below") + F.col("words") <= F.col("rest"))))
    each = each.filter(F.col("whole") | (F.col("below") < F.col("rest"))).withColumn("draw", F.col("pass") * F.col("blocks") + F.col("place")).checkpoint()
    # the part of each source's last block: documents in hash order, up to the nearest to the rest
    partial = each.filter(~F.col("whole")).select(*_AT, (F.col("rest") - F.col("below")).alias("wanted"))
    inside = rows.join(F.broadcast(partial), _AT).withColumn("bin", F.shiftright("mix_hash", 48))  # one row per source at most
    # bins of the hash first, so that only the rows of one bin of 65,536 meet in a task
    before = F.sum("words").over(Window.partitionBy(*_AT).orderBy("bin")) - F.col("words")
    bins = inside.groupBy(*_AT, "wanted", "bin").agg(F.sum("size").alias("words")).withColumn("start", before)
    bins = bins.filter("start <= wanted").groupBy(*_AT).agg(F.max(F.struct("bin", "start")).alias("last")).select(*_AT, "last.bin", "last.start")
    inside = inside.join(F.broadcast(bins), [*_AT, "bin"])  # one row per source at most
    run = F.sum("size").over(Window.partitionBy(*_AT).orderBy("mix_hash", "doc_id")) - F.col("size") + F.col("start")
    cuts = inside.withColumn("below", run).filter(F.col("wanted") - F.col("below") >= F.col("size") / 2).groupBy(*_AT).agg(F.max(F.struct("mix_hash", "doc_id")).alias("cut"))
    none = F.struct(F.shiftleft("bin", 48).alias("mix_hash"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"))  # the bins before it only
    cuts = bins.join(cuts, _AT, "left").select(*_AT, F.coalesce("cut", none).alias("cut"))
    drawn = {(r["mix_null"], r["mix_name"]): r["n"] for r in each.groupBy("mix_null", "mix_name").agg(F.count("*").alias("n")).collect()}
    split = split_quotas([drawn.get((r["mix_null"], r["mix_name"]), 0) for r in sources], shards) if sources else np.zeros((shards, 0), dtype=np.int64)
    ends = np.cumsum(split, axis=0)
    bounds = spark.createDataFrame([(r["mix_null"], r["mix_name"], ends[:, i].tolist()) for i, r in enumerate(sources)], "mix_null boolean, mix_name string, ends array<long>")
    # draws of a source are gapless in `draw`, so its shard is the number of ends at or below it
    placed = each.join(bounds, ["mix_null", "mix_name"]).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("draw"))))
    placed = placed.join(cuts, _AT, "left")
    one = F.struct("pass", "shard", "whole", F.when(~F.col("whole"), F.col("cut.mix_hash")).alias("cut_hash"), F.when(~F.col("whole"), F.col("cut.doc_id")).alias("cut_id"))
    draws = placed.groupBy(*_AT).agg(F.sort_array(F.collect_list(one)).alias("mix_draws"))  # at most `most` + 1 entries
    draws = blocks.join(known, ["mix_null", "mix_name"]).select(*_AT, "source_size", "target").join(draws, _AT, "left").checkpoint()
    return rows, draws, sum(r["blocks"] for r in sources)


def _taken(draws: DataFrame) -> Column:
    """The draws of the row's block that take the row."""

    def takes(d):
        before = (F.col("mix_hash") < d["cut_hash"]) | ((F.col("mix_hash") == d["cut_hash"]) & ((F.col("doc_id") <= d["cut_id"]) | F.col("doc_id").isNull()))
        return d["whole"] | F.coalesce(before, F.lit(False))

    return F.filter(F.coalesce("mix_draws", F.array().cast(draws.schema["mix_draws"].dataType)), takes)


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, shards for every row of docs."""
    rows, draws, _ = plan(docs, **options)
    joined = rows.join(draws, _AT).withColumn("mix_taken", _taken(draws))
    copies = F.size("mix_taken").cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.transform("mix_taken", lambda d: d["shard"]).alias("shards"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, once per draw, with mix_shard and mix_order (a shard's local shuffle).

    Where docs has columns of these names, the new ones get a leading underscore.
    """
    _, draws, n = plan(docs, **options)
    draws = draws.select(*_AT, "mix_draws")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("mix_id"), *_keys(docs)).select("row", F.col("mix_id").alias("doc_id"), *_AT, "mix_hash")
    out = keyed.join(F.broadcast(draws) if n <= BROADCAST_ROWS else draws, _AT).select("row", "mix_hash", F.explode(_taken(draws)).alias("draw"))
    shard, order = ("_" * any(c.lower() == name for c in docs.columns) + name for name in ("mix_shard", "mix_order"))
    return out.select("row.*", F.col("draw.shard").alias(shard), F.xxhash64("mix_hash", "draw.pass", "draw.shard").alias(order))


def write_mix(docs: DataFrame, path: str, parts_per_shard: int = 8, **options) -> None:
    """Write the mix as one folder per shard, rows in the shard's shuffled order."""
    mixed = mix(docs, **options)
    part = F.pmod(F.col("mix_order"), F.lit(parts_per_shard))
    mixed.repartition("mix_shard", part).sortWithinPartitions("mix_shard", "mix_order").drop("mix_order").write.partitionBy("mix_shard").parquet(path)
