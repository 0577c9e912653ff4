"""K-d tree sharding: recursive weighted medians along the widest metadata dimension.

Every dimension becomes a grid coordinate of 16 bits, so a dimension has a bounded
histogram whatever the table's size.  Each round, all nodes of a level are split at
once: one aggregation gives bytes by (node, dimension, coordinate); a node is split
along the dimension in which it is widest, at the coordinate where its bytes reach
the share of the shards on the left.  Rows on that coordinate are ordered by further
digits of 16 bits: of a hash of their text, of their id, and of the row itself.  A
digit is looked at only where the group on the cut is larger than `slack` of its
node's bytes, so equal texts stay together unless they must be parted to keep the
sizes near equal, and even rows that repeat id and text can be parted.  No node is
gathered anywhere: histograms leave the map side (at most 65,536 rows a node and
dimension), their running sums take two steps of 256 bins, and the driver holds one
row per node, which is at most one per shard.

Sizes are UTF-8 bytes plus 1.  Slots are gapless per shard, by range partitions of
(shard, doc_id, text, row).

Defined results: a null text has size 1 and, like the empty text, crc32 0.  Null
metadata takes the lowest coordinate.  Very long texts are rows like others; one
larger than a shard leaves sizes unequal.  Repeated rows stay, get slots of their own
and are interchangeable.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.ranges import positions
from lodeframe.llm.session import byte_size, ready

GRID = 1 << 16
SLACK = 0.002
#: Dimensions of documents: what the tree splits on, as numbers that grow with the value.
DIMENSIONS = ("size", "lang")


def _number(docs: DataFrame, name: str) -> Column:
    """A double that orders like the column: sizes by logarithm, strings by their first six bytes."""
    if name == "size":
        return F.log2(byte_size(F.col("text")) + 1.0)
    kind = docs.schema[name].dataType.simpleString()
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(name, F.lit("")), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind in ("timestamp", "date", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.coalesce(F.when(F.isnan(F.col(name).cast("double")), None).otherwise(F.col(name).cast("double")), F.lit(None).cast("double"))


def _grid(docs: DataFrame, names: tuple[str, ...], keep: list[Column]) -> DataFrame:
    """keep, c0, c1, ...: one coordinate per dimension, linear between its least and greatest value."""
    wide = docs.select(*keep, *[_number(docs, n).alias(f"v{i}") for i, n in enumerate(names)])
    ends = wide.agg(*[f(f"v{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i in range(len(names)):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or hi <= lo:
            out.append(F.lit(0).alias(f"c{i}"))
        else:
            place = F.floor((F.col(f"v{i}") - F.lit(float(lo))) / F.lit(float(hi - lo)) * (GRID - 2)).cast("int") + 1
            out.append(F.coalesce(place, F.lit(0)).alias(f"c{i}"))
    return wide.select(*[c for c in wide.columns if not c[0] == "v" or not c[1:].isdigit()], *out)


#: What orders rows in a split: the coordinate of the split's dimension, then hashes of text, id and row.
DIGITS = ("at", "h0", "h1", "d0", "u0", "u1")


def _crossing(sums: DataFrame, at: str, before: Column) -> DataFrame:
    """The row of each node where its running bytes, from `before` on, first reach its goal."""
    run = F.sum("bytes").over(Window.partitionBy("node").orderBy(at)) - F.col("bytes") + before
    return sums.withColumn("below", run).filter("below < goal AND below + bytes >= goal")


def _cuts(sums: DataFrame, at: str) -> dict[int, tuple[int, int, int]]:
    """node -> (value of `at` where its bytes first reach its goal, bytes below it, bytes on it)."""
    sums = sums.select("node", "goal", F.col(at).alias("at"), F.shiftright(at, 8).alias("bin"), "bytes").checkpoint()
    bins = _crossing(sums.groupBy("node", "goal", "bin").agg(F.sum("bytes").alias("bytes")), "bin", F.lit(0)).select("node", "bin", F.col("below").alias("start"))
    found = _crossing(sums.join(bins, ["node", "bin"]), "at", F.col("start"))
    return {r["node"]: (r["at"], r["below"], r["bytes"]) for r in found.collect()}


def kd_leaves(rows: DataFrame, n_dims: int, shards: int, slack: float = SLACK) -> DataFrame:
    """rows (size, h0, h1, d0, u0, u1, c0..) with `node`, the shard number."""
    spark = rows.sparkSession
    rows = rows.withColumn("node", F.lit(0).cast("int"))
    widths = {0: (0, shards)}  # node -> first shard, number of shards
    while any(k > 1 for _, k in widths.values()):
        split = {n: (first, k) for n, (first, k) in widths.items() if k > 1}
        live = rows.join(F.broadcast(spark.createDataFrame([(n,) for n in split], "node int")), "node")  # a row per node
        coords = F.posexplode(F.array(*[F.col(f"c{i}") for i in range(n_dims)])).alias("dim", "at")
        sums = live.select("node", "size", coords).groupBy("node", "dim", "at").agg(F.sum("size").alias("bytes")).checkpoint()
        widest: dict[int, tuple[int, int, int]] = {}
        for r in sums.groupBy("node", "dim").agg((F.max("at") - F.min("at")).alias("spread"), F.sum("bytes").alias("total")).collect():
            widest[r["node"]] = min(widest.get(r["node"], (1, 0, 0)), (-r["spread"], r["dim"], r["total"]))
        # node -> dimension, bytes wanted on the left, bytes of the node, digits known
        todo = {n: (dim, total * (split[n][1] // 2) / split[n][1], total, ()) for n, (_, dim, total) in widest.items()}
        moves = []
        for depth, digit in enumerate(DIGITS):
            if not todo:
                break
            goals = spark.createDataFrame([(n, dim, float(goal), *known) for n, (dim, goal, _, known) in todo.items()], "node int, dim int, goal double" + "".join(f", k_{x} int" for x in DIGITS[:depth]))
            if depth:
                place = F.get(F.array(*[F.col(f"c{i}") for i in range(n_dims)]), F.col("dim"))
                inside = rows.join(F.broadcast(goals), "node").withColumn("at", place)
                for x in DIGITS[:depth]:
                    inside = inside.filter(F.col(x) == F.col(f"k_{x}"))
                bytes_ = inside.groupBy("node", "goal", digit).agg(F.sum("size").alias("bytes"))
            else:
                bytes_ = sums.join(F.broadcast(goals), ["node", "dim"])
            for n, (cut, below, on) in _cuts(bytes_, digit).items():
                dim, goal, total, known = todo.pop(n)
                goal -= below
                if digit == DIGITS[-1] or min(goal, on - goal) <= slack * total:  # to the nearer edge of the group on the cut
                    cuts = (*known, cut + (2 * goal >= on))
                    moves.append((n, dim, *map(int, cuts), *[0] * (len(DIGITS) - len(cuts)), split[n][0] + split[n][1] // 2))
                else:
                    todo[n] = dim, goal, total, (*known, int(cut))
        to = spark.createDataFrame(moves, "node int, dim int" + "".join(f", k_{x} int" for x in DIGITS) + ", right int")
        order = F.struct(F.get(F.array(*[F.col(f"c{i}") for i in range(n_dims)]), F.col("dim")).alias("at"), *DIGITS[1:])
        right = F.col("right").isNotNull() & (order >= F.struct(*[F.col(f"k_{x}").alias(x) for x in DIGITS]))
        rows = rows.join(F.broadcast(to), "node", "left").withColumn("node", F.when(right, F.col("right")).otherwise(F.col("node"))).select(*rows.columns).checkpoint()  # a row per node
        for n, *_ in moves:
            a, k = split[n]
            widths[n] = (a, k // 2)
            widths[a + k // 2] = (a + k // 2, k - k // 2)
        for n in split.keys() - {x[0] for x in moves}:
            widths[n] = (widths[n][0], 1)  # nothing left to cut
    return rows


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs.

    Leaves are counted from `shards`, or from the total over `target_bytes`.
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def digit(value: Column, place: int) -> Column:
        return F.shiftrightunsigned(value, 16 * place).bitwiseAND(F.lit(GRID - 1)).cast("int")

    texts, row = F.xxhash64(text), F.xxhash64(F.monotonically_increasing_id())
    keep = [F.col("doc_id"), (byte_size(F.col("text")) + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")]
    keep += [digit(texts, 0).alias("h0"), digit(texts, 1).alias("h1"), digit(F.xxhash64("doc_id", F.lit(7)), 0).alias("d0"), digit(row, 0).alias("u0"), digit(row, 1).alias("u1")]
    rows = _grid(docs, dimensions, keep).checkpoint()
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, ceil(total / target_bytes))
    leaves = kd_leaves(rows, len(dimensions), shards) if total else rows.withColumn("node", F.lit(0))
    leaves = leaves.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), "row")
    placed = positions(leaves, "shard", [F.col(c) for c in ("doc_id", "text_crc32", "size", "row")], "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_table(docs: DataFrame, shards: int) -> DataFrame:
    """The thin form with the balance law: sizes in bytes near equal."""
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
