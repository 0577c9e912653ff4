"""Order-dependent steps over range partitions: no key, however frequent, meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_last(events: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """events with `out`: the last non-null `value` up to the row, in `order`, of rows with equal `keys`.

    Rows are dealt out by ranges of (keys, order); what a partition must know of the
    ones before it is one row per partition: the last value of their last key.
    `order` should tell all rows apart that must not land by chance.
    """
    swept = events.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("one"))
    at = F.struct(*order)
    ends = swept.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    # the last value of a partition's last key
    told = swept.filter(F.col(value).isNotNull()).groupBy("_part").agg(F.max(F.struct(key.alias("key"), at.alias("at"), F.col(value).alias("value"))).alias("last"))
    borders = ends.join(told, "_part", "left").select(
        F.explode(
            F.array(
                F.struct(F.col("low").alias("key"), F.col("_part"), F.lit(0).alias("step"), F.lit(None).cast(swept.schema[value].dataType).alias("value")),
                F.struct(F.col("high").alias("key"), F.col("_part"), F.lit(1).alias("step"), F.when(F.col("last.key") == F.col("high"), F.col("last.value")).alias("value")),
            )
        ).alias("b")
    )
    before = Window.partitionBy("b.key").orderBy("b._part", "b.step").rowsBetween(Window.unboundedPreceding, -1)
    entries = borders.select("b._part", "b.step", F.col("b.key").alias("_key"), F.last("b.value", ignorenulls=True).over(before).alias("_entry")).filter("step = 0").select("_part", "_key", "_entry")
    running = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = swept.withColumn("_here", F.last(value, ignorenulls=True).over(running))
    found = here.join(F.broadcast(entries), "_part")  # one row per partition
    return found.withColumn(out, F.coalesce("_here", F.when(key.eqNullSafe(F.col("_key")), F.col("_entry")))).drop("_part", "_here", "_key", "_entry")


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with `out`: gapless from 0 in `order`, ties in any order."""
    spark = rows.sparkSession
    swept = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = sorted((r["p"], r["n"]) for r in swept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row per partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    offset = F.broadcast(spark.createDataFrame(offsets, "_p long, _offset long"))  # one row per partition
    return swept.join(offset, part == F.col("_p")).withColumn(out, F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_p", "_offset")


def positions(rows: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """rows with `out`: gapless from 0 in `order` within each group, ties in any order."""
    placed = numbered(rows, [F.col(group), *order], "_at")
    # checkpointed: an aggregation right below a join on its key would keep AQE from splitting a large group
    starts = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first")).checkpoint()
    return placed.join(starts, F.col(group).eqNullSafe(F.col("_group"))).withColumn(out, F.col("_at") - F.col("_first")).drop("_at", "_group", "_first")
