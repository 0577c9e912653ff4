"""Incremental search index of conversations.

    python -m jobs.session_index --conversations IN --out OUT --checkpoint CHECKPOINT [--config FILE]

A file stream takes the Parquet files of conversations (conv_id, turn, role, text) that
came since the last run, in micro-batches of a bounded number of files, and ends when
there are no more.  Each batch becomes an immutable segment of the index:

    OUT/lines/batch=N/kept=..      every line read: conv_id, turn, role, text, length
    OUT/postings/batch=N/bucket=.. term, conv_id, turn, tf, length of the kept ones, sorted by term
    OUT/runs/batch=N               what the batch read and wrote

Lines are kept by the rules of session chunks (role and length; long texts are cut).
A line that a later batch brings again replaces the earlier one, also where the new
text is not kept: the segment's row for it is its tombstone.  Repeats within a batch
stay.  Nothing that was written is rewritten; `lines` and `postings` of this module
read the segments as one, and `index` gives them to the library's text search.

Safe to rerun: the checkpoint tells which files a batch has, and a batch that is
repeated after a failure overwrites its own partitions only.  A run without new
files writes nothing.  Null ids and texts are lines like others (a null text is not
kept); an empty input gives empty tables.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, log, settings, table
from lodeframe.functions.text import tokens, truncate
from lodeframe.operators.bm25 import TextIndex
from lodeframe.operators.chunk_sessions import TEXT_MAX, keeps_message
from lodeframe.sources.spread import spread

DEFAULTS = {"text_max": TEXT_MAX, "files_per_batch": 1000, "term_buckets": 16}
SOURCE = "conv_id long, turn long, role string, text string"
LINES = "conv_id long, turn long, role string, text string, length int, batch long, kept boolean"
POSTINGS = "term string, conv_id long, turn long, tf long, length int, batch long, bucket int"
RUNS = "read long, kept long, postings long, conversations long, batch long"


def _write(frame: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions of path that frame has rows of."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _segment(batch: DataFrame, number: int, out: str, config: dict) -> None:
    spark = batch.sparkSession
    read, wrote = Observation(), Observation()
    text = F.when(keeps_message(F.col("role"), F.col("text")), truncate(F.col("text"), config["text_max"]))
    rows = spread(batch).select("conv_id", "turn", "role", text.alias("text"))
    rows = rows.withColumn("length", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)))
    rows = rows.withColumns({"batch": F.lit(number), "kept": F.col("text").isNotNull()})
    _write(rows.observe(read, F.count("*").alias("read"), F.count_if("kept").alias("kept")), f"{out}/lines", "batch", "kept")
    if not read.get["read"]:
        return
    kept = table(spark, f"{out}/lines", LINES).filter((F.col("batch") == number) & F.col("kept"))
    # a line is told from its repeats within the batch, so that each has its own frequencies
    told_apart = kept.select("conv_id", "turn", "length", F.monotonically_increasing_id().alias("line"), "text")
    said = told_apart.select("conv_id", "turn", "length", "line", F.explode_outer(tokens(F.col("text"))).alias("term")).filter("term IS NOT NULL")
    postings = said.groupBy("line", "conv_id", "turn", "length", "term").agg(F.count("*").alias("tf"))
    postings = postings.select("term", "conv_id", "turn", "tf", "length", F.lit(number).alias("batch"), F.pmod(F.xxhash64("term"), F.lit(config["term_buckets"])).cast("int").alias("bucket"))
    # ranges within the buckets: neither a bucket nor a frequent term is one task's
    laid = postings.repartitionByRange("bucket", "term", "conv_id", "turn").sortWithinPartitions("bucket", "term", "conv_id", "turn")
    _write(laid.observe(wrote, F.count("*").alias("postings")), f"{out}/postings", "batch", "bucket")
    conversations = table(spark, f"{out}/lines", LINES).filter(F.col("batch") == number).select("conv_id").distinct().count()
    told = (read.get["read"], read.get["kept"], wrote.get.get("postings", 0), conversations, number)
    _write(spark.createDataFrame([told], RUNS), f"{out}/runs", "batch")
    log.info("batch %d: read %d lines of %d conversations; kept %d, wrote %d postings to %s", number, told[0], told[3], told[1], told[2], out)


def run(spark: SparkSession, conversations: str, out: str, checkpoint: str, config: str | None = None) -> int:
    """Index what is new under `conversations`; the number of lines read by this run."""
    chosen, out = settings(spark, config, DEFAULTS), out.rstrip("/")
    path = conversations.rstrip("/")
    seen = table(spark, f"{out}/runs", RUNS).agg(F.coalesce(F.sum("read"), F.lit(0))).first()[0]
    # as a pattern the path may be one file as well as a folder
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", chosen["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: _segment(batch, number, out, chosen))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    total = table(spark, f"{out}/runs", RUNS).agg(F.coalesce(F.sum("read"), F.lit(0)), F.coalesce(F.sum("postings"), F.lit(0)), F.count("*")).first()
    log.info("run ended: %d new lines of %s; %s holds %d lines and %d postings in %d segments", total[0] - seen, conversations, out, total[0], total[1], total[2])
    return total[0] - seen


def _latest(frame: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of frame of the last batch that brought their line."""
    newest = lines.groupBy("conv_id", "turn").agg(F.max("batch").alias("last"))
    same = frame["conv_id"].eqNullSafe(newest["conv_id"]) & frame["turn"].eqNullSafe(newest["turn"]) & (frame["batch"] == newest["last"])
    return frame.join(newest, same, "left_semi")


def lines(spark: SparkSession, out: str) -> DataFrame:
    """conv_id, turn, role, text, length, batch of the kept lines as they stand."""
    every = table(spark, f"{out}/lines", LINES)
    last = F.max("batch").over(Window.partitionBy("conv_id", "turn"))
    return every.withColumn("last", last).filter((F.col("batch") == F.col("last")) & F.col("kept")).drop("last", "kept")


def postings(spark: SparkSession, out: str) -> DataFrame:
    """term, conv_id, turn, tf, length, bucket of the lines as they stand: segments merged, tombstones applied."""
    return _latest(table(spark, f"{out}/postings", POSTINGS), table(spark, f"{out}/lines", LINES)).drop("batch")


def index(spark: SparkSession, out: str) -> TextIndex:
    """The segments as an index for bm25.text_search; ids are `conv_id:turn`."""
    now, said = lines(spark, out), postings(spark, out)
    entries = said.select("term", F.concat_ws(":", "conv_id", "turn").alias("id"), "tf", "length")
    return TextIndex(entries, said.groupBy("term").agg(F.count("*").alias("df")), now.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length")))


def main() -> None:
    parser = argparse.ArgumentParser(prog="jobs.session_index", description="Incremental search index of conversations")
    for name in ("conversations", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    command_line(parser, lambda spark, given: run(spark, **given))


if __name__ == "__main__":
    main()
