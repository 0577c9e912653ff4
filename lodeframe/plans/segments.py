"""The full-text index of a chunk table in segments: an upsert adds one and reads no old text.

    PATH/postings/segment=N/bucket=B   term, id, file, tf, length of the chunks of segment N
    PATH/chunks/segment=N              id, file, length
    PATH/files/segment=N               files whose rows are those of segment N, or none (a tombstone)

A file's rows are those of the last segment that names it; document frequencies and
lengths are counted over these at read.  A segment is written under its number, files
last, so a write that is repeated replaces itself and a part of one is never read.
compact() folds all segments into one from their postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.text import tokens
from lodeframe.operators.bm25 import TextIndex
from lodeframe.sources.files import exists, remove
from lodeframe.sources.spread import spread

_POSTINGS = "term string, id string, file string, tf long, length int, bucket int, segment long"
_CHUNKS = "id string, file string, length int, segment long"
_FILES = "file string, segment long"


class TextSegments:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def covers(self, number: int) -> bool:
        """Whether segment `number` was written to its end."""
        return exists(self.spark, f"{self.path}/files/segment={number}/_SUCCESS")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _write(self, number: int, postings: DataFrame, chunks: DataFrame, files: DataFrame) -> None:
        order = ["bucket", "term", "id"]
        laid = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        chunks.write.mode("overwrite").parquet(f"{self.path}/chunks/segment={number}")
        files.write.mode("overwrite").parquet(f"{self.path}/files/segment={number}")

    def add(self, number: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Segment `number` of rows (id, sessionFile, text); gone: further files (sessionFile) that have no rows any more."""
        rows = spread(rows.select("id", F.col("sessionFile").alias("file"), "text"))
        counted = rows.select("id", "file", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words")).withColumn("length", F.size("words"))
        said = counted.select("id", "file", "length", F.explode_outer("words").alias("term")).filter("term IS NOT NULL")
        postings = said.groupBy("term", "id", "file", "length").agg(F.count("*").alias("tf")).select("term", "id", "file", "tf", "length")
        files = rows.select("file")
        if gone is not None:
            files = files.unionByName(gone.select(F.col("sessionFile").alias("file")))
        self._write(number, postings, counted.select("id", "file", "length"), files.distinct())

    def current(self) -> tuple[DataFrame, DataFrame]:
        """Postings and chunks as they stand."""
        last = self._read("files", _FILES).groupBy("file").agg(F.max("segment").alias("segment"))
        return tuple(self._read(name, schema).join(last, ["file", "segment"], "left_semi") for name, schema in (("postings", _POSTINGS), ("chunks", _CHUNKS)))

    def index(self) -> TextIndex:
        postings, chunks = self.current()
        terms = postings.groupBy("term").agg(F.count("*").alias("df"))
        totals = chunks.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
        return TextIndex(postings.select("term", "id", "tf", "length", "bucket"), terms, totals, buckets=self.buckets)

    def count(self) -> int:
        """Number of segments."""
        return self._read("files", _FILES).select("segment").distinct().count()

    def rebuild(self, number: int, rows: DataFrame) -> None:
        """All segments replaced by one of rows (id, sessionFile, text)."""
        remove(self.spark, self.path)
        self.add(number, rows)

    def compact(self, number: int) -> None:
        """One segment, `number`, of all there is: a later number than any; earlier ones are removed then."""
        postings, chunks = self.current()
        files = self._read("files", _FILES).groupBy("file").agg(F.max("segment").alias("segment"))
        old = [r[0] for r in self._read("files", _FILES).select("segment").distinct().collect()]
        if any(n >= number for n in old):
            raise ValueError(f"{self.path}: segment {number} is not the last")
        self._write(number, postings.select("term", "id", "file", "tf", "length"), chunks.select("id", "file", "length"), files.select("file"))
        for n in old:
            for name in ("files", "chunks", "postings"):
                remove(self.spark, f"{self.path}/{name}/segment={n}")
