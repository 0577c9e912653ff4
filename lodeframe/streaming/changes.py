"""Keeping a chunk table in step with folders: new, edited and removed files, sessions and notes.

The file stream of incremental.py takes each path once.  A tracked folder is listed at
each run and compared with what the last run saw: a file with another time or size
is read, and indexed again if its content's hash is another one too; a file that is
gone loses its rows.  What a run saw is a table of its own, STATE/run=N, written when
the chunk table is in step; a run that fails leaves the last one, and is repeated with the
same result.

Listings read no contents, and contents are read of changed files only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators.chunk_notes import as_chunks, note_chunks
from lodeframe.operators.chunk_sessions import extract_sessions
from lodeframe.operators.embed import Embedder
from lodeframe.plans import jobs
from lodeframe.plans.store import ChunkStore
from lodeframe.schema import INDEXED_FOLDERS, SKIPPED_DIRS
from lodeframe.sources.files import exists, keep_folders, remove

SEEN = "path string, modified timestamp, bytes long, hash string"
#: Changed files up to which their paths are given to the reader; of more, the folder is scanned.
LISTED_FILES = 5_000


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, modified, bytes of the files of a name pattern at any depth of folder; contents are not read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, modified timestamp, bytes long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def changed(now: DataFrame, seen: DataFrame) -> DataFrame:
    """path, change (new, modified or removed) between two listings (path, modified, bytes); equal files have no row."""
    old = seen.select("path", F.col("modified").alias("old_modified"), F.col("bytes").alias("old_bytes"), F.lit(True).alias("old"))
    both = now.select("path", "modified", "bytes", F.lit(True).alias("new")).join(old, "path", "full_outer")
    same = F.col("modified").eqNullSafe(F.col("old_modified")) & F.col("bytes").eqNullSafe(F.col("old_bytes"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(~same, "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def _shown(path):
    """A listed path as the readers of sources.files give it."""
    return F.url_decode(F.regexp_replace(path, "^file:/+", "/"))


def _contents(spark: SparkSession, folder: str, pattern: str, paths: DataFrame) -> DataFrame:
    """listed (the listing's path), path, content of some files (path) of a folder."""
    few = [r["path"] for r in paths.select("path").limit(LISTED_FILES + 1).collect()]
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").format("binaryFile")
    found = reader.load(few if len(few) <= LISTED_FILES else folder) if few else reader.load(folder).limit(0)
    own = found.select(F.col("path").alias("listed"), _shown(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return own if len(few) <= LISTED_FILES else own.join(paths.select(F.col("path").alias("listed")), "listed", "left_semi")


def _last(spark: SparkSession, state: str) -> tuple[int, DataFrame]:
    """Number of the last complete run, and what it saw."""
    if not exists(spark, state):
        return 0, spark.createDataFrame([], SEEN)
    runs = spark.read.schema(f"{SEEN}, run long").parquet(state)
    numbers = sorted((r[0] for r in runs.select("run").distinct().collect()), reverse=True)  # two at most
    last = next((n for n in numbers if exists(spark, f"{state}/run={n}/_SUCCESS")), 0)
    return last, runs.filter(F.col("run") == last).drop("run")


def _follow(store: ChunkStore, folder: str, pattern: str, keep: Callable[[DataFrame], DataFrame], chunks: Callable[[DataFrame], DataFrame], embedder: Embedder, state: str) -> dict:
    spark, state = store.spark, state.rstrip("/")
    store.ensure()
    run, seen = _last(spark, state)
    now = keep(listing(spark, folder, pattern))
    differ = changed(now, seen).join(now, "path", "left").persist()  # a row per changed file
    read = _contents(spark, folder, pattern, differ.filter("change <> 'removed'"))
    hashed = read.withColumn("hash", F.sha2(F.col("content"), 256))
    known = seen.select(F.col("path").alias("listed"), F.col("hash").alias("old_hash"))
    todo = hashed.join(known, "listed", "left").filter("old_hash IS NULL OR hash <> old_hash").select("listed", "path", "content")
    report = jobs.index_files(store, todo.select("path", "content"), chunks, embedder)
    # files that are gone, and edited ones that no chunk comes from any more
    empty = todo.select("path").join(chunks(todo.select("path", "content")).select(F.col("sessionFile").alias("path")).distinct(), "path", "left_anti")
    gone = differ.filter("change = 'removed'").select(_shown(F.col("path")).alias("path")).unionByName(empty).select(F.col("path").alias("sessionFile"))
    jobs.remove_files(store, gone.join(store.files(), "sessionFile", "left_semi"))
    fresh = differ.filter("change <> 'removed'").select("path", "modified", "bytes").join(hashed.select(F.col("listed").alias("path"), "hash"), "path")
    kept = seen.join(differ.select("path"), "path", "left_anti")
    kept.unionByName(fresh).write.mode("overwrite").parquet(f"{state}/run={run + 1}")
    remove(spark, f"{state}/run={run - 1}")
    counts = {r["change"]: r["count"] for r in differ.groupBy("change").count().collect()}
    differ.unpersist()
    return {k: counts.get(k, 0) for k in ("new", "modified", "removed")} | report


def follow_sessions(store: ChunkStore, folder: str, embedder: Embedder, state: str) -> dict:
    """Bring the store in step with *.jsonl files of folder, without `subagents`; counts of changes and of what was indexed."""
    keep = lambda files: files.filter(~F.contains("path", F.lit("/subagents/")))
    return _follow(store, folder, "*.jsonl", keep, extract_sessions, embedder, state)


def follow_notes(store: ChunkStore, folder: str, embedder: Embedder, state: str) -> dict:
    """Bring the store in step with *.org files of the indexed folders."""

    def keep(files):
        below = F.split(F.substring_index(_shown(F.col("path")), folder.rstrip("/"), -1), "/")
        dirs = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
        own = files.filter(~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIPPED_DIRS])))
        return keep_folders(own.withColumn("listed", F.col("path")).withColumn("path", _shown(F.col("path"))), INDEXED_FOLDERS).withColumn("path", F.col("listed")).drop("listed")

    return _follow(store, folder, "*.org", keep, lambda files: as_chunks(note_chunks(files)), embedder, state)
