"""Session files as a stream: each new file is chunked, embedded and upserted once.

The file source's checkpoint remembers what was read; a batch that is run again
replaces the same files, so the table ends the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodeframe.operators.chunk_sessions import extract_sessions
from lodeframe.operators.embed import Embedder, embed_documents
from lodeframe.plans.store import ChunkStore


def session_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """path, content of *.jsonl files at any depth of folder, without `subagents`, as they appear."""
    lines = (
        spark.readStream.schema("value string")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .format("text")
        .load(folder)
    )
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))
    return lines.select(path.alias("path"), F.col("value").alias("content")).filter(~F.contains("path", F.lit("/subagents/")))


def index_stream(spark: SparkSession, folder: str, store: ChunkStore, embedder: Embedder, checkpoint: str, available_now: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Start indexing folder into store; with available_now the query ends when all present files are in."""
    store.ensure()

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(embed_documents(extract_sessions(batch), embedder))

    writer = session_stream(spark, folder, files_per_batch).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
