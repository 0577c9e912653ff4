"""Session helpers: checkpoint folder, Arrow batch size, word counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of texts: bounds a Python worker's memory.
TEXT_BATCH_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded size; a checkpoint folder from spark.checkpoint.dir.

    Only where that setting is absent and the master is local, as in a test, a temporary
    folder is used: on a cluster it would be one machine's own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodeframe-checkpoint-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def stored(frame: DataFrame) -> DataFrame:
    """frame, written once as Parquet to the checkpoint folder and read back.

    Smaller than checkpoint() for wide results, and as safe against lost executors.
    """
    spark = ready(frame.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables of stored() that nothing depends on any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
