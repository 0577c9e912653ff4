"""File listings, whole-file reads, and the JSON log sink.

Listings go through Spark's file sources, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.schema import INDEXED_FOLDERS, SKIPPED_DIRS

FILES = "path string, modified timestamp, content string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _glob(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that match something, for readers that fail on none."""
    out = []
    for pattern in patterns:
        p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if found is not None and len(found):
            out.append(pattern)
    return out


def _whole(reader_paths: list[str], spark: SparkSession, **options) -> DataFrame:
    if not reader_paths:
        return spark.createDataFrame([], FILES)
    read = spark.read
    for k, v in options.items():
        read = read.option(k, v)
    # wholetext must be the method's argument: as an option its default would win
    frame = read.text(reader_paths, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return frame.select(F.url_decode(path).alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("content"))


def numbered_lines(spark: SparkSession, patterns: list[str], below: str | None = None) -> DataFrame:
    """sessionFile, lineNumber (from 1), line of every line of the text files that the patterns match.

    Lines end with LF or CR LF.  The files are read in splits, so that a long log is many
    tasks' work and never one row: a line's number is its place in its split and the lines of
    the file's splits before it, which one pass over the files counts.  With below (a glob of
    names) the patterns are folders, whose files of such names at any depth are read: Spark lists
    them in tasks, where a pattern with a directory per log is walked on the driver, one by one.
    """
    found = _glob(spark, patterns)
    if not found:
        return spark.createDataFrame([], "sessionFile string, lineNumber long, line string")
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))
    # ids of a partition's rows are consecutive, and its splits come one after the other
    listing = {"recursiveFileLookup": True, "pathGlobFilter": below} if below else {}
    rows = spark.read.text(found, lineSep="\n", **listing).select(path.alias("sessionFile"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    splits = rows.groupBy("sessionFile", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("sessionFile").orderBy("_at")) - F.col("_lines")
    starts = splits.withColumn("_before", before).drop("_lines")  # one row per split
    return rows.join(starts, ["sessionFile", "_at"]).select("sessionFile", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("lineNumber"), "line")


def pi_lines(spark: SparkSession, folder: str) -> DataFrame:
    """numbered_lines() of what pi_sessions() lists."""
    return numbered_lines(spark, [f"{folder}/*/*.jsonl"])


def claude_lines(spark: SparkSession, folder: str) -> DataFrame:
    """numbered_lines() of what claude_sessions() lists."""
    return _without_subagents(numbered_lines(spark, [f"{folder}/*/*.jsonl", f"{folder}/*/*/*.jsonl"]), "sessionFile", folder)


def all_lines(spark: SparkSession, pi_folder: str | None, claude_folder: str | None = None) -> DataFrame:
    """numbered_lines() of both layouts."""
    none = numbered_lines(spark, [])
    return (pi_lines(spark, pi_folder) if pi_folder else none).unionByName(claude_lines(spark, claude_folder) if claude_folder else none)


def _without_subagents(files: DataFrame, path: str, folder: str) -> DataFrame:
    below = F.size(F.split(F.substring_index(path, folder.rstrip("/") + "/", -1), "/"))
    return files.filter(~F.element_at(F.split(path, "/"), -2).eqNullSafe("subagents") | (below == 2))


def pi_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, content of the JSONL files one directory below folder; none if it is missing."""
    return _whole(_glob(spark, [f"{folder}/*/*.jsonl"]), spark)


def claude_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """JSONL files one or two directories below folder, without those of `subagents`."""
    return _without_subagents(_whole(_glob(spark, [f"{folder}/*/*.jsonl", f"{folder}/*/*/*.jsonl"]), spark), "path", folder)


def all_sessions(spark: SparkSession, pi_folder: str | None, claude_folder: str | None = None) -> DataFrame:
    """Both layouts, by path; only the first where the second is None."""
    parts = [pi_sessions(spark, pi_folder)] if pi_folder else []
    parts += [claude_sessions(spark, claude_folder)] if claude_folder else []
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more).orderBy("path")
    return out


def sessions_by_source(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Sessions of one layout, `pi` or `claude`."""
    return pi_sessions(spark, folder) if source == "pi" else claude_sessions(spark, folder)


def note_files(spark: SparkSession, folder: str, folders: tuple[str, ...] | None = None) -> DataFrame:
    """*.org files at any depth by path, without the skipped directories; `folders` keeps only those note folders."""
    if not exists(spark, folder):
        return spark.createDataFrame([], FILES)
    found = _whole([folder], spark, recursiveFileLookup="true", pathGlobFilter="*.org")
    below = F.split(F.substring_index("path", folder.rstrip("/"), -1), "/")
    dirs = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    found = found.filter(~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIPPED_DIRS])))
    return (keep_folders(found, folders) if folders else found).orderBy("path")


def note_folder(path):
    """The segment after the first `org` segment of a path, else `unknown`."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "org").cast("int")
    return F.when(at > 0, F.coalesce(F.get(parts, at), F.lit("unknown"))).otherwise("unknown")


def keep_folders(files: DataFrame, folders: tuple[str, ...] = INDEXED_FOLDERS) -> DataFrame:
    return files.filter(note_folder(F.col("path")).isin(*folders))


def recent(files: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Files modified less than `hours` before as_of."""
    return files.filter(F.col("modified") > as_of - F.make_dt_interval(hours=F.lit(hours)))


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)
