"""The chunk table on plain Parquet, with atomic replacement per file.

Rows lie in hash buckets of their sessionFile.  A manifest names, per bucket, the
folder that holds its current rows; an upsert rewrites only the buckets of the files
it brings, into new folders, and then publishes the next manifest by a rename that
fails if there is one of that number: of two writers one gets a StoreConflict.  Readers
see the manifest of before or after, never a part of a write, and the folders of old
manifests stay for a time.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.schema import CHUNK, CHUNK_COLUMNS
from lodeframe.sources.files import exists


#: Rows that one task writes, and that a file holds at most.
TASK_ROWS = 500_000


def replaced(rows: DataFrame, fresh: DataFrame, key: str = "sessionFile") -> DataFrame:
    """rows without those of any file in fresh, and fresh."""
    return rows.join(fresh.select(key).distinct(), key, "left_anti").select(rows.columns).unionByName(fresh)


class StoreConflict(RuntimeError):
    """Another writer published the next version first; the write may be repeated."""


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, dim: int, buckets: int = 64):
        self.spark, self.path, self.dim, self.buckets = spark, path.rstrip("/"), dim, buckets
        self.published: int | None = None  # number of the last manifest that this object wrote

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        """Paths of the manifests, oldest first."""
        p, fs = self._fs(f"{self.path}/manifest-*.json")
        return sorted(x.getPath().toString() for x in fs.globStatus(p) or [])

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"number": 0, "buckets": self.buckets, "folders": {}}
        return json.loads(self.spark.read.text(versions[-1], wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        """Make the manifest, read before as another one's successor, current; fails if a writer was faster."""
        manifest["number"] += 1
        target, fs = self._fs(f"{self.path}/manifest-{manifest['number']:012d}.json")
        draft, _ = self._fs(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, target, options)
        except Exception as e:
            fs.delete(draft, False)
            raise StoreConflict(f"{self.path}: version {manifest['number']} was written by another writer") from e
        self.published = manifest["number"]

    def digest(self) -> str:
        """A name for the current state of the rows."""
        return hashlib.sha1(json.dumps(self.manifest(), sort_keys=True).encode()).hexdigest()

    def exists(self) -> bool:
        return bool(self._versions())

    def ensure(self) -> ChunkStore:
        """Create the table if there is none."""
        if not self.exists():
            self._publish({"number": 0, "buckets": self.buckets, "folders": {}})
        return self

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The current rows, of some buckets or all."""
        folders = self.manifest()["folders"]
        paths = [f for b, f in folders.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], CHUNK)
        return self.spark.read.schema(CHUNK).parquet(*[f"{self.path}/{p}" for p in paths])

    def _bucket(self, count: int):
        return F.pmod(F.xxhash64("sessionFile"), F.lit(count)).cast("int")

    def _write(self, rows: DataFrame, n: int, buckets: int, version: str) -> None:
        """Write rows with `bucket` below a version; a bucket of many rows is written by several tasks."""
        tasks = max(1, -(-n // max(1, buckets) // TASK_ROWS))
        dealt = rows.repartition(buckets * tasks, "bucket", F.pmod(F.xxhash64("id"), F.lit(tasks)))
        dealt.write.option("maxRecordsPerFile", TASK_ROWS).partitionBy("bucket").parquet(f"{self.path}/{version}")

    def upsert(self, chunks: DataFrame) -> int:
        """Replace the rows of every file that chunks bring; the number of rows written."""
        manifest = self.ensure().manifest()
        count = manifest["buckets"]
        version = f"data/{uuid.uuid4().hex}"
        staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
        chunks.select(CHUNK_COLUMNS).withColumn("bucket", self._bucket(count)).write.parquet(staged)
        fresh = self.spark.read.schema(f"{CHUNK}, bucket int").parquet(staged)
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most `buckets`
        if touched:
            old = self.rows(touched).select(CHUNK_COLUMNS).withColumn("bucket", self._bucket(count))
            self._write(replaced(old, fresh), old.count() + fresh.count(), len(touched), version)
            manifest["folders"].update({str(b): f"{version}/bucket={b}" for b in touched})
            self._publish(manifest)
        n = fresh.count()
        p, fs = self._fs(staged)
        fs.delete(p, True)
        return n

    def delete_files(self, files: DataFrame) -> None:
        """Remove the rows of files (sessionFile)."""
        manifest = self.manifest()
        gone = files.select("sessionFile").distinct()
        touched = sorted(r[0] for r in gone.select(self._bucket(manifest["buckets"]).alias("b")).distinct().collect() if str(r[0]) in manifest["folders"])
        if touched:
            version = f"data/{uuid.uuid4().hex}"
            kept = self.rows(touched).join(gone, "sessionFile", "left_anti").select(CHUNK_COLUMNS)
            self._write(kept.withColumn("bucket", self._bucket(manifest["buckets"])), self.rows(touched).count(), len(touched), version)
            for b in touched:
                if exists(self.spark, f"{self.path}/{version}/bucket={b}"):
                    manifest["folders"][str(b)] = f"{version}/bucket={b}"
                else:
                    del manifest["folders"][str(b)]
            self._publish(manifest)

    def count(self) -> int:
        return self.rows().count()

    def files(self) -> DataFrame:
        """The distinct files that have rows."""
        return self.rows().select("sessionFile").distinct()

    def reset(self) -> ChunkStore:
        p, fs = self._fs(self.path)
        fs.delete(p, True)
        return self.ensure()

    def size(self) -> tuple[int, int]:
        """(data files, bytes) of the current rows."""
        n = total = 0
        for folder in self.manifest()["folders"].values():
            p, fs = self._fs(f"{self.path}/{folder}")
            for s in fs.listStatus(p):
                if s.getPath().getName().endswith(".parquet"):
                    n, total = n + 1, total + s.getLen()
        return n, total

    def compact(self, keep_hours: float = 24.0) -> dict:
        """Rewrite every bucket into few files; counts before and after.

        Versions that are no longer current stay for `keep_hours`, for readers that have begun.
        """
        manifest, (files_before, bytes_before) = self.manifest(), self.size()
        rows = self.rows()
        n = rows.count()
        if n:
            version = f"data/{uuid.uuid4().hex}"
            keyed = rows.select(CHUNK_COLUMNS).withColumn("bucket", self._bucket(manifest["buckets"]))
            self._write(keyed, n, max(1, len(manifest["folders"])), version)
            manifest["folders"] = {str(r[0]): f"{version}/bucket={r[0]}" for r in keyed.select("bucket").distinct().collect()}
            self._publish(manifest)
        self._expire({f.split("/")[1] for f in self.manifest()["folders"].values()}, keep_hours)
        files_after, bytes_after = self.size()
        return {"rows": n, "files_before": files_before, "files_after": files_after, "bytes_before": bytes_before, "bytes_after": bytes_after}

    def _expire(self, current: set[str], keep_hours: float) -> None:
        """Remove manifests but the last, and version folders that it does not name, once they are old enough."""
        oldest = (time.time() - keep_hours * 3600) * 1000
        paths = [self._fs(v) for v in self._versions()[:-1]]
        p, fs = self._fs(f"{self.path}/data")
        if fs.exists(p):
            paths += [(s.getPath(), fs) for s in fs.listStatus(p) if s.getPath().getName() not in current]
        for p, fs in paths:
            if fs.getFileStatus(p).getModificationTime() <= oldest:
                fs.delete(p, True)


def unindexed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (path, ...) that no indexed row (sessionFile) comes from."""
    return files.join(indexed.select(F.col("sessionFile").alias("path")), "path", "left_anti")


def to_reindex(files: DataFrame, indexed: DataFrame, as_of, current: str | None = None, hours: int = 24) -> DataFrame:
    """Files not indexed, or modified within `hours` of as_of, or of the current session; each once."""
    recent = F.col("modified") > as_of - F.make_dt_interval(hours=F.lit(hours))
    stem = current.split("/")[-1].split(".")[0] if current else ""
    also = recent | F.contains("path", F.lit(stem)) if stem else recent
    marked = files.join(indexed.select(F.col("sessionFile").alias("path")).distinct().withColumn("known", F.lit(True)), "path", "left")
    return marked.filter(F.col("known").isNull() | also).drop("known")
