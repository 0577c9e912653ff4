"""Indexing jobs: sessions, notes, reindexing after a session, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators.bm25 import TextIndex
from lodeframe.operators.chunk_notes import as_chunks, note_chunks
from lodeframe.operators.chunk_sessions import extract_sessions, said_lines, session_chunks
from lodeframe.operators.embed import RETRY_BATCH, Embedder, embed_documents
from lodeframe.plans.segments import TextSegments
from lodeframe.plans.store import ChunkStore, to_reindex, unindexed
from lodeframe.schema import INDEXED_FOLDERS
from lodeframe.sources.files import note_files


def _segments(store: ChunkStore) -> TextSegments:
    return TextSegments(store.spark, f"{store.path}/fts")


def build_text_index(store: ChunkStore) -> None:
    """Write the full-text index of all current rows anew, as one segment."""
    _segments(store).rebuild(store.manifest()["number"], store.rows().select("id", "sessionFile", "text"))


def _follow(store: ChunkStore, fresh: DataFrame, gone: DataFrame | None = None) -> None:
    """Take the store's last write into its index: a segment of its rows, or all rows where the one before was not indexed."""
    segments = _segments(store)
    if segments.covers(store.published - 1):
        segments.add(store.published, fresh, gone)
    else:
        build_text_index(store)


def text_index(store: ChunkStore) -> TextIndex | None:
    """The stored index if it is that of the current rows."""
    segments = _segments(store)
    return segments.index() if segments.covers(store.manifest()["number"]) else None


def remove_files(store: ChunkStore, files: DataFrame) -> None:
    """Remove the rows of files (sessionFile) from a store and its index."""
    store.published = None
    store.delete_files(files)
    if store.published:
        _follow(store, store.rows().limit(0), files.select("sessionFile").distinct())


def _write(store: ChunkStore, files: DataFrame, chunks: DataFrame, embedder: Embedder, concurrency: int | None) -> dict:
    """Embed and upsert; a file with a chunk that could not be embedded is left out whole and counted.

    The chunks of batches that failed are tried again by themselves, in smaller batches, so that
    little else is left out with what cannot be embedded.
    """
    n_files = files.count()
    if not n_files:
        return {"indexed": 0, "new_chunks": 0, "total_chunks": store.count(), "message": "All files already indexed"}
    first = embed_documents(chunks, embedder, concurrency=concurrency, keep_errors=True).persist()
    again = first.filter("error IS NOT NULL").drop("vector", "error")
    seen = Observation("indexing")
    embedded = first.filter("error IS NULL").unionByName(embed_documents(again, embedder, RETRY_BATCH, concurrency, keep_errors=True))
    embedded = embedded.observe(seen, F.count("*").alias("chunks"), F.count("error").alias("failed")).persist()
    bad = embedded.filter("error IS NOT NULL").select("sessionFile").distinct()
    fresh = embedded.join(bad, "sessionFile", "left_anti").drop("error")
    store.published = None
    written = store.upsert(fresh)
    if store.published:
        _follow(store, fresh)
    elif text_index(store) is None:
        build_text_index(store)
    errors, metrics = bad.count(), seen.get
    embedded.unpersist(), first.unpersist()
    report = {"indexed": n_files - errors, "new_chunks": written, "total_chunks": store.count()}
    return report | ({"errors": errors, "failed_chunks": metrics["failed"]} if errors else {})


def _chunks(todo: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Chunks of the files todo: of their lines where these are given, else of their contents."""
    if lines is None:
        return extract_sessions(todo)
    wanted = todo.select(F.col("path").alias("sessionFile")).distinct()
    return session_chunks(said_lines(lines.join(wanted, "sessionFile", "left_semi")))


def index_sessions(store: ChunkStore, files: DataFrame, embedder: Embedder, force: bool = False, concurrency: int | None = None, lines: DataFrame | None = None) -> dict:
    """Index the session files (path, content) that the store lacks, or all after a reset.

    With lines (numbered_lines() of the same files) the contents are not read: only paths are.
    """
    store.reset() if force else store.ensure()
    todo = unindexed(files, store.files())
    return _write(store, todo, _chunks(todo, lines), embedder, concurrency)


def reindex_sessions(store: ChunkStore, files: DataFrame, embedder: Embedder, as_of: Column, current: str | None = None, lines: DataFrame | None = None) -> dict:
    """Index what is new, was modified within a day of as_of, or belongs to the current session; lines as in index_sessions()."""
    store.ensure()
    todo = to_reindex(files, store.files(), as_of, current)
    return _write(store, todo, _chunks(todo, lines), embedder, None)


def index_notes(store: ChunkStore, files: DataFrame, embedder: Embedder, force: bool = False, concurrency: int | None = None) -> dict:
    """Index the note files (path, content) of the indexed folders that the store lacks."""
    store.reset() if force else store.ensure()
    todo = unindexed(files, store.files())
    return _write(store, todo, as_chunks(note_chunks(todo)), embedder, concurrency)


def index_files(store: ChunkStore, files: DataFrame, chunks: Callable[[DataFrame], DataFrame], embedder: Embedder) -> dict:
    """Index files (path, content) whether the store has them or not; their rows are replaced."""
    store.ensure()
    return _write(store, files, chunks(files), embedder, None)


def notes_to_index(spark: SparkSession, folder: str) -> DataFrame:
    return note_files(spark, folder, INDEXED_FOLDERS)


def status(store: ChunkStore, files: DataFrame | None = None) -> dict:
    """Rows, files indexed and found, data files and bytes of a store."""
    if not store.exists():
        return {"chunks": 0, "indexed_files": 0, "total_files": files.count() if files is not None else 0, "indexed": False, "data_files": 0, "bytes": 0}
    n, size = store.size()
    return {"chunks": store.count(), "indexed_files": store.files().count(), "total_files": files.count() if files is not None else 0, "indexed": True, "data_files": n, "bytes": size}


def _compact(store: ChunkStore) -> dict:
    segments, before = _segments(store), store.manifest()["number"]
    store.published = None
    report = store.compact()
    if store.published and store.published == before + 1 and segments.covers(before):
        segments.compact(store.published)
    return report


def compact(stores: dict[str, ChunkStore], target: str = "all") -> dict:
    """Compaction reports of one store or all, their indexes included; None for a store that is not there."""
    names = list(stores) if target == "all" else [target]
    return {n: _compact(stores[n]) if stores[n].exists() else None for n in names}
