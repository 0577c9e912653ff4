"""Command line: python -m lodeframe.cli <command> [arguments]

search-sessions|search <query> [--limit N] [--source pi|claude] [--dictionary FILE]
search-knowledge|knowledge <query> [--limit N] [--dictionary FILE]
benchmark <queries> [--dry-run] [--log FOLDER]
status | reindex [--force] | index-sessions | index-notes | compact [sessions|notes|all]
follow   (bring both stores in step with their folders: new, edited and removed files)

A dictionary is JSON lines of term and expansions, which are added to what is embedded of
a query.  Benchmark queries are JSON lines of qid, text, expected (parts of paths),
category and difficulty; --dry-run only counts them, --log appends every result there.

Answers are JSON on stdout; errors are JSON on stderr with exit code 1.  The offline
hashing embedder is used unless an embedder factory `module:function` is named in
LODEFRAME_EMBEDDER; it is called with a dimension.  INDEX_CONCURRENCY (2) caps the
embedding calls that run at a time.
"""

from __future__ import annotations

import importlib
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators.embed import CONCURRENCY, Embedder, HashingEmbedder
from lodeframe.operators.evaluate import listing
from lodeframe.plans import benchmark, jobs, search
from lodeframe.plans.store import ChunkStore
from lodeframe.present import response, shown
from lodeframe.schema import NOTE_DIM, SESSION_DIM, Paths, configure
from lodeframe.sources.files import all_lines, all_sessions
from lodeframe.streaming import changes

USAGE = "lodeframe.cli <search-sessions|search-knowledge|benchmark|status|reindex|index-sessions|index-notes|follow|compact> [args]"


def parse(args: list[str]) -> tuple[str, list[str], dict[str, str]]:
    """Command, positional arguments and flags; a flag takes the next argument unless that is a flag."""
    command, rest = (args[0] if args else ""), args[1:]
    positional, flags = [], {}
    i = 0
    while i < len(rest):
        if rest[i].startswith("--"):
            takes = i + 1 < len(rest) and not rest[i + 1].startswith("--")
            flags[rest[i][2:]] = rest[i + 1] if takes else "true"
            i += takes
        else:
            positional.append(rest[i])
        i += 1
    return command, positional, flags


def embedder(dim: int) -> Embedder:
    named = os.environ.get("LODEFRAME_EMBEDDER")
    if not named:
        return HashingEmbedder(dim)
    module, _, function = named.partition(":")
    return getattr(importlib.import_module(module), function)(dim)


DICTIONARY = "term string, expansions array<string>"
BENCHMARK = "qid long, text string, expected array<string>, category string, difficulty string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        raise Failure(f"No such file: {path}") from None


def relevance(spark: SparkSession, notes: ChunkStore, queries: DataFrame, dry: bool, log: str | None) -> str:
    """Summaries with and without diversity, what it changed, and the queries counted."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    if dry:
        return json.dumps({"listing": rows(listing(queries))}, ensure_ascii=False)
    if not notes.exists():
        raise Failure("Notes are not indexed")
    results = benchmark.run(queries, notes.rows(), embedder(NOTE_DIM), F.current_timestamp()).persist()
    try:
        return json.dumps({name: rows(df) for name, df in benchmark.report(results, log).items()}, ensure_ascii=False)
    finally:
        results.unpersist()


class Failure(Exception):
    def __init__(self, message: str, **more: str):
        super().__init__(message)
        self.answer = {"error": message, **more}


def run(spark: SparkSession, args: list[str], paths: Paths | None = None) -> str:
    """The JSON answer to one command."""
    configure(spark)
    paths = paths or Paths()
    command, positional, flags = parse(args)
    sessions, notes = ChunkStore(spark, paths.session_store, SESSION_DIM), ChunkStore(spark, paths.note_store, NOTE_DIM)
    calls = int(os.environ.get("INDEX_CONCURRENCY", CONCURRENCY))
    files = lambda: all_sessions(spark, paths.pi_sessions, paths.claude_sessions)
    query = " ".join(positional)
    if command in ("search-sessions", "search", "search-knowledge", "knowledge"):
        if not query:
            raise Failure(f"Usage: {command} <query> [--limit N]")
        try:
            limit = int(flags.get("limit", "10"))
        except ValueError:
            raise Failure(f"--limit is no number: {flags['limit']}") from None
        dictionary = json_lines(spark, flags["dictionary"], DICTIONARY) if "dictionary" in flags else None
        asked, now = spark.createDataFrame([(1, query)], "qid long, text string"), F.current_timestamp()
        expanded = search.expand_queries(asked, dictionary).first()["expansions"] if dictionary is not None else ()
        if command in ("search-knowledge", "knowledge"):
            if not notes.exists():
                raise Failure("Notes are not indexed")
            found = search.knowledge_search(asked, notes.rows(), embedder(NOTE_DIM), now, limit, dictionary, index=jobs.text_index(notes))
            return response(query, shown(found).collect(), expanded)
        spare = {"notes": notes.rows(), "note_embedder": embedder(NOTE_DIM), "note_index": jobs.text_index(notes)} if notes.exists() else {}
        found = search.session_search(asked, sessions.rows(), embedder(SESSION_DIM), now, limit, flags.get("source"), dictionary=dictionary, index=jobs.text_index(sessions), **spare)
        rows = shown(found).collect()
        return response(query, rows, expanded, fallback=any(r["fallback"] for r in rows))
    if command == "benchmark":
        if not query:
            raise Failure("Usage: benchmark <queries> [--dry-run] [--log FOLDER]")
        return relevance(spark, notes, json_lines(spark, query, BENCHMARK), flags.get("dry-run") == "true", flags.get("log"))
    if command == "status":
        own, other = jobs.status(sessions, files()), jobs.status(notes)
        return json.dumps({"sessions": {k: own[k] for k in ("chunks", "indexed_files", "total_files")}, "knowledge": {k: other[k] for k in ("chunks", "indexed")}})
    if command in ("reindex", "index-sessions"):
        return json.dumps(jobs.index_sessions(sessions, files(), embedder(SESSION_DIM), flags.get("force") == "true", calls, all_lines(spark, paths.pi_sessions, paths.claude_sessions)))
    if command == "index-notes":
        return json.dumps(jobs.index_notes(notes, jobs.notes_to_index(spark, paths.notes), embedder(NOTE_DIM), flags.get("force") == "true", calls))
    if command == "follow":
        told = {}
        for name, store, folder in (("sessions", sessions, paths.pi_sessions), ("claude_sessions", sessions, paths.claude_sessions), ("notes", notes, paths.notes)):
            follow = changes.follow_notes if store is notes else changes.follow_sessions
            told[name] = follow(store, folder, embedder(NOTE_DIM if store is notes else SESSION_DIM), f"{paths.data_dir}/seen/{name}")
        return json.dumps(told)
    if command == "compact":
        return json.dumps(jobs.compact({"sessions": sessions, "notes": notes}, positional[0] if positional else "all"))
    raise Failure("Unknown command", usage=USAGE)


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("lodeframe").getOrCreate()
    try:
        print(run(spark, args))
        return 0
    except Failure as e:
        print(json.dumps(e.answer), file=sys.stderr)
        return 1
    except Exception as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
