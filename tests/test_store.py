"""The chunk store, jobs, the stream and the command line on small folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodeframe import cli
from lodeframe.operators.bm25 import text_search
from lodeframe.operators.embed import HashingEmbedder, embed_documents, embed_query
from lodeframe.plans import jobs, store
from lodeframe.plans.store import ChunkStore, StoreConflict, to_reindex
from lodeframe.schema import CHUNK, Paths
from lodeframe.sources import files as src
from lodeframe.streaming import changes
from lodeframe.streaming.incremental import index_stream
from lodeframe.streaming.progress import IndexProgress


def rows(spark, *files, n=2, mark=""):
    data = [(f"{f}:{i}", f"{mark}text {i} of {f}", [0.1 * i, 1.0], f, "p", i, "", "user", "pi", {"k": "v"}) for f in files for i in range(n)]
    return spark.createDataFrame(data, CHUNK)


def test_of_two_writers_one_fails_and_old_versions_expire(spark, tmp_path):
    s, other = (ChunkStore(spark, str(tmp_path / "t"), 2, buckets=4) for _ in range(2))
    s.upsert(rows(spark, "/a", "/b"))
    seen = other.manifest()
    s.upsert(rows(spark, "/c"))
    with pytest.raises(StoreConflict):
        other._publish(seen)
    assert s.count() == 6
    folders = lambda: os.listdir(tmp_path / "t" / "data")
    s.compact()
    assert len(folders()) > 1
    s.compact(keep_hours=-1)
    assert len(folders()) == 1 and s.count() == 6 and len(s._versions()) == 1


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 10)
    s = ChunkStore(spark, str(tmp_path / "t"), 2, buckets=1)
    s.upsert(rows(spark, "/a", n=100))
    assert s.size()[0] >= 8 and s.count() == 100


def test_upsert_replaces_every_file_of_the_batch(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "t"), 2, buckets=4)
    assert not s.exists() and s.upsert(rows(spark, "/a", "/b", "/c")) == 6
    before = s.rows()
    assert s.upsert(rows(spark, "/b", "/d", n=1, mark="new ")) == 2
    got = {r["id"]: r["text"] for r in s.rows().collect()}
    assert set(got) == {"/a:0", "/a:1", "/b:0", "/c:0", "/c:1", "/d:0"} and got["/b:0"].startswith("new")
    assert before.count() == 6  # a reader of before still sees what it saw
    assert {r[0] for r in s.files().collect()} == {"/a", "/b", "/c", "/d"} and s.count() == 6
    report = s.compact()
    assert before.count() == 6  # and still after a compaction
    assert report["rows"] == 6 and report["files_after"] <= 4 and s.count() == 6
    s.delete_files(spark.createDataFrame([("/a",), ("/zz",)], "sessionFile string"))
    assert s.count() == 4
    assert s.rows().filter("sessionFile = '/b'").first()["metadata"] == {"k": "v"}
    assert s.reset().count() == 0 and s.exists()


@pytest.fixture
def home(tmp_path):
    def put(path, text):
        path = tmp_path / path
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    say = lambda kind, text: json.dumps({"type": kind, "message": {"role": kind, "content": text}})
    put(".pi/agent/sessions/--home-u-repos-gh-x--/a b.jsonl", "\n".join(json.dumps({"type": "message", "timestamp": 1700000000000, "message": {"role": "user", "content": f"how do range joins work {i}"}}) for i in range(3)))
    put(".claude/projects/-home-u-y/s.jsonl", say("user", "please explain the window functions"))
    put(".claude/projects/-home-u-y/uuid/t.jsonl", say("assistant", "watermarks " * 20))
    put(".claude/projects/-home-u-y/subagents/u.jsonl", say("user", "never to be indexed at all"))
    put(".claude/projects/-home-u-y/uuid/deep/v.jsonl", say("user", "too deep to be indexed at all"))
    put("sync/org/notes/20250101T000000--joins__spark.org", "#+title: Joins\n* Range joins\n" + "range joins sort both sides and sweep over them\n" * 3)
    put("sync/org/notes/archives/x.org", "* never\n" + "x" * 80)
    put("sync/org/other/y.org", "* not an indexed folder\n" + "y" * 80)
    return tmp_path


def test_listings(spark, home):
    pi, claude = src.pi_sessions(spark, f"{home}/.pi/agent/sessions"), src.claude_sessions(spark, f"{home}/.claude/projects")
    assert src.sessions_by_source(spark, "pi", f"{home}/.pi/agent/sessions").count() == 1 and src.sessions_by_source(spark, "claude", f"{home}/.claude/projects").count() == 2
    assert [os.path.basename(r["path"]) for r in pi.collect()] == ["a b.jsonl"]
    assert sorted(os.path.basename(r["path"]) for r in claude.collect()) == ["s.jsonl", "t.jsonl"]
    assert src.all_sessions(spark, f"{home}/.pi/agent/sessions", f"{home}/.claude/projects").count() == 3
    assert src.pi_sessions(spark, f"{home}/none").count() == 0
    notes = src.note_files(spark, f"{home}/sync/org")
    assert sorted(os.path.basename(r["path"]) for r in notes.collect()) == ["20250101T000000--joins__spark.org", "y.org"]
    assert src.keep_folders(notes).count() == 1
    assert src.recent(notes, F.current_timestamp()).count() == 2 and src.recent(notes, F.lit("2999-01-01").cast("timestamp")).count() == 0


def test_command_line(spark, home, monkeypatch):
    paths = Paths(home=str(home), data=str(home / "data"))
    ask = lambda *a: json.loads(cli.run(spark, list(a), paths))
    assert ask("status")["sessions"] == {"chunks": 0, "indexed_files": 0, "total_files": 3}
    assert ask("reindex") == {"indexed": 3, "new_chunks": 5, "total_chunks": 5}
    assert ask("reindex")["indexed"] == 0
    assert ask("reindex", "--force")["indexed"] == 3
    assert ask("index-notes")["new_chunks"] == 2
    status = ask("status")
    assert status["sessions"]["indexed_files"] == 3 and status["knowledge"] == {"chunks": 2, "indexed": True}
    found = ask("search", "range", "joins", "--limit", "4")
    assert found["fallback"] and found["count"] >= 3 and found["query"] == "range joins"
    assert all(r["source"] != "pi" for r in ask("search", "range joins", "--source", "claude")["results"] if "source" in r)
    assert ask("knowledge", "range joins")["results"][0]["project"] == "notes"
    store = ChunkStore(spark, paths.session_store, 3072)
    assert jobs.text_index(store).totals.first()["n"] == 5
    assert embed_query("range joins", HashingEmbedder(8)) == HashingEmbedder(8).embed(["range joins"])[0]
    assert ask("compact", "sessions")["sessions"]["rows"] == 5
    told = ask("follow")
    assert [told[k]["new"] for k in ("sessions", "claude_sessions", "notes")] == [1, 3, 1] and ask("follow")["notes"]["new"] == 0
    for bad in (["search"], ["nothing"], ["search", "x", "--limit", "many"]):
        with pytest.raises(cli.Failure):
            cli.run(spark, bad, paths)
    assert cli.parse(["reindex", "--force", "x"])[2] == {"force": "x"}


def test_command_line_expansion_and_benchmark(spark, home, tmp_path):
    paths = Paths(home=str(home), data=str(home / "data"))
    ask = lambda *a: json.loads(cli.run(spark, list(a), paths))
    words, asked, log = tmp_path / "words.jsonl", tmp_path / "asked.jsonl", tmp_path / "log"
    words.write_text(json.dumps({"term": "조인", "expansions": ["range", "joins"]}, ensure_ascii=False))
    row = {"text": "range joins", "expected": ["joins__spark"], "category": "sql", "difficulty": "easy"}
    asked.write_text("\n".join(json.dumps({"qid": i} | row) for i in (1, 2)))
    assert {(r["category"], r["difficulty"]): r["queries"] for r in ask("benchmark", str(asked), "--dry-run")["listing"]}[None, None] == 2
    with pytest.raises(cli.Failure):
        ask("benchmark", str(asked))
    ask("index-notes")
    found = ask("knowledge", "조인", "--dictionary", str(words))
    assert found["expanded"] == ["range", "joins"] and found["results"][0]["project"] == "notes"
    assert "expanded" not in ask("knowledge", "range joins")
    told = ask("benchmark", str(asked), "--log", str(log))
    overall = [r for r in told["without"] if r["level"] == "overall"][0]
    assert overall["queries"] == 2 and overall["hit_rate"] == 1.0 and overall["mrr"] == 1.0 and told["changes"] == []
    assert spark.read.json(str(log)).count() == 4
    for bad in (["benchmark"], ["benchmark", str(tmp_path / "none")], ["search", "x", "--dictionary", str(tmp_path / "none")]):
        with pytest.raises(cli.Failure):
            cli.run(spark, bad, paths)


def test_stream_indexes_each_file_once(spark, home, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "stream"), 16, buckets=2)
    run = lambda: index_stream(spark, f"{home}/.claude/projects", s, HashingEmbedder(16), str(tmp_path / "cp")).awaitTermination()
    run()
    assert s.files().count() == 3
    (home / ".claude/projects/-home-u-y/new.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "a new question about spilling"}}))
    run()
    assert s.files().count() == 4 and s.count() == 4


def test_files_that_fail_to_embed_are_left_out_and_counted(spark, home, tmp_path):
    class Picky(HashingEmbedder):
        def embed(self, texts, task="document"):
            if any("window functions" in t for t in texts):
                raise RuntimeError("no such model")
            return super().embed(texts, task)

    s = ChunkStore(spark, str(tmp_path / "picky"), 8, buckets=2)
    files = src.all_sessions(spark, f"{home}/.pi/agent/sessions", f"{home}/.claude/projects").repartition(3, "path")
    report = jobs.index_sessions(s, files, Picky(8))
    assert report["errors"] >= 1 and report["indexed"] + report["errors"] == 3 and s.count() == report["new_chunks"]
    assert s.rows().filter("text LIKE '%window functions%'").count() == 0
    with pytest.raises(Exception, match="no such model"):
        embed_documents(spark.createDataFrame([("window functions",)], "text string"), Picky(8)).collect()


def test_failed_batches_are_tried_again_by_themselves(spark, tmp_path):
    class Flaky(HashingEmbedder):
        """Fails for large batches that hold a certain text, and always for another one."""

        def embed(self, texts, task="document"):
            if any("poison" in t for t in texts) or (len(texts) > 10 and any("number 7 " in t for t in texts)):
                raise RuntimeError("cannot be embedded")
            return super().embed(texts, task)

    said = [(f"/h/.pi/agent/sessions/--home-u-x--/{k}.jsonl", "\n".join(json.dumps({"type": "message", "message": {"role": "user", "content": f"question number {k * 9 + i} of a file {'poison' * (k == 4 and i == 3)}"}}) for i in range(9))) for k in range(8)]
    s = ChunkStore(spark, str(tmp_path / "s"), 8, buckets=2)
    report = jobs.index_sessions(s, spark.createDataFrame(said, "path string, content string").coalesce(1), Flaky(8))
    assert 1 <= report["failed_chunks"] <= 10 and report["errors"] + report["indexed"] == 8 and s.files().count() == report["indexed"]
    assert report["errors"] < 8 and s.rows().filter("text LIKE '%poison%'").count() == 0  # all 72 chunks were one batch at first


def test_progress_lines():
    p = IndexProgress(10)
    p.files, p.seconds = 4, 2.0
    assert p.line() == "4/10 files, 2.0/s, 3 s left, 0 errors" and IndexProgress().line() == "0 files, 0.0/s, 0 errors"


def test_to_reindex(spark):
    files = spark.createDataFrame([("/new", "2024-01-01"), ("/old", "2024-01-01"), ("/fresh", "2024-01-31"), ("/cur-7.jsonl", "2024-01-01")], "path string, m string").select("path", F.col("m").cast("timestamp").alias("modified"))
    indexed = spark.createDataFrame([("/old",), ("/old",), ("/fresh",), ("/cur-7.jsonl",)], "sessionFile string")
    got = [r["path"] for r in to_reindex(files, indexed, F.lit("2024-01-31 12:00:00").cast("timestamp"), "/s/cur-7.jsonl").collect()]
    assert sorted(got) == ["/cur-7.jsonl", "/fresh", "/new"]
    assert jobs.status(ChunkStore(spark, "/tmp/lodeframe-none", 2))["indexed"] is False


def test_index_follows_upserts_by_segments_and_reads_no_old_text(spark, tmp_path, monkeypatch):
    def logs(rows):
        told = {}
        for path, text in rows:
            told.setdefault(path, []).append(json.dumps({"type": "message", "message": {"role": "user", "content": text}}))
        return spark.createDataFrame([(f"/h/.pi/agent/sessions/--home-u-x--/{p}.jsonl", "\n".join(x)) for p, x in told.items()], "path string, content string").withColumn("modified", F.current_timestamp())

    said = [(f"f{i % 6}", f"question number {i} about {'joins' if i % 2 else 'windows'} and more") for i in range(24)]
    s = ChunkStore(spark, str(tmp_path / "s"), 8, buckets=3)
    jobs.index_sessions(s, logs(said), HashingEmbedder(8))
    segments = jobs._segments(s)
    assert segments.count() == 1
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "build_text_index", lambda _: pytest.fail("all rows were read"))
        jobs.index_sessions(s, logs([("f7", "a new file about joins, long enough")]), HashingEmbedder(8))
        jobs.reindex_sessions(s, logs([("f1", "the first file says something else now")]), HashingEmbedder(8), F.current_timestamp())
        jobs.remove_files(s, spark.createDataFrame([("/h/.pi/agent/sessions/--home-u-x--/f2.jsonl",)], "sessionFile string"))

    def same():
        asked = spark.createDataFrame([(1, "joins"), (2, "windows and more"), (3, "something else")], "qid long, text string")
        fields = ["qid", "id", "score", "rank"]
        found = sorted(text_search(asked, jobs.text_index(s), 30).select(*fields).collect())
        assert found == sorted(text_search(asked, s.rows().select("id", "text"), 30).select(*fields).collect())
        assert found and not any("/f2.jsonl" in r["id"] for r in found)

    same()
    assert segments.count() == 4
    jobs.compact({"sessions": s})
    same()
    assert segments.count() == 1
    s.upsert(s.rows().limit(1))  # not through the job: the index is behind, and is written anew by the next one
    assert jobs.text_index(s) is None
    jobs.index_sessions(s, logs([("f8", "one more file about windows, long enough")]), HashingEmbedder(8))
    same()


def test_folders_are_followed_through_edits_touches_and_removals(spark, tmp_path):
    folder, s = tmp_path / "p r", ChunkStore(spark, str(tmp_path / "s"), 8, buckets=2)
    (folder / "x").mkdir(parents=True)

    def put(name, *texts):
        (folder / "x" / name).write_text("\n".join(json.dumps({"type": "message", "message": {"role": "user", "content": t}}) for t in texts))

    def follow():
        told = changes.follow_sessions(s, str(folder), HashingEmbedder(8), str(tmp_path / "state"))
        return told["new"], told["modified"], told["removed"], told["new_chunks"] if told["indexed"] else 0

    texts = lambda: sorted(r["text"] for r in s.rows().collect())
    first, second, third = ("the first question, long enough", "another question, long enough", "a third question, long enough")
    put("a b.jsonl", first, second), put("c.jsonl", third), put("d.jsonl", "short")
    assert follow() == (3, 0, 0, 3) and texts() == sorted([first, second, third])
    assert follow() == (0, 0, 0, 0)
    put("a b.jsonl", first, "an edited question, long enough"), os.utime(folder / "x" / "c.jsonl", (1, 1))
    number = s.manifest()["number"]
    assert follow() == (0, 2, 0, 2) and s.manifest()["number"] == number + 1  # the touched file is not indexed again
    assert texts() == sorted([first, "an edited question, long enough", third]) and follow() == (0, 0, 0, 0)
    put("e.jsonl", "a new file, certainly long enough"), os.remove(folder / "x" / "c.jsonl"), put("a b.jsonl", "tiny")
    assert follow()[:3] == (1, 1, 1) and texts() == ["a new file, certainly long enough"]
    asked = spark.createDataFrame([(1, "question new")], "qid long, text string")
    assert [r["id"].endswith("e.jsonl:1") for r in text_search(asked, jobs.text_index(s), 9).collect()] == [True]
    assert follow() == (0, 0, 0, 0)


def test_notes_are_followed(spark, home, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "n"), 8, buckets=2)
    run = lambda: changes.follow_notes(s, f"{home}/sync/org", HashingEmbedder(8), str(tmp_path / "state"))
    assert run()["new"] == 1 and s.files().count() == 1 and run()["new"] == 0
    (path,) = [r["sessionFile"] for r in s.files().collect()]
    with open(path, "a") as f:
        f.write("\n* A heading that was added later\nwith a text that is long enough to be a chunk")
    assert run()["modified"] == 1 and s.rows().filter("text LIKE '%added later%'").count() == 2
