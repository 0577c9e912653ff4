"""Chunkers against hand-worked cases and an independent model."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import chunk_notes as cn
from lodeframe.operators import outline
from lodeframe.operators import chunk_sessions as cs
from lodeframe.schema import configure
from lodeframe.sources import files as sources

PI = "/h/.pi/agent/sessions/--home-u-repos-gh-x--/s.jsonl"
CLAUDE = "/h/.claude/projects/-home-u-repos-gh-y/s.jsonl"


def sessions(spark, path, lines, end="\n"):
    configure(spark)
    return {r["lineNumber"]: r for r in cs.extract_sessions(spark.createDataFrame([(path, end.join(lines))], "path string, content string")).collect()}


def pi(role, content, **more):
    return json.dumps({"type": "message", "timestamp": 1700000000000, "message": {"role": role, "content": content}} | more)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_pi_lines(spark, end):
    got = sessions(
        spark,
        PI,
        [
            pi("user", "u" * 20), pi("user", "u" * 21), "", "not json", "null", pi("assistant", "a" * 100), pi("assistant", [{"type": "text", "text": "a" * 101}]),
            json.dumps({"type": "compaction", "compaction": {"summary": "s" * 3000}}), pi("tool", "t" * 500), pi("user", "x" * 2001), pi("user", "y" * 1999 + "😀z"),
            json.dumps({"type": "message", "message": {"role": "user"}}), json.dumps({"type": "compaction", "compaction": {"summary": ""}}), "5", pi("user", "z" * 30, timestamp="bad"),
        ],
        end,
    )
    assert sorted(got) == [2, 7, 8, 10, 11, 15]
    assert got[2]["timestamp"] == "2023-11-14T22:13:20.000Z" and got[2]["project"] == "x" and got[2]["id"] == f"{PI}:2"
    assert got[8]["role"] == "compaction" and len(got[8]["text"]) == 3000 and got[8]["timestamp"] == "" and got[8]["metadata"] == {"type": "compaction"}
    assert got[10]["text"] == "x" * 2000 + "..." and got[11]["text"] == "y" * 1999 + "..."
    assert got[15]["timestamp"] == "" and got[7]["metadata"] == {"type": "assistant_response"}


def test_claude_lines(spark):
    line = lambda kind, content: json.dumps({"type": kind, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": content}})
    got = sessions(spark, CLAUDE, [line("user", "u" * 30), line("assistant", "a" * 101), line("progress", "p" * 300), line("user", [{"type": "tool_result"}]), json.dumps({"type": "user"})])
    assert sorted(got) == [1, 2]
    assert got[1]["timestamp"] == "2024-01-01T00:00:00Z" and got[1]["source"] == "claude" and got[2]["role"] == "assistant"


NOTE = """#+title:      My note
#+date:       [2025-05-16 Fri 09:06]
#+filetags:   :alpha:beta:
#+identifier: 20250516T090600
#+reference:  k1; k2
:GPTEL_MODEL: x

preamble that is not in any section
* First heading :alpha:NEW:
:PROPERTIES:
:CUSTOM_ID: one
:lower: no
:END:
Body of the first heading, long enough to count.
#+BEGIN_SRC python
code stays here as content
#+END_SRC
#+Begin_mixed stays too
** Child
child text that is definitely more than thirty characters long
* Old :ARCHIVE:
archived text that is definitely more than thirty characters
** Under old
still here, this is definitely more than thirty characters long
* 한글 제목 :태그:
short
"""
PATH = "/h/org/notes/20250516T090600--slug-title__tag1_tag2.org"


def chunks(spark, content, path=PATH):
    configure(spark)
    return {r["id"].removeprefix(path + ":"): r for r in cn.note_chunks(spark.createDataFrame([(path, content)], "path string, content string")).collect()}


def test_note_chunks(spark):
    got = chunks(spark, NOTE)
    assert set(got) == {"h9", "c9:0", "h19", "c19:0", "h23", "c23:0", "h25"}
    meta = got["h9"]["metadata"].asDict()
    assert meta["title"] == "My note" and meta["filetags"] == ["alpha", "beta"] and meta["references"] == ["k1", "k2"] and meta["hasGptelProps"] and meta["folder"] == "notes"
    assert got["h9"]["text"] == "My note\n[alpha, beta]\n> First heading\n(NEW)"
    assert got["h9"]["heading"]["properties"] == {"CUSTOM_ID": "one"}
    body = got["c9:0"]["rawText"]
    assert body.startswith("Body of the first") and "code stays" in body and "#+Begin_mixed" in body and "BEGIN_SRC" not in body and "CUSTOM_ID" not in body
    assert "** Child\nchild text" in body and "archived" not in body
    assert got["c19:0"]["hierarchy"] == "First heading > Child" and got["c23:0"]["hierarchy"] == "Old > Under old"
    assert got["h25"]["rawText"] == "한글 제목 :태그:"


def test_small_and_headless_files(spark):
    assert chunks(spark, "x" * 49) == {}
    got = chunks(spark, "#+title: T\n" + "plain text without any heading in it, over fifty", "/h/org/bib/a.org")
    assert list(got) == ["c0"] and got["c0"]["text"] == "T\n\nplain text without any heading in it, over fifty" and got["c0"]["lineNumber"] == 1


@pytest.mark.parametrize(
    ("content", "title"),
    [("#+title:\n#+date: x\n* h", "#+date: x"), ("x\n* h\n#+title: late", "slug-title"), ("* h\n#+title: first line is a heading", "first line is a heading"), ("#+TITLE:   Up  \n* h", "Up"), ("text", "slug-title")],
)
def test_front_matter_titles(spark, content, title):
    row = spark.createDataFrame([(content, PATH)], "c string, p string").select(cn.front_matter(F.col("c"), F.col("p")).alias("m")).first()["m"]
    assert row["title"] == title and row["identifier"] == "20250516T090600"


@pytest.mark.parametrize(
    ("levels", "paths"),
    [("1223", ["A", "A > B", "A > C", "A > B > C > D"]), ("1324", ["A", "A > B", "A > C", "A > B > C > D"]), ("21", ["A", "B"]), ("121", ["A", "A > B", "C"])],
)
def test_hierarchy_with_level_skips(spark, levels, paths):
    content = "\n".join("*" * int(n) + " " + "ABCD"[i] for i, n in enumerate(levels))
    rows = cn.note_headings(spark.createDataFrame([("p.org", content)], "path string, content string")).orderBy("lineNumber").collect()
    assert [r["hierarchy"] for r in rows] == paths


def test_unclosed_drawer_swallows_the_rest():
    lines = "a\n :PROPERTIES:\nb\n:END:\nc\n:END:\n:PROPERTIES:\nd".split("\n")
    assert outline.content_of(lines, 0, 8) == "a\nc\n:END:"


def pack(text, most, overlap):
    """Model of greedy packing: closes before the line that does not fit, carries whole lines back."""
    units = lambda s: len(s.encode("utf-16-le")) // 2
    if units(text) <= most:
        return [(text, 0)]
    lines, out, start, i = text.split("\n"), [], 0, 0
    size = [units(x) + 1 for x in lines]
    for i in range(len(lines)):
        if i > start and sum(size[start : i + 1]) > most:
            out.append((start, i))
            back = i
            while back > start and sum(size[back:i]) < overlap:
                back -= 1
            start = back
    return [("\n".join(lines[a:b]), a) for a, b in [*out, (start, len(lines))]]


def test_sub_chunks_equal_the_model(spark):
    rng = random.Random(3)
    texts = ["\n".join("x" * rng.choice([0, 1, 5, 20, 90]) + rng.choice(["", "😀"]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most, overlap in ((100, 30), (50, 0), (60, 80)):
        got = rows.select("i", cn.sub_chunks(F.col("t"), F.lit(most), F.lit(overlap)).alias("c")).collect()
        for r in got:
            assert [(c["text"], c["offsetLines"]) for c in r["c"]] == pack(texts[r["i"]], most, overlap)


def test_every_line_of_a_long_section_is_in_a_chunk(spark):
    content = "* H\n" + "\n".join(f"line {i} " + "w" * 70 for i in range(200))
    got = chunks(spark, content)
    lines = {m for r in got.values() if r["chunkType"] == "content" for m in re.findall(r"line \d+", r["rawText"])}
    assert len(lines) == 200 and len([k for k in got if k.startswith("c")]) > 3


def outlines(n, lines):
    rng = random.Random(n)
    kinds = ["* A :x:", "** B", "*** C :ARCHIVE:", "* D\r", "**  E  :a_b:C: ", "****  F", "*nohead", "text " + "w" * 60, ":PROPERTIES:", " :END: ", ":ID: 5", ":ID: 6", ":low: x", "#+begin_src", "#+Begin_x", "#+TITLE: t", "", "한글 😀", "* \u00a0G\u3000"]
    return ["\n".join(rng.choice(kinds) for _ in range(rng.randint(0, lines))) for _ in range(n)]


def test_sections_and_hierarchies_equal_a_plain_model():
    for content in outlines(200, 60):
        lines = content.split("\n")
        found = outline.find_headings(lines)
        ends, paths = outline.section_ends(found, len(lines)), list(outline.hierarchies(found))
        for i, h in enumerate(found):
            after = [o.lineNumber - 1 for o in found[i + 1 :] if o.level <= h.level]
            assert ends[i] == (after[0] if after else len(lines))
            path, k = [h.title], i - 1
            while k >= 0 and h.level > 1:  # backwards, every lower level, to the first of level 1
                path = [found[k].title, *path] if found[k].level < h.level else path
                if found[k].level == 1:
                    break
                k -= 1
            assert paths[i] == " > ".join(path)


def test_pieces_are_streamed_in_bounded_batches(spark, monkeypatch):
    files = [(f"/h/org/notes/{i}.org", c + "\n" + "end " * 20) for i, c in enumerate(outlines(40, 60))] + [("/h/org/notes/null.org", None)]
    frame = spark.createDataFrame(files, "path string, content string").repartition(3)
    whole = sorted(map(str, cn.note_chunks(frame).collect()))
    monkeypatch.setattr(cn, "BATCH_ROWS", 3)
    assert sorted(map(str, cn.note_chunks(frame).collect())) == whole and len(whole) > 100


def test_twenty_thousand_headings_in_seconds(spark):
    """Time grows with the chunks: one file with a drawer under each of its headings."""
    section = lambda i: f"{'*' * (1 if i % 200 == 0 else 2 + i % 3)} a heading of some length {i}\n:PROPERTIES:\n:ID: {i}\n:END:\nbody {i}, long enough to be a chunk of its own"
    began = time.monotonic()
    got = cn.note_chunks(spark.createDataFrame([("/h/org/notes/x.org", "\n".join(map(section, range(20_000))))], "path string, content string"))
    assert got.filter("chunkType = 'heading'").count() == 20_000 and time.monotonic() - began < 30


@pytest.mark.parametrize("split", ["1k", "100", "128m"])
def test_lines_of_splits_are_numbered_like_those_of_whole_files(spark, tmp_path, split):
    rng = random.Random(len(split))
    for k in range(6):
        folder = tmp_path / f"p {k}"
        folder.mkdir()
        lines = [rng.choice(["", " ", "{bad", "x" * rng.randint(1, 3000), "한글 ❤" * rng.randint(1, 40), f"line {i}"]) for i in range(rng.choice([0, 1, 80, 300]))]
        (folder / "log.jsonl").write_bytes(rng.choice(["\n", "\r\n"]).join(lines).encode() + rng.choice([b"", b"\n"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sources.pi_lines(spark, str(tmp_path))
        whole = cs.lines_of(sources.pi_sessions(spark, str(tmp_path)))
        assert sorted(map(tuple, cs.said_lines(got).collect())) == sorted(map(tuple, whole.collect())) and whole.count() > 50
        if split != "128m":
            assert got.rdd.getNumPartitions() > 0 and spark.read.text(f"{tmp_path}/*/*.jsonl").rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sources.pi_lines(spark, f"{tmp_path}/none").count() == 0


def test_subagents_are_left_out_of_lines(spark, tmp_path):
    for name in ("p/a.jsonl", "p/u/b.jsonl", "p/subagents/c.jsonl", "subagents/d.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("one\ntwo")
    listed = {r["path"] for r in sources.claude_sessions(spark, str(tmp_path)).collect()}
    assert {r["sessionFile"] for r in sources.all_lines(spark, None, str(tmp_path)).collect()} == listed and len(listed) == 3
