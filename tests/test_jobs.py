"""The jobs over growing and repeated input, and against their SQL."""

import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from jobs import common, queries, relevance_report, session_index
from lodeframe.operators.bm25 import text_search
from tests.conftest import TESTDATA
from tests.test_oracle import duck, rows  # noqa: F401

SAID = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    ours, theirs = queries.QUERIES[name](spark, TESTDATA).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def kept(said):
    """Plain code: the last text of each line, its repeats in one file included, where it is long enough."""
    out = []
    for batch, lines in enumerate(said):
        later = {(c, t) for more in said[batch + 1 :] for c, t, _, _ in more}
        for c, t, role, text in lines:
            if (c, t) not in later and text and len(text) > {"user": 20, "assistant": 100}.get(role, 1 << 30):
                words = re.findall(r"[^\W]+", text.lower())
                out.append((c, t, role, text, len(words)))
    return sorted(out, key=str)


def indexed(spark, folder):
    return sorted(((r["conv_id"], r["turn"], r["role"], r["text"], r["length"]) for r in session_index.lines(spark, f"{folder}/out").collect()), key=str)


def test_session_index_takes_only_what_is_new(spark, tmp_path):
    batches = [
        [(1, 0, "user", "how do range joins work in Spark?"), (1, 1, "assistant", "both sides are sorted " * 8), (2, 0, "user", "too short"), (3, 0, "system", "a system message that is long enough"), (4, 0, "user", "the very same line twice"), (4, 0, "user", "the very same line twice")],
        [(1, 2, "user", "and what about memory of the sweep?"), (5, 0, "user", "a new conversation about kittens"), (None, None, "user", "a line that has no conversation"), (6, 0, "user", None)],
        [(1, 0, "user", "how do as-of joins work in Spark?"), (1, 1, "assistant", "short now"), (4, 0, "user", "the line that came twice, once")],
    ]
    folder = str(tmp_path)
    args = (f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    for k, lines in enumerate(batches):
        spark.createDataFrame(lines, SAID).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        assert session_index.run(spark, *args) == len(lines)
        assert indexed(spark, folder) == kept(batches[: k + 1])
        before = spark.read.text(f"{folder}/out/*/*/*/*.parquet").select("_metadata.file_path", "_metadata.file_modification_time").distinct().count()
        assert session_index.run(spark, *args) == 0  # nothing new: nothing is written
        assert before == spark.read.text(f"{folder}/out/*/*/*/*.parquet").select("_metadata.file_path", "_metadata.file_modification_time").distinct().count()
    found = {(r["conv_id"], r["turn"]): r["n"] for r in session_index.postings(spark, f"{folder}/out").groupBy("conv_id", "turn").agg(F.sum("tf").alias("n")).collect()}
    assert found == {(c, t): n for c, t, _, _, n in kept(batches)}
    runs = {r["batch"]: (r["read"], r["kept"]) for r in common.table(spark, f"{folder}/out/runs", session_index.RUNS).collect()}
    assert runs == {0: (6, 4), 1: (4, 3), 2: (3, 2)}


def test_segments_search_like_one_index(spark, tmp_path):
    folder = str(tmp_path)
    said = spark.read.parquet(f"{TESTDATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    for k in range(3):
        said.filter(F.pmod("conv_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        session_index.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    asked = said.filter("role = 'user'").orderBy("conv_id", "turn").limit(8).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")
    whole = session_index.lines(spark, f"{folder}/out").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    fields = ["qid", "id", "score", "rank"]
    one, many = text_search(asked, whole, 5).select(*fields).collect(), text_search(asked, session_index.index(spark, f"{folder}/out"), 5).select(*fields).collect()
    assert sorted(one) == sorted(many) and len(one) > 20


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    """A failure after the write and before the commit: the batch comes again under its number."""
    folder, said = str(tmp_path), [(1, 0, "user", "a line that is long enough"), (2, 0, "user", "another line, long enough")]
    frame = spark.createDataFrame(said, SAID)
    for _ in range(2):
        session_index._segment(frame, 0, f"{folder}/out", session_index.DEFAULTS)
        assert indexed(spark, folder) == kept([said]) and session_index.postings(spark, f"{folder}/out").count() == 10


def test_session_index_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SAID).coalesce(1).write.parquet(f"{folder}/in")
    assert session_index.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint") == 0
    assert session_index.lines(spark, f"{folder}/out").count() == 0 == session_index.postings(spark, f"{folder}/out").count()


def tables(spark, folder, docs, items, vectors):
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/d")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/b")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/e")
    return f"{folder}/d", f"{folder}/e", f"{folder}/b", f"{folder}/out"


def test_relevance_report_judges_and_keeps_other_modes(spark, tmp_path):
    folder = str(tmp_path)
    docs = [(1, "Intro: the Quick brown fox, jumps!", "a"), (2, "the quick fox brown jumps", "a"), (3, "THE QUICK BROWN FOX", None), (4, None, "b"), (5, "", "b"), (6, "lazy dogs sleep", "b")]
    items = [(1, "quick brown fox"), (2, "dogs sleep"), (3, "unicorn"), (4, None), (5, "  ")]
    args = tables(spark, folder, docs, items, [(k, [float(k), 1.0]) for k in range(1, 7)])
    relevance_report.run(spark, *args)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out/judgments").select("qid", "id").collect()) == [(1, 1), (1, 3), (2, 6)]
    first = sorted(tuple(r) for r in relevance_report.results(spark, f"{folder}/out").collect())
    text = {r["qid"]: r for r in relevance_report.results(spark, f"{folder}/out").filter("mode = 'text'").collect()}
    assert text[1]["recall5"] == 1.0 and text[2]["mrr"] == 1.0 and not text[3]["hit"] and text[4]["relevant"] == 0 and len(first) == 25
    summary = {r["mode"]: r for r in spark.read.parquet(f"{folder}/out/summary").collect()}
    assert set(summary) == set(relevance_report.MODES) and summary["text"]["items"] == 2 and summary["text"]["hit_rate"] == 1.0
    config = f"{folder}/config.json"
    with open(config, "w") as f:
        json.dump({"modes": ["rrf"]}, f)
    relevance_report.run(spark, *args, config=config)
    assert sorted(tuple(r) for r in relevance_report.results(spark, f"{folder}/out").collect()) == first


def test_settings_are_checked(spark, tmp_path):
    path = str(tmp_path / f"{uuid.uuid4().hex}.json")
    with open(path, "w") as f:
        json.dump({"moods": 1}, f)
    with pytest.raises(ValueError, match="moods"):
        common.settings(spark, path, relevance_report.DEFAULTS)
    assert common.settings(spark, "jobs/session_index.json", session_index.DEFAULTS) == session_index.DEFAULTS
    assert common.settings(spark, "jobs/relevance_report.json", relevance_report.DEFAULTS) == relevance_report.DEFAULTS


def test_jobs_import_nothing_of_the_optional_subpackage():
    import glob

    for path in glob.glob("jobs/*.py"):
        assert "lodeframe.llm" not in open(path).read() and "corpus_pipeline" not in open(path).read(), path
