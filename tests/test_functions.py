from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import score as sc
from lodeframe.functions import text as tx
from lodeframe.schema import configure


def one(spark, column, **values):
    configure(spark)
    names = list(values)
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("out")).first()["out"] if names else spark.range(1).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("text", "n"), [("abc", 3), ("a😀b", 4), ("", 0), ("가나", 2)])
def test_length_counts_utf16_units(spark, text, n):
    assert one(spark, tx.utf16_length(F.col("t")), t=text) == n


@pytest.mark.parametrize(
    ("text", "n", "out"),
    [("abcdef", 6, "abcdef"), ("abcdef", 3, "abc..."), ("ab😀cd", 4, "ab😀..."), ("ab😀cd", 3, "ab..."), ("", 3, "")],
)
def test_truncate(spark, text, n, out):
    assert one(spark, tx.truncate(F.col("t"), n), t=text) == out


def test_trim_takes_all_unicode_space(spark):
    assert one(spark, tx.trim_all(F.col("t")), t=" \t x y 　﻿\n") == "x y"


def test_tokens_are_letters_numbers_underscore(spark):
    assert one(spark, tx.tokens(F.col("t")), t="Ab_1, é가! x-Y") == ["ab_1", "é가", "x", "y"]


@pytest.mark.parametrize(("a", "b", "out"), [([], [], 1.0), (["x"], [], 0.0), (["x", "y"], ["y", "z"], 1 / 3), (["x"], ["x"], 1.0)])
def test_jaccard(spark, a, b, out):
    assert one(spark, tx.jaccard(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(out)


def test_hangul_terms(spark):
    assert one(spark, tx.hangul_terms(F.col("t")), t="보편 학문, abc 바흐x") == ["보편", "학문", "바흐"]


@pytest.mark.parametrize(
    ("path", "project", "source"),
    [
        ("/h/.pi/agent/sessions/--home-u-repos-gh-agent-config--/a.jsonl", "agent-config", "pi"),
        ("/h/.claude/projects/-home-u-repos-gh-agent-config/a.jsonl", "agent-config", "claude"),
        ("/h/.claude/projects/-home-u-repos-work-x/uuid/a.jsonl", "x", "claude"),
        ("/h/.pi/agent/sessions/--home-u-notes--/a.jsonl", "notes", "pi"),
        ("/h/.pi/agent/sessions/--home-u--/a.jsonl", "home", "pi"),
        ("/tmp/some/a.jsonl", "some", "pi"),
        ("/tmp/---/a.jsonl", "unknown", "pi"),
    ],
)
def test_project_and_source(spark, path, project, source):
    assert one(spark, tx.project_of(F.col("p")), p=path) == project
    assert one(spark, tx.source_of(F.col("p")), p=path) == source


@pytest.mark.parametrize(
    ("json", "out"),
    [('"plain"', "plain"), ('[{"type":"text","text":"a"},{"type":"tool_use","text":"no"},{"type":"text"},{"type":"text","text":"b"}]', "a\nb"), ("[]", ""), ("{}", ""), ("5", "")],
)
def test_content_text(spark, json, out):
    assert one(spark, tx.content_text(F.parse_json("j")), j=json) == out


def test_enriched_leaves_out_what_is_empty_or_equal(spark):
    e = lambda title, tags, path, own, archived, content: one(spark, tx.enriched(F.lit(title), F.col("tags"), F.lit(path), F.col("own"), F.lit(archived), F.lit(content)), tags=tags, own=own)
    assert e("T", ["a", "b"], "T", ["A", "New"], False, "body") == "T\n[a, b]\n(New)\n\nbody"
    assert e("T", [], "T > S", [], False, "") == "T\n> T > S"
    assert e("", [], "", ["X"], True, "c") == "\nc"


def test_decay_halves_per_half_life_and_skips_unknown_times(spark):
    as_of = F.lit("2024-02-01").cast("timestamp")
    d = lambda text, days, org=False: one(spark, sc.decay(F.lit(1.0), sc.parse_time(F.col("t"), org), as_of, days), t=text)
    assert d("2024-01-18T00:00:00Z", 14.0) == pytest.approx(0.5)
    assert d("2024-01-02T00:00:00.000Z", 14.0) < 0.5
    assert d("2025-01-01T00:00:00Z", 14.0) == 1.0
    assert d("2024-01-18T00:00:00Z", 0.0) == 1.0
    for text in ("[2024-01-18 Thu 09:06]", "[2024-01-18]", "20240118T000000", "", "soon"):
        assert d(text, 14.0) == 1.0
    assert d("[2024-01-18 목 00:00]", 14.0, True) == pytest.approx(0.5)
    assert d("[2024-01-18]", 14.0, True) == pytest.approx(0.5)
    assert d("20240118T000000", 14.0, True) == pytest.approx(0.5)


def test_epoch_to_iso_and_similarity(spark):
    assert one(spark, sc.epoch_ms_to_iso(F.col("m")), m=1700000000123.0) == datetime.fromtimestamp(1700000000.123, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    assert one(spark, sc.epoch_ms_to_iso(F.col("m")), m=0.0) == ""
    assert one(spark, sc.similarity(F.col("d")), d=3.0) == 0.25
    assert one(spark, sc.similarity(F.lit(None).cast("double"))) == 0.0


def test_min_max_of_equal_scores_is_one(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 5.0), (2, 5.0)], "q int, s double")
    assert sorted(r[0] for r in df.select(sc.min_max(F.col("s"), "q")).collect()) == [0.0, 0.5, 1.0, 1.0, 1.0]
