"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import resampling as rs

DOCS = "doc_id long, text string, words string, gains int, score double"
BENCH = "item_id long, text string"


def features(text, orders=(1, 1)):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(words) - n + 1)]


def plain(docs, bench, percent=10, least=20, buckets=10_000, orders=(1, 1)):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features(text, orders)[1])
    t = Counter(bucket(f) for text in bench for f in features(text, orders)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        words, found = features(text, orders)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k in range(percent * len(able) // 100):
        able[k][4] = k + 1
    return sorted(tuple(str(x) for x in r[:5]) for r in rows)


def made(n=400):
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "naïve", "ÉCOLE", "東京", "x1", "e-mail", "😀", "delta"]
    docs = [(i - 50, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(3, docs[53][1])] * 5 + [(3, "alpha " * 25)] * 2 + [(None, None), (None, ""), (None, "beta " * 40), (None, "beta " * 40), (-7, None), (9_000_000_000, "gamma " * 30_000)]
    return docs, [" ".join(rng.choices(words[:4], k=12)) for _ in range(15)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"percent": 100}, {"percent": 37, "least": 1, "buckets": 7}, {"orders": (1, 3), "percent": 50}, {"percent": 0}])
def test_equal_to_plain_code(spark, options):
    docs, bench = made()
    frame = spark.createDataFrame([(i, t, "w", 1, 0.5) for i, t in docs], DOCS).repartition(5)
    target = spark.createDataFrame(list(enumerate(bench)), BENCH)
    renamed = {"least": "least_words"}
    ours = rs.resample(frame, target, **{renamed.get(k, k): v for k, v in options.items()})
    assert ours.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in ours.dtypes} == {"bigint"}
    assert sorted(tuple(str(x) for x in r) for r in ours.collect()) == plain(docs, bench, **options)


def test_one_document_repeated_a_thousand_times(spark):
    docs = [(7, "alpha " * 30)] * 1000 + [(i, "beta " * 25) for i in range(100, 120)]
    ours = rs.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "alpha")], BENCH), percent=40)
    assert sorted(r["rank"] for r in ours.filter("rank IS NOT NULL").collect()) == list(range(1, 1020 * 40 // 100 + 1))
    assert ours.count() == 1020


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "alpha beta " * 20)], "doc_id long, text string")
    assert rs.resample(none, some).count() == 0
    (row,) = rs.resample(some, none, percent=100).collect()
    assert row["rank"] == 1 and row["n_features"] == 40 and row["weight"] < 0


@pytest.mark.parametrize("k", [1, 2, 37, 500, 999, 1000])
def test_kth_key_of_wide_and_signed_keys(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([-(1 << 62), -1, 0, 5, (1 << 62) + 3, rng.getrandbits(63) - (1 << 62)]), rng.randint(-3, 3)) for _ in range(1000)]
    frame = spark.createDataFrame(rows, "a long, b long").repartition(6)
    assert tuple(rs.kth_key(frame, [F.col("a"), F.col("b")], k)) == sorted(rows)[k - 1]
