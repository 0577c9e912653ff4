"""What the searches of all documents shuffle does not grow with the documents; copies, which tie, are ranked as in SQL."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from lodeframe.plans import queries as core
from tests.conftest import TESTDATA
from tests.test_oracle import rows

FILES = 8  # more partitions than cores, so that no table is dealt out first


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Folders of the smallest tables with documents and vectors 2 and 8 times, under keys of their own."""
    folders = {}
    for times in (2, 8):
        folder = folders[times] = str(tmp_path_factory.mktemp(f"times{times}"))
        shutil.copyfile(f"{TESTDATA}/benchmark.parquet", f"{folder}/benchmark.parquet")
        for name, key in (("documents", "doc_id"), ("embeddings", "vec_id")):
            table = spark.read.parquet(f"{TESTDATA}/{name}.parquet")
            copies = table.crossJoin(spark.range(times).withColumnRenamed("id", "_copy")).withColumn(key, F.col(key) + 1000 * F.col("_copy")).drop("_copy")
            copies.repartition(FILES, key).write.parquet(f"{folder}/{name}.parquet")
            assert len([f for f in os.listdir(f"{folder}/{name}.parquet") if f.endswith(".parquet")]) == FILES
    return folders


def shuffled(spark, run):
    """What run() gives, and the rows that its stages shuffled."""
    sc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for i, n in stages().items() if i not in before)


def compared(spark, grown, name):
    """Rows shuffled over 2 and over 8 times the documents, the results being those of the SQL."""
    moved = []
    for folder in grown.values():
        ours, n = shuffled(spark, lambda folder=folder: core.QUERIES[name](spark, folder).toPandas())
        spark.catalog.clearCache()
        con = duckdb.connect()
        for table in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet'")
        assert rows(ours) == rows(con.sql(core.ORACLES[name]).df())
        moved.append(n)
    return moved


def test_relevance_changes_shuffles_the_best_only_and_once(spark, grown):
    few, many = compared(spark, grown, "relevance_changes")
    assert many < 1.5 * few and many < 14_000  # with a second text list 3,000 more


def test_diversity_shuffles_words_of_the_best_only(spark, grown):
    few, many = compared(spark, grown, "mmr_rerank")
    assert many < 1.5 * few and many < 60_000


def test_a_summary_shuffles_the_best_only(spark, grown):
    few, many = compared(spark, grown, "relevance_summary")
    assert many < 1.5 * few and many < 10_000


def test_rank_fusion_shuffles_the_best_only(spark, grown):
    few, many = compared(spark, grown, "fuse_rrf")
    assert many < 1.5 * few and many < 18_000


def test_metrics_shuffle_the_best_only(spark, grown):
    few, many = compared(spark, grown, "relevance_metrics")
    assert many < 1.5 * few and many < 10_000
