"""The corpus pipeline: five stages from documents to shards.

Toxic documents go, one document of each near-duplicate group stays, documents that
hold benchmark items go, sources are mixed to their target weights (a document may
be repeated), and the mix is cut into shards.  Every stage takes and returns whole
DataFrames; all but the last return the columns of documents.

Defined results: stages follow their operators for nulls, empty and long texts, ties
and repeated rows.  Rows that the mix repeats are told apart in the shards by slot.
An empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import decontaminate, mixing, sharding, simhash, toxicity
from lodeframe.llm.session import discard, stored, table

SHARDS = 8
#: Near duplicates of the corpus: words of a shingle and least Jaccard similarity (op7's query keeps its own limits).
NEAR_WIDTH, NEAR_SIMILARITY = 5, 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, NEAR_WIDTH, NEAR_SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_table(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Classifier, fingerprints and splitting tree are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again, and goes when the next one is there."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = stored(stage(spark, docs, sf_dir))
        if k:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
