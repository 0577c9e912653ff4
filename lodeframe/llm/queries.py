"""Registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodeframe.llm import decontaminate, embeddings, mixing, oracles, quotes, resampling, secrets, sharding, simhash, substrings, templates, toxicity, urls
from lodeframe.llm.session import table

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"), shards=8)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotes": op1_quotes,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix": op3_mix,
    "op4_shards": op4_shards,
    "op5_substrings": op5_substrings,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_urls": op8_urls,
    "op9_embeddings": op9_embeddings,
    "op10_secrets": op10_secrets,
    "op11_html": op11_html,
    "op12_resample": op12_resample,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_quotes": oracles.OP1_SQL,
    "op2_decontaminate": oracles.OP2_SQL,
    "op5_substrings": oracles.OP5_SQL,
    "op8_urls": oracles.OP8_SQL,
    "op9_embeddings": oracles.OP9_SQL,
    "op10_secrets": oracles.OP10_SQL,
    "op11_html": oracles.OP11_SQL,
    "op12_resample": oracles.OP12_SQL,
}
