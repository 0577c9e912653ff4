"""Relevance report: how well each way of searching finds the documents that hold a benchmark text.

    python -m jobs.relevance_report --documents D --embeddings E --benchmark B --out OUT [--config FILE]

Reads documents (doc_id, text, source), embeddings (vec_id, embedding; a document's or
a benchmark item's vector) and benchmark (item_id, text) and writes

    OUT/index                   full-text index of the documents: each one's words in order, and all terms with
                                the number of documents that hold them
    OUT/judgments               item_id, doc_id: documents that hold the item's words in order
    OUT/results/mode=..         per item: relevant, recall at each depth, mrr, hit
    OUT/summary/mode=..         means over the items that some document holds

The index is kept by document: nearly all documents hold some word of the items, so that a
search reads it whole, and no posting has to be shuffled.  Judgments need no comparison of all
pairs: a document that holds an item holds its rarest word, so only those are compared.  Modes are text (BM25), vector (exact nearest
neighbours), weighted and rrf (fusions of both lists), and mmr (weighted, then diversity);
every mode shares the same two lists.

Safe to rerun: each run writes the modes it was asked for anew, and those of earlier
runs stay.  An item that no document holds counts in results with recall and mrr 0,
and not in the summary.  Null texts hold nothing; empty tables give empty results.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, settings
from lodeframe.operators.bm25 import WordIndex, phrase_search, text_search
from lodeframe.operators.evaluate import judged_metrics
from lodeframe.operators.knn import vector_search
from lodeframe.plans.search import BROADCAST_HITS, retrieve
from lodeframe.schema import NOTE_CONFIG, PAYLOAD, SESSION_CONFIG

MODES = ("text", "vector", "weighted", "rrf", "mmr")
DEFAULTS = {"modes": list(MODES), "each": 20, "vector_weight": 0.7, "text_weight": 0.3, "depths": [5, 10]}
VECTOR_LEAST = 0.05


def _hits(mode: str, text: DataFrame, vector: DataFrame, payload: DataFrame, config: dict, few: bool = False) -> DataFrame:
    """qid, id, rank of one way of searching, from the shared lists; few: these may be broadcast past the documents."""
    if mode in ("text", "vector"):
        return (text if mode == "text" else vector).select("qid", "id", "rank")
    base = SESSION_CONFIG if mode == "rrf" else NOTE_CONFIG
    chosen = base.but(mmr=mode == "mmr", vector_weight=config["vector_weight"], text_weight=config["text_weight"])
    return retrieve(vector, text, payload, F.current_timestamp(), chosen, few=few).select("qid", "id", "rank")


def run(spark: SparkSession, documents: str, embeddings: str, benchmark: str, out: str, config: str | None = None) -> None:
    chosen, out = settings(spark, config, DEFAULTS), out.rstrip("/")
    unknown = sorted(set(chosen["modes"]) - set(MODES))
    if unknown:
        raise ValueError(f"unknown modes {unknown}")
    docs, items, vectors = spark.read.parquet(documents), spark.read.parquet(benchmark), spark.read.parquet(embeddings)
    asked = items.select(F.col("item_id").alias("qid"), "text")
    own = {"id": F.col("doc_id"), "sessionFile": F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), "doc_id"), "project": F.col("source"), "lineNumber": F.lit(1), "timestamp": F.lit(""), "role": F.lit("content")}
    chunks = docs.select("text", *[c.alias(name) for name, c in own.items()], F.coalesce("source", F.lit("")).alias("source"), F.create_map(F.lit("type"), F.lit("document")).alias("metadata"))

    WordIndex.write(chunks.select("id", "text"), f"{out}/index")
    index = WordIndex.read(spark, f"{out}/index")
    phrase_search(asked, index).write.mode("overwrite").parquet(f"{out}/judgments")
    judgments = spark.read.parquet(f"{out}/judgments")

    # both lists are written once, a mode reads them again
    known = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    mine = known.join(chunks.select("id"), "id", "left_semi")
    near = vector_search(asked.select("qid").join(known, asked["qid"] == known["id"]).select("qid", "vector"), mine, chosen["each"], VECTOR_LEAST)
    near.write.mode("overwrite").parquet(f"{out}/lists/vector")
    text_search(asked, index, chosen["each"]).write.mode("overwrite").parquet(f"{out}/lists/text")
    vector, text = spark.read.parquet(f"{out}/lists/vector"), spark.read.parquet(f"{out}/lists/text")
    log.info("read %d documents of %s and %d items of %s; wrote %d judgments, %d vector and %d text hits", docs.count(), documents, items.count(), benchmark, judgments.count(), vector.count(), text.count())

    few = vector.count() + text.count() <= BROADCAST_HITS
    for mode in chosen["modes"]:
        hits = _hits(mode, text, vector, chunks.select("id", *PAYLOAD), chosen, few)
        scored = judged_metrics(hits, judgments, asked.select("qid"), tuple(chosen["depths"])).withColumn("mode", F.lit(mode))
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").parquet(f"{out}/results")
        done = spark.read.parquet(f"{out}/results").filter(F.col("mode") == mode)
        means = [F.avg(c).alias(c) for c in scored.columns if c.startswith("recall") or c == "mrr"]
        summary = done.filter("relevant > 0").groupBy("mode").agg(F.count("*").alias("items"), *means, F.avg(F.col("hit").cast("double")).alias("hit_rate"))
        summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").parquet(f"{out}/summary")
        log.info("mode %s: wrote %d results to %s/results", mode, done.count(), out)


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out.rstrip('/')}/results")


def main() -> None:
    parser = argparse.ArgumentParser(prog="jobs.relevance_report", description="Relevance of each way of searching")
    for name in ("documents", "embeddings", "benchmark", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    command_line(parser, lambda spark, given: run(spark, **given))


if __name__ == "__main__":
    main()
