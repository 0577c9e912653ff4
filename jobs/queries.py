"""The jobs as registered queries, with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import relevance_report, session_index
from lodeframe.plans.queries import CHUNK_LISTS, MMR_SQL, RRF, WEIGHTED, _folder, _fused_sql, renamed


def job1_session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the incremental index; every line as it stands with its postings summed."""
    folder = _folder(spark)
    for _ in range(2):
        session_index.run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/out", f"{folder}/checkpoint")
    said = session_index.postings(spark, f"{folder}/out").groupBy("conv_id", "turn").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_words"), F.max("tf").alias("most"))
    now = session_index.lines(spark, f"{folder}/out").join(said, ["conv_id", "turn"], "left").na.fill(0, ["n_terms", "n_words", "most"])
    return now.select("conv_id", "turn", "role", "text", F.col("length").cast("long").alias("length"), "n_terms", "n_words", "most")


JOB1_SQL = r"""
WITH k AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text FROM conversations
  WHERE (role = 'user' AND length(text) > 20) OR (role = 'assistant' AND length(text) > 100)),
w AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM k),
f AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(words) AS term FROM w) GROUP BY ALL),
p AS (SELECT conv_id, turn, count(*) AS n_terms, sum(tf)::BIGINT AS n_words, max(tf) AS most FROM f GROUP BY ALL)
SELECT conv_id, turn, role, text, len(words)::BIGINT AS length, coalesce(n_terms, 0) AS n_terms, coalesce(n_words, 0) AS n_words, coalesce(most, 0) AS most FROM w LEFT JOIN p USING (conv_id, turn)"""


def job2_relevance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the relevance report; the results of all modes."""
    folder = _folder(spark)
    for _ in range(2):
        relevance_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/out")
    found = relevance_report.results(spark, f"{folder}/out")
    return found.select("mode", "qid", "relevant", *[F.round(c, 6).alias(c) for c in ("recall5", "recall10", "mrr")], "hit")


_PADDED = r"' ' || array_to_string(regexp_extract_all(lower({}.text), '[\p{{L}}\p{{N}}_]+'), ' ') || ' '"
_WEIGHTED = "qid, id, score, rank FROM fused_w WHERE score >= 0.05"
JOB2_SQL = f"""{CHUNK_LISTS}, {renamed(_fused_sql(WEIGHTED), '_w')}, {renamed(_fused_sql(RRF), '_r')}, {MMR_SQL.format(source=_WEIGHTED)},
every AS (SELECT 'text' AS mode, qid, id, rank FROM t UNION ALL SELECT 'vector', qid, id, rank FROM v_items UNION ALL SELECT 'weighted', qid, id, rank FROM fused_w WHERE score >= 0.05
  UNION ALL SELECT 'rrf', qid, id, rank FROM fused_r WHERE score >= 0.001 UNION ALL SELECT 'mmr', qid, id, rank FROM mmr),
db AS (SELECT doc_id, {_PADDED.format('d')} AS s FROM documents d WHERE text IS NOT NULL),
ib AS (SELECT item_id, {_PADDED.format('i')} AS s FROM benchmark i WHERE text IS NOT NULL),
judged AS (SELECT DISTINCT item_id AS qid, doc_id AS id FROM db JOIN ib ON contains(db.s, ib.s) WHERE ib.s <> '  '),
size AS (SELECT qid, count(*) AS relevant FROM judged GROUP BY qid),
met AS (SELECT mode, qid, count(*) FILTER (rank <= 5) AS r5, count(*) FILTER (rank <= 10) AS r10, min(rank) AS first FROM every JOIN judged USING (qid, id) GROUP BY mode, qid)
SELECT mode, item_id AS qid, coalesce(relevant, 0) AS relevant, round(coalesce(r5, 0) / greatest(relevant, 1), 6)::DOUBLE AS recall5, round(coalesce(r10, 0) / greatest(relevant, 1), 6)::DOUBLE AS recall10,
  round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, first IS NOT NULL AS hit
FROM (SELECT unnest(['text', 'vector', 'weighted', 'rrf', 'mmr']) AS mode, item_id FROM benchmark) LEFT JOIN size ON size.qid = item_id LEFT JOIN (SELECT mode, qid AS item_id, r5, r10, first FROM met) USING (mode, item_id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_session_index": job1_session_index, "job2_relevance_report": job2_relevance_report}
ORACLES: dict[str, str] = {"job1_session_index": JOB1_SQL, "job2_relevance_report": JOB2_SQL}
