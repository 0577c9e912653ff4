"""Registered queries of the retrieval engine with the SQL that they are compared with.

Tables stand in for chunk tables: a document is a chunk, its embedding (if it has
one) the row of `embeddings` with its id; benchmark items are queries.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.functions import score as sc
from lodeframe.functions import text as tx
from lodeframe.operators import bm25, chunk_notes, chunk_sessions, evaluate, fusion, knn, ranking
from lodeframe.plans import jobs, search, segments, store
from lodeframe.schema import configure
from lodeframe.sources import files as sources
from lodeframe.sources.spread import spread
from lodeframe.streaming import changes

AS_OF = "2024-02-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return f"{shared or tempfile.mkdtemp(prefix='lodeframe-')}/queries/{uuid.uuid4().hex}"


class _Known:
    """An embedder of benchmark items: looks their vectors up (as many as there are queries)."""

    def __init__(self, spark, sf_dir):
        self.vectors = {r["text"]: r["vector"] for r in _items(spark, sf_dir).filter("vector IS NOT NULL").collect()}
        self.dim = len(next(iter(self.vectors.values()), []))

    def embed(self, texts, task="query"):
        return [self.vectors.get(t) or [0.0] * self.dim for t in texts]


def _rows(spark, sf_dir) -> DataFrame:
    """Documents as rows of a chunk table.

    Vectors are one per id to the optimizer, so that whoever wants texts only shuffles no text to meet them.
    """
    c = _chunks(spark, sf_dir).join(_vectors(spark, sf_dir).groupBy("id").agg(F.first("vector").alias("vector")), "id", "left")
    extra = [F.lit("p").alias("project"), F.lit(1).alias("lineNumber"), F.lit("user").alias("role"), F.create_map(F.lit("type"), F.lit("user_message")).alias("metadata")]
    return c.select("id", "text", "vector", "sessionFile", "timestamp", "source", *extra)


def _items(spark, sf_dir) -> DataFrame:
    """qid, text, vector of every benchmark item."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return items.join(vectors, "qid", "left")


def _chunks(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - (F.col("doc_id") % 90) * 86400)
    return docs.select(
        F.col("doc_id").alias("id"),
        "text",
        F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("sessionFile"),
        F.date_format(at, sc.ISO).alias("timestamp"),
        F.col("lang").alias("source"),
    )


def _vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _vector_list(spark, sf_dir, k: int = 20, least: float = 0.05) -> DataFrame:
    return knn.vector_search(_items(spark, sf_dir).select("qid", "vector"), _vectors(spark, sf_dir), k, least)


def _text_list(spark, sf_dir, k: int = 20, score: str = "bm25") -> DataFrame:
    return bm25.text_search(_items(spark, sf_dir).select("qid", "text"), _chunks(spark, sf_dir).select("id", "text"), k, score)


def _told(hits: DataFrame, spark, sf_dir, k: int = 20) -> DataFrame:
    """hits, broadcast if k per item are few enough, so that no document is shuffled to meet them."""
    return F.broadcast(hits) if read(spark, sf_dir, "benchmark").count() * 2 * k <= search.BROADCAST_HITS else hits


def _knn_sql(of: str, k: int) -> str:
    return f"""
d_{of} AS (SELECT q.qid, e.vec_id AS id, list_distance(q.v::DOUBLE[], e.embedding::DOUBLE[]) ** 2 AS distance FROM {of} q, embeddings e),
r_{of} AS (SELECT *, 1 / (1 + distance) AS score, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d_{of}),
v_{of} AS (SELECT * FROM r_{of} WHERE rank <= {k})"""


ITEM_VECTORS = "items AS (SELECT b.item_id AS qid, e.embedding AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"
BM25_SQL = r"""
w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents),
l AS (SELECT id, words, len(words) AS length FROM w),
totals AS (SELECT count(*) AS n, avg(length) AS avg_length FROM l),
qt AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark)),
p AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, length, unnest(words) AS term FROM l) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 9) AS score
  FROM qt JOIN p USING (term) JOIN f USING (term), totals GROUP BY qid, id),
rt AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s),
t AS (SELECT * FROM rt WHERE rank <= 20)"""


def _fused_sql(score: str) -> str:
    return f"""
b AS (SELECT qid, id, v.score AS vs, v.rank AS vr, t.score AS ts, t.rank AS tr FROM v_items v FULL JOIN t USING (qid, id)),
g AS (SELECT qid, id, {score} AS score, row_number() OVER (PARTITION BY qid ORDER BY vr NULLS LAST, tr) AS seq FROM b),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM g)"""


def renamed(sql: str, tail: str) -> str:
    """The common table expressions of a fusion under names of its own."""
    return re.sub(r"\b(b|g|fused)(?= AS \()|(?<=FROM )(b|g)\b", lambda m: m[0] + tail, sql)


WEIGHTED = "0.7 * coalesce(vs, 0.0::DOUBLE) + 0.3 * coalesce(ts, 0.0::DOUBLE)"
RRF = "coalesce(0.7::DOUBLE / (60 + vr), 0) + coalesce(0.3::DOUBLE / (60 + tr), 0)"
LISTS = f"WITH RECURSIVE {ITEM_VECTORS}, {_knn_sql('items', 20)}, {BM25_SQL}"
#: The lists of the whole searches, whose chunk table has vectors of documents only.
CHUNK_LISTS = LISTS.replace("embeddings e),", "embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),", 1)


# ---- vector and text search


@query(f"WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), {_knn_sql('q', 10)} SELECT qid, id, round(distance, 6) AS distance, round(score, 6) AS score, rank FROM v_q")
def knn_batch(spark, sf_dir):
    """The ten nearest vectors of every row whose id is divisible by 20."""
    v = _vectors(spark, sf_dir)
    return rounded(knn.nearest(v.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), v, 10), "distance", "score")


@query(f"WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), {_knn_sql('q', 10)} SELECT qid, id, round(score, 6) AS score, rank FROM v_q WHERE score >= 0.42")
def knn_min_score(spark, sf_dir):
    """The score filter stands after the top-k."""
    v = _vectors(spark, sf_dir)
    return rounded(knn.vector_search(v.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), v, 10, 0.42), "score")


@query(f"WITH {BM25_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM t")
def bm25_topk(spark, sf_dir):
    return rounded(_text_list(spark, sf_dir), "score")


@query(f"WITH {BM25_SQL} SELECT qid, id, round(1.0 / rank, 6)::DOUBLE AS score, rank FROM t")
def bm25_rank_score(spark, sf_dir):
    return rounded(_text_list(spark, sf_dir, score="rank"), "score")


@query(r"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS words FROM documents)
SELECT term, count(*) AS df FROM (SELECT unnest(words) AS term FROM w) GROUP BY term""")
def term_df_stats(spark, sf_dir):
    return bm25.build_index(_chunks(spark, sf_dir).select("id", "text")).terms


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents)
SELECT count(*) AS n, round(avg(len(words)), 6) AS avg_length FROM w""")
def text_index_totals(spark, sf_dir):
    return rounded(bm25.build_index(_chunks(spark, sf_dir).select("id", "text")).totals, "avg_length")


# ---- fusion and ranking


@query(f"{LISTS}, {_fused_sql(WEIGHTED)} SELECT qid, id, round(score, 6) AS score, seq, rank FROM fused")
def fuse_weighted(spark, sf_dir):
    return rounded(fusion.weighted_merge(_vector_list(spark, sf_dir), _text_list(spark, sf_dir)), "score")


@query(f"{LISTS}, {_fused_sql(RRF)} SELECT qid, id, round(score, 6) AS score, seq, rank FROM fused")
def fuse_rrf(spark, sf_dir):
    return rounded(fusion.rrf(_vector_list(spark, sf_dir), _text_list(spark, sf_dir)), "score")


@query("""
SELECT event_id, round(value * exp(-ln(2) / 14 * greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6)), 6) AS score FROM events""")
def recency_decay(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))
    return rounded(ranking.apply_decay(events, F.lit(AS_OF).cast("timestamp"), 14.0), "score").select("event_id", "score")


@query("""
SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value * exp(-ln(2) / 90 * greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6)) ELSE value END, 6) AS score FROM events""")
def decay_unparsable(spark, sf_dir):
    """Bracketed note dates and empty timestamps leave the score."""
    at = F.col("ts").cast("timestamp")
    stamp = F.when(F.col("event_id") % 3 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(F.col("event_id") % 3 == 1, F.date_format(at, "'['yyyy-MM-dd E HH:mm']'")).otherwise("")
    events = read(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), stamp.alias("timestamp"))
    return rounded(ranking.apply_decay(events, F.lit(AS_OF).cast("timestamp"), 90.0), "score").select("event_id", "score")


@query("""
SELECT event_id, round(CASE WHEN hi = lo THEN 1 ELSE (value - lo) / (hi - lo) END, 6)::DOUBLE AS scaled
FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type))""")
def min_max_scaled(spark, sf_dir):
    return rounded(read(spark, sf_dir, "events").select("event_id", sc.min_max(F.col("value"), "event_type").alias("scaled")), "scaled")


@query(r"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS s FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1 WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0
  ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6)::DOUBLE AS jaccard
FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def jaccard_neighbours(spark, sf_dir):
    sets = read(spark, sf_dir, "documents").select("doc_id", tx.token_set(F.col("text")).alias("s"))
    other = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return rounded(sets.join(other, "doc_id").select("doc_id", tx.jaccard(F.col("s"), F.col("t")).alias("jaccard")), "jaccard")


MMR_SQL = r"""
h AS (SELECT {source}),
n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM h WINDOW w AS (PARTITION BY qid)),
tok AS (SELECT DISTINCT n.id, list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+')) AS s FROM n JOIN documents d ON d.doc_id = n.id),
cand AS (SELECT n.*, tok.s FROM n JOIN tok USING (id)),
sims AS (SELECT a.qid, a.rank AS i, b.rank AS j, CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1 WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0
  ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END AS sim FROM cand a JOIN cand b ON a.qid = b.qid),
pick AS (
  SELECT DISTINCT qid, 0 AS step, []::BIGINT[] AS picked FROM cand
  UNION ALL
  SELECT qid, step + 1, list_append(any_value(picked), arg_min(rank, {{'a': -mmr, 'b': -score, 'c': rank}}))
  FROM (SELECT r.qid, r.step, r.picked, c.rank, c.score, 0.7::DOUBLE * any_value(c.norm) - 0.3::DOUBLE * coalesce(max(s.sim), 0) AS mmr
    FROM pick r JOIN cand c ON c.qid = r.qid AND NOT list_contains(r.picked, c.rank)
    LEFT JOIN sims s ON s.qid = r.qid AND s.i = c.rank AND list_contains(r.picked, s.j) GROUP BY ALL) GROUP BY qid, step),
last AS (SELECT qid, arg_max(picked, step) AS picked FROM pick GROUP BY qid),
mmr AS (SELECT c.qid, c.id, c.score, list_position(l.picked, c.rank)::BIGINT AS rank FROM cand c JOIN last l USING (qid))"""


@query(f"{LISTS}, {MMR_SQL.format(source='qid, id, score, rank FROM t')} SELECT qid, id, round(score, 6) AS score, rank FROM mmr")
def mmr_rerank(spark, sf_dir):
    hits = _chunks(spark, sf_dir).select("id", "text").join(_told(_text_list(spark, sf_dir), spark, sf_dir), "id")
    return rounded(ranking.mmr(hits).select("qid", "id", "score", F.col("rank").cast("long").alias("rank")), "score")


# ---- searches

AGED = "exp(-ln(2) / {days} * greatest(0, (doc_id % 90)::DOUBLE))"
SESSION_SQL = f"""{CHUNK_LISTS}, {_fused_sql(RRF)},
aged AS (SELECT qid, id, seq, score * {AGED.format(days=14)} AS score, lang FROM fused JOIN documents ON doc_id = id),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM aged)"""


@query(f"{SESSION_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM hits WHERE score >= 0.001 AND rank <= 10")
def hybrid_session_search(spark, sf_dir):
    """Flagship: 20 nearest and 20 text hits, reciprocal-rank fusion, two-week decay, ten best."""
    hits = search.session_search(_items(spark, sf_dir).select("qid", "text"), _rows(spark, sf_dir), _Known(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), limit=10)
    return rounded(hits.select("qid", "id", "score", "rank"), "score")


@query(f"{SESSION_SQL} SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM hits WHERE score >= 0.001 AND lang = 'en' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 10")
def source_filter_post_topk(spark, sf_dir):
    """The source filter stands after the top-k: fewer rows may stay."""
    hits = search.session_search(_items(spark, sf_dir).select("qid", "text"), _rows(spark, sf_dir), _Known(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), limit=10, source="en")
    return rounded(hits.select("qid", "id", "score", "rank"), "score")


KNOWLEDGE_SOURCE = "qid, id, score, rank FROM hits WHERE score >= 0.05"
KNOWLEDGE_SQL = f"""{CHUNK_LISTS}, {_fused_sql(WEIGHTED)},
aged AS (SELECT qid, id, seq, score * {AGED.format(days=90)} AS score FROM fused JOIN documents ON doc_id = id),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM aged), {MMR_SQL.format(source=KNOWLEDGE_SOURCE)}"""


@query(f"{KNOWLEDGE_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM mmr WHERE rank <= 10")
def hybrid_knowledge_search(spark, sf_dir):
    """Weighted merge, 90-day decay, least score, diversity, ten best."""
    hits = search.knowledge_search(_items(spark, sf_dir).select("qid", "text"), _rows(spark, sf_dir), _Known(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), limit=10)
    return rounded(hits.select("qid", "id", "score", F.col("rank").cast("long").alias("rank")), "score")


@query(f"WITH {BM25_SQL} SELECT qid, id, round(score, 6) AS score, rank FROM t")
def stored_index_search(spark, sf_dir):
    """Text search over an index that was written and read back."""
    folder = _folder(spark)
    bm25.build_index(_chunks(spark, sf_dir).select("id", "text")).write(folder)
    hits = bm25.text_search(_items(spark, sf_dir).select("qid", "text"), bm25.TextIndex.read(spark, folder), 20)
    return rounded(hits.select("qid", "id", "score", "rank"), "score")


@query(f"""{LISTS}, {_fused_sql(RRF)}, own AS (SELECT * FROM fused WHERE rank <= qid % 6),
thin AS (SELECT b.item_id AS qid FROM benchmark b LEFT JOIN own ON own.qid = b.item_id GROUP BY 1 HAVING count(own.id) < 3 OR coalesce(max(score), 0) < 0.005),
spare AS (SELECT t.* FROM t JOIN thin USING (qid) WHERE rank <= 3),
both_ AS (SELECT qid, id, score, rank, 0 AS block, qid IN (SELECT qid FROM spare) AS fallback FROM own WHERE NOT (qid IN (SELECT qid FROM spare)) OR rank <= 7
  UNION ALL SELECT qid, id, score, rank, 1, true FROM spare)
SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY block, rank) AS rank, fallback FROM both_
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY block, rank) <= 10""")
def thin_fallback(spark, sf_dir):
    """Queries with thin results are eked out with the first three of another list."""
    text = _text_list(spark, sf_dir).persist()  # 20 rows per query, used twice; a lost part is computed again
    own = fusion.rrf(_vector_list(spark, sf_dir), text).drop("seq").filter("rank <= qid % 6").persist()
    spare = text.join(F.broadcast(search.thin_queries(own, _items(spark, sf_dir))), "qid", "left_semi").select("qid", "id", "score", "rank")
    return rounded(search.splice(own, spare, 10), "score")


SPARE_SOURCE = "qid, id, score, rank FROM hits_n WHERE score >= 0.05 AND qid IN (SELECT qid FROM thin)"
NOTES_SQL = f"""{CHUNK_LISTS}, {renamed(_fused_sql(RRF), '_r')},
aged_r AS (SELECT qid, id, seq, score * {AGED.format(days=14)} AS score FROM fused_r JOIN documents ON doc_id = id),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM aged_r) WHERE score >= 0.001),
thin AS (SELECT item_id AS qid FROM benchmark LEFT JOIN own ON own.qid = item_id GROUP BY 1 HAVING count(own.id) < 3 OR coalesce(max(score), 0) < 0.005),
v_few AS (SELECT * FROM v_items WHERE rank <= 10), t_few AS (SELECT * FROM t WHERE rank <= 10), {renamed(_fused_sql(WEIGHTED), '_n').replace('v_items v FULL JOIN t USING', 'v_few v FULL JOIN t_few t USING')},
aged_n AS (SELECT qid, id, seq, score * {AGED.format(days=90)} AS score FROM fused_n JOIN documents ON doc_id = id),
hits_n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM aged_n), {MMR_SQL.format(source=SPARE_SOURCE)},
spare AS (SELECT qid, id, score, rank FROM mmr WHERE rank <= 3),
both_ AS (SELECT qid, id, score, rank, 0 AS block, qid IN (SELECT qid FROM spare) AS fallback FROM own WHERE NOT (qid IN (SELECT qid FROM spare)) OR rank <= 7
  UNION ALL SELECT qid, id, score, rank, 1, true FROM spare)"""


@query(f"""{NOTES_SQL}
SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY block, rank) AS rank, fallback FROM both_
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY block, rank) <= 10""")
def session_search_with_notes(spark, sf_dir):
    """Session search over a stored index, eked out by a note search where it finds little."""
    folder = _folder(spark)
    bm25.build_index(_chunks(spark, sf_dir).select("id", "text")).write(folder)
    index, rows, known = bm25.TextIndex.read(spark, folder), _rows(spark, sf_dir), _Known(spark, sf_dir)
    asked, as_of = _items(spark, sf_dir).select("qid", "text"), F.lit(AS_OF).cast("timestamp")
    hits = search.session_search(asked, rows, known, as_of, limit=10, notes=rows, note_embedder=known, index=index, note_index=index)
    return rounded(hits.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"), "fallback"), "score")


@query("""
WITH q AS (SELECT conv_id * 1000 + turn AS qid, CASE conv_id % 3 WHEN 0 THEN text || ' 보편 학문이란 knowledge' WHEN 1 THEN text || ' 바흐, 보편' ELSE text END AS text, conv_id % 3 AS k FROM conversations)
SELECT qid, text || CASE k WHEN 0 THEN ' universal general study' WHEN 1 THEN ' bach universal general' ELSE '' END AS enriched FROM q""")
def query_expansion(spark, sf_dir):
    """Hangul terms bring their dictionary expansions, each once, to the embedded text."""
    k = F.col("conv_id") % 3
    text = F.when(k == 0, F.concat("text", F.lit(" 보편 학문이란 knowledge"))).when(k == 1, F.concat("text", F.lit(" 바흐, 보편"))).otherwise(F.col("text"))
    said = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), text.alias("text"))
    words = spark.createDataFrame([("보편", ["universal", "general"]), ("바흐", ["bach"]), ("학문이란", ["study", "universal"])], "term string, expansions array<string>")
    return search.expand_queries(said, words).select("qid", "enriched")


# ---- text functions


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::INT AS n, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))::INT AS n_distinct FROM documents")
def token_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"), F.size(tx.token_set(F.col("text"))).alias("n_distinct"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text FROM documents")
def truncate_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text"), 2000).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '보편|학문' ELSE '' END AS terms FROM conversations")
def hangul_terms(spark, sf_dir):
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("보편 "), "text", F.lit("학문"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.hangul_terms(text), "|").alias("terms"))


@query("""
SELECT doc_id, source || chr(10) || '[' || lang || ', x]' || chr(10) || '> Top > ' || lang || chr(10) || '(New)' || chr(10) || chr(10) || text AS enriched FROM documents""")
def enriched_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tags = F.array("lang", F.lit("x"))
    own = F.array(F.lit("New"), F.lit("X"), F.upper("lang"))
    return docs.select("doc_id", tx.enriched(F.col("source"), tags, F.concat(F.lit("Top > "), "lang"), own, F.lit(False), F.col("text")).alias("enriched"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'proj-' || source WHEN 1 THEN source WHEN 2 THEN 'home' WHEN 3 THEN 'x' || source ELSE 'unknown' END AS project,
  CASE WHEN doc_id % 5 = 0 THEN 'claude' ELSE 'pi' END AS source FROM documents""")
def project_names(spark, sf_dir):
    k, s = F.col("doc_id") % 5, F.col("source")
    path = (
        F.when(k == 0, F.concat(F.lit("/h/.claude/projects/-home-u-repos-gh-proj-"), s, F.lit("/a.jsonl")))
        .when(k == 1, F.concat(F.lit("/h/.pi/agent/sessions/--home-u-"), s, F.lit("--/a.jsonl")))
        .when(k == 2, F.lit("/h/.pi/agent/sessions/--home-u--/a.jsonl"))
        .when(k == 3, F.concat(F.lit("/tmp/x"), s, F.lit("/a.jsonl")))
        .otherwise(F.lit("/tmp/---/a.jsonl"))
    )
    return read(spark, sf_dir, "documents").select("doc_id", tx.project_of(path).alias("project"), tx.source_of(path).alias("source"))


# ---- chunkers


@query("""
SELECT conv_id, turn, role, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text FROM conversations
WHERE (role = 'user' AND length(text) > 20) OR (role = 'assistant' AND length(text) > 100)""")
def session_chunks(spark, sf_dir):
    """Length rules per role, and truncation at 500."""
    return chunk_sessions.message_chunks(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), 500)


@query("""
SELECT role, count(*) AS n FROM conversations WHERE (role = 'user' AND length(text) > 20) OR (role = 'assistant' AND length(text) > 100) GROUP BY role""")
def session_chunk_counts(spark, sf_dir):
    return chunk_sessions.message_chunks(read(spark, sf_dir, "conversations")).groupBy("role").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN '/h/.claude/projects/-home-u-repos-work-p' || conv_id || '/s.jsonl' ELSE '/h/.pi/agent/sessions/--home-u-p' || conv_id || '--/s.jsonl' END AS file FROM conversations
  WHERE (role = 'user' AND length(text) > 20) OR (role = 'assistant' AND length(text) > 100))
SELECT file || ':' || (turn + 1) AS id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text, 'p' || conv_id AS project, (turn + 1)::INT AS line,
  CASE WHEN conv_id % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE strftime(make_timestamp_ms(1700000000000 + turn * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS timestamp,
  role, CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'pi' END AS source FROM m""")
def session_jsonl(spark, sf_dir):
    """Conversations written as JSON lines of both layouts and read back as chunks."""
    c = read(spark, sf_dir, "conversations")
    claude = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("tool_use").alias("type"), F.lit("x").alias("text"))).alias("content")).alias("message")))
    pi = F.to_json(F.struct(F.lit("message").alias("type"), (F.lit(1_700_000_000_000) + F.col("turn") * 1000).alias("timestamp"), F.struct("role", F.col("text").alias("content")).alias("message")))
    is_claude = F.col("conv_id") % 2 == 0
    file = F.when(is_claude, F.concat(F.lit("/h/.claude/projects/-home-u-repos-work-p"), "conv_id", F.lit("/s.jsonl"))).otherwise(F.concat(F.lit("/h/.pi/agent/sessions/--home-u-p"), "conv_id", F.lit("--/s.jsonl")))
    lines = c.select(file.alias("sessionFile"), (F.col("turn") + 1).cast("int").alias("lineNumber"), F.when(is_claude, claude).otherwise(pi).alias("line"))
    return chunk_sessions.session_chunks(lines).select("id", "text", "project", F.col("lineNumber").alias("line"), "timestamp", "role", "source")


@query("""
WITH f AS (SELECT *, conv_id % 2 = 0 AS claude, CASE WHEN conv_id % 2 = 0 THEN '/h/.claude/projects/-home-u-repos-work-p' || conv_id || '/s' || turn || '.jsonl' ELSE '/h/.pi/agent/sessions/--home-u-p' || conv_id || '--/s' || turn || '.jsonl' END AS file FROM conversations),
r AS (
  SELECT file, conv_id, claude, 3 AS line, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text, role, CASE role WHEN 'user' THEN 'user_message' ELSE 'assistant_response' END AS type
  FROM f WHERE (role = 'user' AND length(text) > 20) OR (role = 'assistant' AND length(text) > 100)
  UNION ALL SELECT file, conv_id, claude, 6, 'sum ' || conv_id, 'compaction', 'compaction' FROM f WHERE NOT claude)
SELECT file || ':' || line AS id, text, 'p' || conv_id AS project, line::INT AS line, CASE WHEN claude THEN '2024-01-01T00:00:00Z' WHEN line = 3 THEN '2023-11-14T22:13:20.000Z' ELSE '' END AS timestamp,
  role, CASE WHEN claude THEN 'claude' ELSE 'pi' END AS source, type FROM r""")
def session_files(spark, sf_dir):
    """Whole session files with bad, blank, null and non-object lines, both line ends, and a compaction."""
    c = read(spark, sf_dir, "conversations")
    is_claude = F.col("conv_id") % 2 == 0
    claude = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct("role", F.col("text").alias("content")).alias("message")))
    pi = F.to_json(F.struct(F.lit("message").alias("type"), F.lit(1_700_000_000_000).alias("timestamp"), F.struct("role", F.col("text").alias("content")).alias("message")))
    summary = F.to_json(F.struct(F.lit("compaction").alias("type"), F.struct(F.concat(F.lit("sum "), "conv_id").alias("summary")).alias("compaction")))
    file = F.when(is_claude, F.concat(F.lit("/h/.claude/projects/-home-u-repos-work-p"), "conv_id", F.lit("/s"))).otherwise(F.concat(F.lit("/h/.pi/agent/sessions/--home-u-p"), "conv_id", F.lit("--/s")))
    content = F.concat(F.lit("{not json\r\n \r\n"), F.when(is_claude, claude).otherwise(pi), F.lit("\r\nnull\n[1]\n"), summary, F.lit("\n"))
    files = c.select(F.concat(file, "turn", F.lit(".jsonl")).alias("path"), content.alias("content"))
    return chunk_sessions.extract_sessions(files).select("id", "text", "project", F.col("lineNumber").alias("line"), "timestamp", "role", "source", F.col("metadata")["type"].alias("type"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, (3 * k - 1)::INT AS line, role, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text, CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'pi' END AS source FROM r
WHERE (role = 'user' AND length(text) > 20) OR (role = 'assistant' AND length(text) > 100)""")
def session_logs(spark, sf_dir):
    """Log files of all conversations, a bad line before and a blank one after each turn, read in splits and numbered."""
    c = read(spark, sf_dir, "conversations")
    claude = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    pi = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    line = F.concat(F.lit("{bad\r\n"), F.when(F.col("conv_id") % 2 == 0, claude).otherwise(pi), F.lit("\r\n"))
    folder, layouts = _folder(spark), {0: ".claude/projects", 1: ".pi/agent/sessions"}
    for rest, layout in layouts.items():
        own = c.filter(F.pmod("conv_id", F.lit(2)) == rest).select("conv_id", "turn", line.alias("line"))
        own.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("line", F.col("conv_id").alias("of")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("of").text(f"{folder}/{layout}")  # version 2: tasks move their files, not the driver all of them
    lines = sources.numbered_lines(spark, [f"{folder}/{layout}" for layout in layouts.values()], "*.txt")
    chunks = chunk_sessions.session_chunks(chunk_sessions.said_lines(lines))
    return chunks.select(F.regexp_extract("sessionFile", r"/of=(\d+)/", 1).cast("long").alias("conv_id"), F.col("lineNumber").alias("line"), "role", "text", "source")


@query("""
WITH RECURSIVE ln AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(list_transform(a, lambda x: length(x) + 1)) AS cost FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE length(text) > 1000)),
p AS (SELECT doc_id, i, coalesce(sum(cost) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre, cost FROM ln),
k AS (SELECT doc_id, list(pre ORDER BY i) || [sum(cost)::BIGINT] AS pre, count(*) AS n FROM p GROUP BY doc_id),
c AS (
  SELECT doc_id, 0::BIGINT AS j, 0::BIGINT AS start, list_min(list_filter(range(1, n + 1), lambda x: x = n OR pre[x + 2] - pre[1] > 1000)) AS stop, pre, n FROM k
  UNION ALL
  SELECT doc_id, j + 1, s, list_min(list_filter(range(stop + 1, n + 1), lambda x: x = n OR pre[x + 2] - pre[s + 1] > 1000)), pre, n
  FROM (SELECT *, coalesce(list_max(list_filter(range(start, stop + 1), lambda x: pre[stop + 1] - pre[x + 1] >= 150)), start) AS s FROM c WHERE stop < n))
SELECT doc_id, j::INT AS j, start::INT AS start, (stop - start)::INT AS n_lines FROM c
UNION ALL SELECT doc_id, 0, 0, len(string_split(text, chr(10)))::INT FROM documents WHERE length(text) <= 1000""")
def sub_chunks(spark, sf_dir):
    """Greedy line packing at 1,000 units with an overlap of 150."""
    cut = read(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(chunk_notes.sub_chunks(F.col("text"), F.lit(1000), F.lit(150))).alias("j", "c"))
    return cut.select("doc_id", "j", F.col("c.offsetLines").alias("start"), F.size(F.split("c.text", "\n")).alias("n_lines"))


def _outline(text: Column) -> Column:
    """A note made of a document: every other line a heading of level 1 to 3, some archived."""

    def line(x, i):
        return (
            F.when(i % 5 == 0, F.concat(F.lit("* "), x)).when(i % 5 == 2, F.concat(F.lit("** "), x)).when((i % 5 == 4) & (i % 10 == 4), F.concat(F.lit("*** "), x, F.lit(" :ARCHIVE:x:"))).when(i % 5 == 4, F.concat(F.lit("*** "), x)).otherwise(x)
        )

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


HEADINGS_SQL = """
ln AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
hd AS (SELECT doc_id, i, n, CASE i % 5 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS level, trim(x) AS title, i % 10 = 4 AS archived FROM ln WHERE i % 5 IN (0, 2, 4) AND trim(x) <> ''),
hw AS (SELECT *, list({'level': level, 'title': title, 'i': i}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  list({'level': level, 'i': i}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM hd)"""


def _notes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("/org/notes/"), F.col("doc_id").cast("string"), F.lit(".org")).alias("path"), _outline(F.col("text")).alias("content"))


@query(f"""WITH {HEADINGS_SQL}
SELECT '/org/notes/' || doc_id || '.org' AS path, level::INT AS level, title, (i + 1)::INT AS line, archived,
  array_to_string(list_transform(list_filter(coalesce(before, []), lambda h: h.level < hw.level AND h.i >= coalesce(list_max(list_transform(list_filter(coalesce(before, []), lambda t: t.level = 1), lambda t: t.i)), 0)), lambda h: h.title) || [title], ' > ') AS hierarchy
FROM hw""")
def note_headings(spark, sf_dir):
    """Headings of outlines with their lookup path: every earlier heading of a lower level, back to level 1."""
    h = chunk_notes.note_headings(_notes(spark, sf_dir))
    return h.select("path", "level", "title", F.col("lineNumber").alias("line"), F.col("isArchive").alias("archived"), "hierarchy")


@query(f"""WITH {HEADINGS_SQL}
SELECT '/org/notes/' || doc_id || '.org' AS path, (i + 1)::INT AS line, coalesce(list_filter(coalesce(after, []), lambda h: h.level <= hw.level)[1].i, n)::INT AS section_end FROM hw""")
def note_sections(spark, sf_dir):
    """A section runs to the next heading of its level or a lower one."""
    return chunk_notes.note_headings(_notes(spark, sf_dir)).select("path", F.col("lineNumber").alias("line"), F.col("sectionEnd").alias("section_end"))


@query("""
SELECT doc_id, '20240101T000000' AS identifier, CASE WHEN doc_id % 3 = 0 THEN 't-' || doc_id ELSE '§ ' || source || ' ' || doc_id END AS title,
  CASE WHEN doc_id % 3 = 0 THEN lang || ',y' ELSE lang || ',x' END AS tags, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '[2024-01-01]' END AS date, 'notes' AS folder,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a,b c' END AS refs, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '§' END AS prefix, doc_id % 3 = 1 AS gptel FROM documents""")
def note_front_matter(spark, sf_dir):
    """Front matter of notes, or the parts of the file name where there is none."""
    k = F.col("doc_id") % 3
    header = F.concat(F.lit("#+title: § "), "source", F.lit(" "), "doc_id", F.lit("\n#+date: [2024-01-01]\n#+FILETAGS: :"), "lang", F.lit(":x:\n#+reference: a; b c;\n"), F.when(k == 1, F.lit(":GPTEL_MODEL: m\n")).otherwise(""))
    content = F.concat(F.when(k == 0, F.lit("plain")).otherwise(header), F.lit("\n* H\n#+title: late\n"), "text")
    path = F.concat(F.lit("/n/org/notes/20240101T000000--t-"), "doc_id", F.lit("__"), "lang", F.lit("_y.org"))
    m = read(spark, sf_dir, "documents").select("doc_id", chunk_notes.front_matter(content, path).alias("m"))
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return m.select("doc_id", "m.identifier", "m.title", joined("m.filetags", "tags"), "m.date", "m.folder", joined("m.references", "refs"), F.col("m.titlePrefix").alias("prefix"), F.col("m.hasGptelProps").alias("gptel"))


def _full_notes(spark, sf_dir) -> DataFrame:
    """Notes with front matter, drawers, blocks, directives and tags, made of all documents; the lines are the documents'."""

    def line(x, i):
        told = (
            F.when(i % 7 == 0, F.concat(F.lit("* "), x, F.lit(" :Alpha:y:\n:PROPERTIES:\n:ID: 1\n:END:")))
            .when(i % 7 == 2, F.concat(F.lit("** "), x, F.lit("\n#+BEGIN_SRC sql\nSELECT 1\n#+END_SRC")))
            .when(i % 14 == 4, F.concat(F.lit("*** "), x, F.lit(" :ARCHIVE:")))
            .when(i % 14 == 11, F.concat(F.lit("*** "), x, F.lit("\n  #+Title: gone\n#+begin_note\n#+Begin_kept")))
            .when(i % 21 == 5, F.concat(F.lit(" :PROPERTIES: \n"), x))  # closed by a later drawer's end, or by none
        )
        return F.coalesce(told, x)

    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    folder = F.element_at(F.array(F.lit("notes"), F.lit("journal"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/n/org/"), folder, F.lit("/20240101T000000--t__alpha_"), "lang", F.lit("-"), "doc_id", F.lit(".org"))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("#+title: On "), "source", F.lit("\n#+filetags: :alpha:"), "lang", F.lit(":\n"))).otherwise("")
    return read(spark, sf_dir, "documents").select(path.alias("path"), F.concat(head, body).alias("content"))


_BLANK = r"[\s\v\p{Z}\x{FEFF}]"


def _trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_HEADING = rf"^(\*+){_BLANK}+(.+?)(?:{_BLANK}+(:[a-zA-Z0-9_:]+:))?{_BLANK}*$"
_BARE = r"regexp_replace(x, '^[\s\v]+|[\s\v]+$', '', 'g')"
#: Notes of documents, their lines, headings, sections, and the greedy packing of the sections' lines.
NOTE_CHUNKS_SQL = rf"""
WITH RECURSIVE raw AS (SELECT doc_id, lang, source, ['notes', 'journal', 'other'][(doc_id % 3 + 1)::INT] AS folder, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
made AS (SELECT doc_id, lang, source, folder, '/n/org/' || folder || '/20240101T000000--t__alpha_' || lang || '-' || doc_id || '.org' AS path,
  CASE WHEN doc_id % 2 = 0 THEN '#+title: On ' || source || chr(10) || '#+filetags: :alpha:' || lang || ':' || chr(10) ELSE '' END || array_to_string(list_transform(a, lambda x, k:
    CASE WHEN (k - 1) % 7 = 0 THEN '* ' || x || ' :Alpha:y:' || chr(10) || ':PROPERTIES:' || chr(10) || ':ID: 1' || chr(10) || ':END:'
      WHEN (k - 1) % 7 = 2 THEN '** ' || x || chr(10) || '#+BEGIN_SRC sql' || chr(10) || 'SELECT 1' || chr(10) || '#+END_SRC'
      WHEN (k - 1) % 14 = 4 THEN '*** ' || x || ' :ARCHIVE:'
      WHEN (k - 1) % 14 = 11 THEN '*** ' || x || chr(10) || '  #+Title: gone' || chr(10) || '#+begin_note' || chr(10) || '#+Begin_kept'
      WHEN (k - 1) % 21 = 5 THEN ' :PROPERTIES: ' || chr(10) || x ELSE x END), chr(10)) AS content FROM raw),
notes AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'On ' || source ELSE 't' END AS title, ['alpha', CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '-' || doc_id END] AS filetags, folder IN ('journal') AS short
  FROM made WHERE length(content) >= 50),
ln AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i, len(a) AS n FROM (SELECT doc_id, string_split(content, chr(10)) AS a FROM notes)),
hd AS (SELECT doc_id, i, n, length(regexp_extract(x, '^(\*+)', 1)) AS level,
    {_trimmed(f"regexp_extract(x, '{_HEADING}', 2)")} AS title,
    list_filter(string_split(regexp_extract(x, '{_HEADING}', 3), ':'), lambda t: t <> '') AS tags
  FROM ln WHERE regexp_matches(x, '{_HEADING}')),
hw AS (SELECT *, list_contains(tags, 'ARCHIVE') AS archived,
  coalesce(list({{'level': level, 'title': title, 'i': i}}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before,
  coalesce(list({{'level': level, 'i': i}}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), []) AS after FROM hd),
hs AS (SELECT doc_id, i, tags, title, i + 1 AS start, coalesce(list_filter(after, lambda h: h.level <= hw.level)[1].i, n) AS stop,
  array_to_string(list_transform(list_filter(before, lambda h: h.level < hw.level AND h.i >= coalesce(list_max(list_transform(list_filter(before, lambda t: t.level = 1), lambda t: t.i)), 0)), lambda h: h.title) || [title], ' > ') AS hierarchy
  FROM hw WHERE NOT archived
  UNION ALL SELECT doc_id, NULL, [], NULL, 0, any_value(n), '' FROM ln WHERE doc_id NOT IN (SELECT doc_id FROM hd) GROUP BY doc_id),
sl AS (SELECT hs.doc_id, hs.start, ln.i, x, CASE WHEN {_BARE} = ':PROPERTIES:' THEN 1 WHEN {_BARE} = ':END:' THEN 2 END AS mark FROM hs JOIN ln ON ln.doc_id = hs.doc_id AND ln.i >= hs.start AND ln.i < hs.stop),
sm AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS now, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM sl WINDOW w AS (PARTITION BY doc_id, start ORDER BY i)),
kept AS (SELECT doc_id, start, i, x FROM sm WHERE coalesce(now, 0) <> 1 AND NOT (coalesce(mark, 0) = 2 AND coalesce(was, 0) = 1)
  AND NOT regexp_matches(x, '^[\s\v]*#\+(BEGIN_|END_|begin_|end_)') AND NOT regexp_matches(x, '(?i)^[\s\v]*#\+(title|date|filetags|identifier|export|hugo|description|OPTIONS|STARTUP|reference)')),
body AS (SELECT doc_id, start, {_trimmed("string_agg(x, chr(10) ORDER BY i)")} AS text FROM kept GROUP BY doc_id, start),
sized AS (SELECT hs.*, body.text, CASE WHEN short THEN 3200 ELSE 4000 END AS most, CASE WHEN short THEN 200 ELSE 300 END AS overlap FROM hs JOIN body USING (doc_id, start) JOIN notes USING (doc_id) WHERE length(body.text) >= 30),
bl AS (SELECT doc_id, start, most, overlap, unnest(a) AS x, unnest(range(len(a))) AS k FROM (SELECT doc_id, start, most, overlap, string_split(text, chr(10)) AS a FROM sized WHERE length(text) > most)),
p AS (SELECT doc_id, start, most, overlap, list(x ORDER BY k) AS x, [0] || list(pre ORDER BY k) AS pre, count(*) AS n FROM (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id, start ORDER BY k)::BIGINT AS pre FROM bl) GROUP BY ALL),
c AS (
  SELECT doc_id, start, most, overlap, x, pre, n, 0::BIGINT AS j, 0::BIGINT AS a, list_min(list_filter(range(1, n + 1), lambda y: y = n OR pre[y + 2] > most)) AS z FROM p
  UNION ALL
  SELECT doc_id, start, most, overlap, x, pre, n, j + 1, s, list_min(list_filter(range(z + 1, n + 1), lambda y: y = n OR pre[y + 2] - pre[s + 1] > most))
  FROM (SELECT *, coalesce(list_max(list_filter(range(a, z + 1), lambda y: pre[z + 1] - pre[y + 1] >= overlap)), a) AS s FROM c WHERE z < n)),
pieces AS (SELECT doc_id, start, j, a, z - a AS n, array_to_string(x[a + 1:z], chr(10)) AS raw FROM c
  UNION ALL SELECT doc_id, start, 0, 0, len(string_split(text, chr(10))), text FROM sized WHERE length(text) <= most),
every AS (
  SELECT doc_id, i, tags, hierarchy, 'heading' AS kind, 0 AS j, '' AS raw, i + 1 AS line, i + 1 AS last FROM hs WHERE i IS NOT NULL
  UNION ALL SELECT doc_id, i, tags, hierarchy, 'content', j, raw, CASE WHEN i IS NULL THEN a + 1 ELSE i + 1 + a END, CASE WHEN i IS NULL THEN a + pieces.n ELSE i + 1 + a + pieces.n END FROM pieces JOIN hs USING (doc_id, start)),
rich AS (SELECT every.*, path, concat_ws(chr(10), n.title, '[' || array_to_string(filetags, ', ') || ']', CASE WHEN hierarchy <> '' AND hierarchy <> n.title THEN '> ' || hierarchy END,
    CASE WHEN len(list_filter(tags, lambda t: NOT list_contains(filetags, lower(t)))) > 0 THEN '(' || array_to_string(list_filter(tags, lambda t: NOT list_contains(filetags, lower(t))), ', ') || ')' END,
    CASE WHEN raw <> '' THEN chr(10) || raw END) AS text FROM every JOIN notes n USING (doc_id))
SELECT path || CASE WHEN kind = 'heading' THEN ':h' || line WHEN i IS NULL THEN ':c' || j ELSE ':c' || (i + 1) || ':' || j END AS id, text, path, line::INT AS line, last::INT AS last, kind, hierarchy
FROM rich WHERE kind = 'content' OR length(text) >= 20"""


@query(NOTE_CHUNKS_SQL)
def note_chunks(spark, sf_dir):
    """Both tiers of chunks of notes made of all documents."""
    chunks = chunk_notes.note_chunks(_full_notes(spark, sf_dir))
    return chunks.select("id", "text", "path", F.col("lineNumber").alias("line"), F.col("endLineNumber").alias("last"), F.col("chunkType").alias("kind"), "hierarchy")


# ---- store and maintenance


@query("SELECT doc_id, '/' || source || '/' || doc_id AS path FROM documents WHERE doc_id % 3 <> 0")
def incremental_diff(spark, sf_dir):
    """Files that are not indexed yet."""
    files = _chunks(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("sessionFile").alias("path"))
    return store.unindexed(files, _chunks(spark, sf_dir).filter("id % 3 = 0").select("sessionFile")).select("doc_id", "path")


@query("""
SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 4 = 0)
UNION ALL SELECT conv_id, turn, 'new ' || text FROM conversations WHERE conv_id % 4 = 0 AND turn % 2 = 0""")
def upsert_by_file(spark, sf_dir):
    """All rows of the files that a batch brings are replaced by the batch's."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return store.replaced(rows, rows.filter("conv_id % 4 = 0 AND turn % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text")), "conv_id")


def _turns(spark, sf_dir) -> DataFrame:
    """Messages as rows of a chunk table, a file per conversation."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "text", F.array(F.col("turn").cast("float")).alias("vector"), F.concat(F.lit("/c/"), "conv_id").alias("sessionFile"), F.lit("p").alias("project"),
        F.col("turn").cast("int").alias("lineNumber"), F.lit("").alias("timestamp"), "role", F.lit("pi").alias("source"), F.create_map(F.lit("type"), F.lit("x")).alias("metadata"), "conv_id",
    )


def _store(spark, sf_dir) -> store.ChunkStore:
    """A store that was filled, had a quarter of its files replaced and a fifth removed, and was compacted."""
    turns, kept = _turns(spark, sf_dir), store.ChunkStore(spark, _folder(spark), 1, buckets=8).ensure()
    kept.upsert(turns.drop("conv_id"))
    kept.upsert(turns.filter("conv_id % 4 = 0 AND lineNumber % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text")).drop("conv_id"))
    kept.delete_files(turns.filter("conv_id % 5 = 0").select("sessionFile"))
    kept.compact()
    return kept


STORED = """
s AS (SELECT conv_id, turn, text FROM conversations WHERE conv_id % 5 <> 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 4 = 0 AND turn % 2 = 0)
  UNION ALL SELECT conv_id, turn, 'new ' || text FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 4 = 0 AND turn % 2 = 0)"""


@query(f"WITH {STORED} SELECT conv_id || ':' || turn AS id, '/c/' || conv_id AS file, turn::INT AS line, text FROM s")
def store_rows(spark, sf_dir):
    """The rows of a chunk store after writes, replacement, removal and compaction."""
    return _store(spark, sf_dir).rows().select("id", F.col("sessionFile").alias("file"), F.col("lineNumber").alias("line"), "text")


@query(rf"""WITH {STORED}, w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM s),
f AS (SELECT term, conv_id, turn, count(*) AS tf FROM w GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, (SELECT count(*) FROM s) AS n, round((SELECT count(*) FROM w) / (SELECT count(*) FROM s), 6) AS avg_length FROM f GROUP BY term""")
def segmented_index(spark, sf_dir):
    """Term statistics of an index in segments: after a fill, a replacement, a removal and a compaction in between."""
    turns, kept = _turns(spark, sf_dir).drop("conv_id"), segments.TextSegments(spark, _folder(spark))
    conv = F.substring("sessionFile", 4, 20).cast("long")
    kept.add(1, turns.filter(conv % 3 == 0))
    kept.add(2, turns.filter(conv % 3 > 0))
    kept.compact(3)
    kept.add(4, turns.filter((conv % 4 == 0) & (F.col("lineNumber") % 2 == 0)).withColumn("text", F.concat(F.lit("new "), "text")))
    kept.add(5, turns.limit(0), turns.filter(conv % 5 == 0).select("sessionFile"))
    index = kept.index()
    by_term = index.postings.groupBy("term").agg(F.sum("tf").alias("tf")).join(index.terms, "term")
    return rounded(by_term.crossJoin(F.broadcast(index.totals)), "avg_length").select("term", "df", "tf", "n", "avg_length")  # totals is one row


@query(f"WITH {STORED} SELECT DISTINCT '/c/' || conv_id AS file FROM s")
def distinct_files(spark, sf_dir):
    """The files that a store has rows of."""
    return _store(spark, sf_dir).files().select(F.col("sessionFile").alias("file"))


@query(f"WITH {STORED} SELECT count(*) AS chunks, count(DISTINCT conv_id) AS indexed_files, (SELECT count(DISTINCT conv_id) FROM conversations) AS total_files, true AS indexed FROM s")
def store_status(spark, sf_dir):
    """Counts of a store's status report."""
    told = jobs.status(_store(spark, sf_dir), _turns(spark, sf_dir).select("sessionFile").distinct())
    row = [(told["chunks"], told["indexed_files"], told["total_files"], told["indexed"])]
    return spark.createDataFrame(row, "chunks long, indexed_files long, total_files long, indexed boolean")


@query("SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def status_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("files"), F.sum(F.length("text")).alias("chars"))


@query("""
SELECT event_id FROM events WHERE event_id % 7 <> 0 OR ts > TIMESTAMP '2024-01-29' OR event_id % 1000 = 14""")
def reindex_set(spark, sf_dir):
    """What is new, or was modified in the last 24 hours, or belongs to the current session; each once."""
    e = read(spark, sf_dir, "events")
    path = F.when(F.col("event_id") % 1000 == 14, F.concat(F.lit("/s/current-"), "event_id", F.lit(".jsonl"))).otherwise(F.concat(F.lit("/s/"), "event_id", F.lit(".jsonl")))
    files = e.select("event_id", path.alias("path"), F.col("ts").cast("timestamp").alias("modified"))
    indexed = files.filter("event_id % 7 = 0").select(F.col("path").alias("sessionFile"))
    return store.to_reindex(files, indexed, F.lit("2024-01-30").cast("timestamp"), "/s/current-.x").select("event_id")


@query("""
SELECT '/s/' || event_id AS path, CASE WHEN event_id % 5 = 0 THEN 'removed' WHEN event_id % 7 = 0 THEN 'new' ELSE 'modified' END AS change FROM events
WHERE event_id % 35 <> 0 AND (event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0)""")
def changed_files(spark, sf_dir):
    """What is new, edited (another time or size) or gone between two listings."""
    e = read(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    files = e.select("event_id", F.concat(F.lit("/s/"), "event_id").alias("path"), at.alias("modified"), F.length("props").cast("long").alias("bytes"))
    now = files.filter("event_id % 5 <> 0")
    later = F.when(F.col("event_id") % 11 == 0, F.col("modified") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("modified"))
    seen = files.filter("event_id % 7 <> 0").withColumns({"modified": later, "bytes": F.col("bytes") + (F.col("event_id") % 13 == 0).cast("long")})
    return changes.changed(now, seen)


# ---- evaluation


def _judged(spark, sf_dir) -> DataFrame:
    k = F.col("qid") % 20
    want = lambda n: F.concat(F.lit("/src"), (n % 20).cast("string"), F.lit("/"))
    kind = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("qid") % 3 + 1).cast("int"))
    return _items(spark, sf_dir).select("qid", F.array(want(k), want(k + 7)).alias("expected"), F.concat(F.lit("c"), (F.col("qid") % 4).cast("string")).alias("category"), kind.alias("difficulty"))


def _scored(spark, sf_dir, hits: DataFrame) -> DataFrame:
    paths = _chunks(spark, sf_dir).select("id", F.col("sessionFile").alias("path"))
    return evaluate.metrics(paths.join(_told(hits, spark, sf_dir), "id").select("qid", "path", "rank"), _judged(spark, sf_dir))


def _metrics_sql(name: str, source: str) -> str:
    return f"""
{name}_x AS (SELECT b.item_id AS qid, unnest([0, 1]) AS e, unnest(['/src' || (b.item_id % 20) || '/', '/src' || ((b.item_id % 20 + 7) % 20) || '/']) AS want FROM benchmark b),
{name}_m AS (SELECT x.qid, x.e, h.rank FROM {name}_x x JOIN {source} h USING (qid) JOIN documents d ON d.doc_id = h.id WHERE contains('/' || d.source || '/' || d.doc_id, x.want)),
{name} AS (SELECT item_id AS qid, 'c' || (item_id % 4) AS category, ['easy', 'medium', 'hard'][(item_id % 3 + 1)::INT] AS difficulty,
  count(DISTINCT e) FILTER (rank <= 5) / 2 AS recall5, count(DISTINCT e) FILTER (rank <= 10) / 2 AS recall10, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr, min(rank) IS NOT NULL AS hit
  FROM benchmark LEFT JOIN {name}_m ON qid = item_id GROUP BY item_id)"""


@query(f"WITH {BM25_SQL}, {_metrics_sql('m', 't')} SELECT qid, category, difficulty, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10, round(mrr, 6) AS mrr, hit FROM m")
def relevance_metrics(spark, sf_dir):
    """Recall at 5 and 10, MRR and hit of every query."""
    return rounded(_scored(spark, sf_dir, _text_list(spark, sf_dir)).drop("expected"), "recall5", "recall10", "mrr")


@query(f"""WITH {BM25_SQL}, {_metrics_sql('m', 't')}
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS level,
  coalesce(category, difficulty, 'all') AS name, count(*) AS queries, round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, round(avg(mrr), 6) AS mrr,
  count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate
FROM m GROUP BY GROUPING SETS ((), (category), (difficulty))""")
def relevance_summary(spark, sf_dir):
    """Means overall, by category and by difficulty."""
    return rounded(evaluate.summary(_scored(spark, sf_dir, _text_list(spark, sf_dir))), "recall5", "recall10", "mrr", "hit_rate")


@query(f"""{LISTS}, {_fused_sql(WEIGHTED)}, {_metrics_sql('a', 't')}, {_metrics_sql('z', 'fused')}
SELECT qid, round(a.mrr, 6) AS before, round(z.mrr, 6) AS after, round(z.mrr - a.mrr, 6) AS delta FROM a JOIN z USING (qid) WHERE a.mrr <> z.mrr""")
def relevance_changes(spark, sf_dir):
    """Queries whose MRR differs between text search and the weighted merge."""
    text = _text_list(spark, sf_dir).persist()  # 20 rows per query, used twice; a lost part is computed again
    before = _scored(spark, sf_dir, text)
    after = _scored(spark, sf_dir, fusion.weighted_merge(_vector_list(spark, sf_dir), text))
    return rounded(evaluate.changes(before, after), "before", "after", "delta")


@query("""
WITH m AS (SELECT 'c' || (item_id % 4) AS category, ['easy', 'medium', 'hard'][(item_id % 3 + 1)::INT] AS difficulty FROM benchmark)
SELECT category, difficulty, count(*) AS queries FROM m GROUP BY CUBE (category, difficulty)""")
def query_listing(spark, sf_dir):
    return evaluate.listing(_judged(spark, sf_dir))
