"""Toxicity: a character n-gram linear classifier on naive-Bayes-scaled features.

Features are hashed character n-grams (3 to 6 code points of the lower-cased whole
text), present or absent.  Over the training rows, each feature's document counts
by class give the naive Bayes log-count ratio r; the features seen at least three
times whose presence depends on the class (chi-square of at least `least_chi`) enter a
logistic regression on r * presence, fitted by L-BFGS.  Its l2 penalty is the one of
`penalties` with the least log loss in cross-validation inside the training rows.

Bound, a parameter of fit(): at most `max_rows` labelled rows are learnt from (a
deterministic sample by hash of doc_id when there are more), so what reaches the driver
does not grow with the corpus; features are at most 2^HASH_BITS, whatever the texts.

Defined results: very long texts count and score whole.  Null and empty texts get the score of no features.  Labels that
are null or have a null doc_id are ignored; of repeated labels for a document the
highest counts.  Without both classes among the training rows the score is the
smoothed base rate.  Repeated rows stay; extra columns are ignored (score) or kept
(drop_toxic); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.session import ready, stored
from lodeframe.sources.spread import spread

ORDERS = (3, 4, 5, 6)
HASH_BITS = 20
MAX_ROWS = 12_000
LEAST_CHI = 20.0
PENALTIES = (1e-2, 1e-3, 1e-4)
#: Parts in which the features of the training rows reach the driver: small ones need no buffers beside the heap.
RESULT_PARTS = 64
#: Parts of the cross-validation, and rows that it uses at most.
FOLDS, FOLD_ROWS = 3, 4_000
THRESHOLD = 0.3
HELD_OUT_REMAINDER = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def buckets(text: str | None) -> list[np.ndarray]:
    """Hash buckets of a text's n-grams, one array per order, repeats included."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, state = [], points * np.uint32(2654435761)
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            break
        state = state[:-1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            mixed = (state ^ (state >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            out.append(mixed >> np.uint32(32 - HASH_BITS))
    return out


def _count_batches(batches):
    counts = np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
    seen = np.zeros(1 << HASH_BITS, dtype=bool)
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen[:] = False
            for found in buckets(text.as_py()):
                seen[found] = True
            counts[1 if toxic else 0] += seen
    used = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])], names=["bucket", "toxic", "clean"])


class _Features:
    """Maps a text to the indices of the kept features that it has."""

    def __init__(self, kept: np.ndarray):
        self.kept, self.table = kept, None

    def __call__(self, text: str | None) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << HASH_BITS, dtype=np.int32)
            self.table[self.kept] = np.arange(1, len(self.kept) + 1)
            self.seen = np.zeros(len(self.kept) + 1, dtype=bool)
        self.seen[:] = False
        for found in buckets(text):
            self.seen[self.table[found]] = True
        return np.flatnonzero(self.seen[1:])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _fit_logistic(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, l2: float, steps: int = 80, memory: int = 8) -> tuple[np.ndarray, float]:
    """L-BFGS on mean log loss + l2/2 |w|^2; features are ratios of present indices."""
    sizes = np.array([len(r) for r in rows])
    index = np.concatenate(rows).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    k, n = len(ratios), len(rows)
    parts = [slice(at, at + (1 << 19)) for at in range(0, len(index), 1 << 19)]

    def loss(theta):
        scaled, z, down = theta[:k] * ratios, np.full(n, theta[k]), np.zeros(k)
        for at in parts:
            z += np.bincount(owner[at], weights=scaled[index[at]], minlength=n)
        slack = _logistic(z) - y
        for at in parts:
            down += np.bincount(index[at], weights=slack[owner[at]], minlength=k)
        grad = np.append(ratios * down / n + l2 * theta[:k], slack.mean())
        return np.logaddexp(0, z).mean() - (y * z).mean() + l2 / 2 * (theta[:k] ** 2).sum(), grad

    theta = np.zeros(k + 1)
    base = min(max(y.mean(), 1e-6), 1 - 1e-6)
    theta[k] = np.log(base / (1 - base))
    value, grad = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, t in reversed(past):
            alphas.append((s @ q) / (t @ s))
            q -= alphas[-1] * t
        if past:
            s, t = past[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), a in zip(past, reversed(alphas)):
            q += s * (a - (t @ q) / (t @ s))
        step = 1.0 if past else 1.0 / max(1.0, np.abs(grad).sum())
        for _ in range(20):
            after, slope = loss(theta - step * q)
            if after <= value - 1e-4 * step * (grad @ q):
                break
            step /= 2
        else:
            break
        s, t = -step * q, slope - grad
        if s @ t > 1e-12:
            past = [*past[1 - memory :], (s, t)]
        done = value - after < 1e-9
        theta, value, grad = theta + s, after, slope
        if done:
            break
    return theta[:k], float(theta[k])


def _penalty(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalties: tuple[float, ...]) -> float:
    """The penalty of least log loss over FOLDS parts of the rows (at most FOLD_ROWS, which come in a fixed order)."""
    part = np.arange(len(rows[:FOLD_ROWS])) % FOLDS
    if len(penalties) == 1 or min(len(set(y[: len(part)][part != k])) for k in range(FOLDS)) < 2:
        return penalties[0]
    losses = []
    for l2 in penalties:
        loss = 0.0
        for k in range(FOLDS):
            told, asked = np.flatnonzero(part != k), np.flatnonzero(part == k)
            weights, bias = _fit_logistic([rows[i] for i in told], y[told], ratios, l2, steps=40)
            z = np.array([(weights * ratios)[rows[i]].sum() for i in asked]) + bias
            loss += (np.logaddexp(0, z) - y[asked] * z).sum()
        losses.append(loss)
    return penalties[int(np.argmin(losses))]


@dataclass
class ToxicityModel:
    kept: np.ndarray
    weights: np.ndarray
    bias: float

    def score_text(self, text: str | None) -> float:
        features = _Features(self.kept)
        return float(_logistic(np.array(self.bias + self.weights[features(text)].sum())))

    def scorer(self):
        """Function over Arrow batches (any columns, text last) that appends the score in its place."""
        kept, weights, bias = self.kept, self.weights, self.bias

        def run(batches):
            features = _Features(kept)
            for batch in batches:
                z = np.array([weights[features(x.as_py())].sum() for x in batch.column(batch.num_columns - 1)], dtype=np.float64)
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(_logistic(z + bias))], names=[*batch.schema.names[:-1], "score"])

        return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, least_chi: float = LEAST_CHI, alpha: float = 1.0, penalties: tuple[float, ...] = PENALTIES) -> ToxicityModel:
    """Learn from labels (doc_id, toxic) outside the held-out fold, joined to docs (doc_id, text)."""
    spark = ready(docs.sparkSession)
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("label_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("label_id")))
        .groupBy("label_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_rows)
    )
    marked = spark.createDataFrame(marked.collect(), "label_id long, toxic boolean")  # at most max_rows
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), F.col("doc_id") == F.col("label_id"))
    train = stored(train.select("doc_id", "toxic", "text"))  # docs is read once
    counts = train.select("toxic", "text").mapInArrow(_count_batches, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).checkpoint()
    sums = counts.agg(F.max("toxic"), F.max("clean"), F.sum("toxic"), F.sum("clean"), F.count("*")).first()
    sizes = {r["toxic"]: r["n"] for r in train.select("toxic").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, q = sizes.get(True, 0), sizes.get(False, 0)
    if not p or not q or not sums[4]:
        rate = (p + 1) / (p + q + 2)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    mean = (F.col("toxic") + F.col("clean")) / F.lit(float(p + q))
    gap = F.col("toxic") / F.lit(float(p)) - F.col("clean") / F.lit(float(q))
    chi = gap * gap / F.greatest(mean * (1 - mean), F.lit(1.0 / (p + q))) * F.lit(p * q / (p + q))
    top = sorted(counts.filter("toxic + clean >= 3").filter(chi >= least_chi).collect(), key=lambda r: r["bucket"])
    kept = np.array([r["bucket"] for r in top], dtype=np.int64)
    toxic, clean = (np.array([r[c] for r in top], dtype=float) for c in ("toxic", "clean"))
    ratios = np.log((toxic + alpha) / (sums[2] + alpha * sums[4])) - np.log((clean + alpha) / (sums[3] + alpha * sums[4]))

    def present(batches):
        features = _Features(kept)
        for batch in batches:
            found = [features(x.as_py()).astype("<i4").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.binary())], names=["doc_id", "toxic", "found"])

    rows = train.select("doc_id", "toxic", "text").mapInArrow(present, "doc_id long, toxic boolean, found binary").repartition(RESULT_PARTS, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("found").alias("found")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y = np.array([r["toxic"] for r in rows], dtype=float)
    found = [np.frombuffer(r["found"], dtype="<i4") for r in rows]
    del rows, top
    weights, bias = _fit_logistic(found, y, ratios, _penalty(found, y, ratios, penalties))
    return ToxicityModel(kept, weights * ratios, bias)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    ready(docs.sparkSession)
    scored = spread(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(model.scorer(), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, columns unchanged."""
    ready(docs.sparkSession)
    at = docs.columns.index("text")
    kept, weights, bias = model.kept, model.weights, model.bias

    def clean(batches):
        features = _Features(kept)
        for batch in batches:
            z = np.array([weights[features(x.as_py())].sum() for x in batch.column(at)], dtype=np.float64)
            yield batch.filter(pa.array(_logistic(z + bias) < threshold))

    return spread(docs).mapInArrow(clean, docs.schema)
