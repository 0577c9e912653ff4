"""Embedding of chunks through a pluggable embedder, in batches on the executors."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

BATCH, CONCURRENCY = 100, 2
#: Chunks of a call when those of a failed batch are tried again.
RETRY_BATCH = 10
#: Fixed values of the retry rule: attempts, first wait, longest wait (seconds), jitter.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, JITTER = 5, 2.0, 30.0, 0.2
#: Fixed value: messages of errors that are worth another attempt.
RETRYABLE = r"(?i)(rate[_ ]limit|too many requests|429|resource has been exhausted|spending cap|5\d\d|cloudflare)"


class Embedder(Protocol):
    """dim values per text; task is `query` or `document`."""

    dim: int

    def embed(self, texts: Sequence[str], task: str) -> Sequence[Sequence[float]]: ...


class HashingEmbedder:
    """Deterministic and offline: signed hashed words, L2-normalised."""

    def __init__(self, dim: int = 768):
        self.dim = dim

    def embed(self, texts: Sequence[str], task: str = "document") -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
            norm = np.sqrt((row**2).sum())
            if norm:
                row /= norm
        return out.astype(np.float32).tolist()


def with_retry(call: Callable[[], object], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random):
    """call(), tried again on rate limits and server errors with doubled, jittered waits."""
    wait = FIRST_WAIT
    for attempt in range(attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts or not re.search(RETRYABLE, str(e)):
                raise
            sleep(min(LONGEST_WAIT, wait * (1 + JITTER * jitter())))
            wait *= 2


def embed_documents(chunks: DataFrame, embedder: Embedder, batch: int = BATCH, concurrency: int | None = None, keep_errors: bool = False) -> DataFrame:
    """chunks (text, ...) with `vector`; `concurrency` caps the calls that run at a time.

    A vector stays in the row of its text, so no order is relied on.  With keep_errors a
    batch that fails for good gives null vectors and its message in `error`, and the job
    goes on; otherwise the job fails.
    """
    if concurrency:
        chunks = chunks.repartition(concurrency)  # a coalesce would chunk in as few tasks
    at = chunks.columns.index("text")
    more = [StructField("error", StringType())] if keep_errors else []
    schema = StructType([*chunks.schema.fields, StructField("vector", ArrayType(FloatType())), *more])

    def run(batches: Iterator[pa.RecordBatch]):
        for rows in batches:
            for lo in range(0, len(rows), batch):
                part = rows.slice(lo, batch)
                texts = [t or "" for t in part.column(at).to_pylist()]
                error = None
                try:
                    vectors = [list(map(float, v)) for v in with_retry(lambda: embedder.embed(texts, "document"))]
                except Exception as e:
                    if not keep_errors:
                        raise
                    vectors, error = [None] * len(texts), str(e)[:500]
                columns = [*part.columns, pa.array(vectors, type=pa.list_(pa.float32()))]
                if keep_errors:
                    columns.append(pa.array([error] * len(texts), type=pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chunks.mapInArrow(run, schema)


def embed_query(text: str, embedder: Embedder) -> list[float]:
    """The vector of one query text."""
    return list(map(float, with_retry(lambda: embedder.embed([text], "query"))[0]))


def embed_queries(queries: DataFrame, embedder: Embedder, column: str = "text") -> DataFrame:
    """queries (qid, text) with `vector`; queries are few and are embedded on the driver."""
    rows = queries.collect()
    vectors = with_retry(lambda: embedder.embed([r[column] or "" for r in rows], "query")) if rows else []
    kind = StructType([*queries.schema.fields, StructField("vector", ArrayType(FloatType()))])
    return queries.sparkSession.createDataFrame([(*r, [float(x) for x in v]) for r, v in zip(rows, vectors)], kind)
