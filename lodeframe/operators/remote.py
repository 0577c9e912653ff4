"""Embedder and reranker behind HTTP services that speak JSON.

The transport is a plain function, so tests need no network and a deployment can bring
its own client.  Objects are pickled to the executors together with their key; the key
is kept out of their repr.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from lodeframe.operators.embed import BATCH
from lodeframe.schema import VALID_DIMS

#: (url, headers, body) -> answer; raises with the status code in its message.
Transport = Callable[[str, Mapping[str, str], dict], dict]

#: Fixed values of the wire format: names of the tasks.
TASKS = {"query": "RETRIEVAL_QUERY", "document": "RETRIEVAL_DOCUMENT"}


def post_json(url: str, headers: Mapping[str, str], body: dict, timeout: float = 60.0) -> dict:
    """The JSON answer to a POST; a status that is no success raises RuntimeError with its number."""
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{url} ({e.code}): {e.read().decode(errors='replace')[:300]}") from e


@dataclass(frozen=True)
class HttpEmbedder:
    """An embedder over `{base}/models/{model}:embedContent` and `:batchEmbedContents`.

    One text takes a single request, more take requests of up to 100.  dim is asked for as
    output dimension and must be one of VALID_DIMS.  An answer with another number of
    vectors, or vectors of another length, is an error.  Retries are with_retry()'s.
    """

    base: str
    model: str
    key: str = field(repr=False)
    dim: int = 768
    transport: Transport = post_json

    def __post_init__(self):
        if self.dim not in VALID_DIMS:
            raise ValueError(f"dim must be one of {VALID_DIMS}, not {self.dim}")

    def _request(self, text: str, task: str) -> dict:
        return {"content": {"parts": [{"text": text}]}, "taskType": TASKS[task], "outputDimensionality": self.dim}

    def _call(self, method: str, body: dict) -> dict:
        return self.transport(f"{self.base}/models/{self.model}:{method}", {"x-goog-api-key": self.key}, body)

    def embed(self, texts: Sequence[str], task: str = "document") -> list[list[float]]:
        if len(texts) == 1:
            found = [self._call("embedContent", self._request(texts[0], task))["embedding"]["values"]]
        else:
            found = []
            for lo in range(0, len(texts), BATCH):
                requests = [{"model": f"models/{self.model}", **self._request(t, task)} for t in texts[lo : lo + BATCH]]
                found += [e["values"] for e in self._call("batchEmbedContents", {"requests": requests})["embeddings"]]
        if len(found) != len(texts) or any(len(v) != self.dim for v in found):
            raise ValueError(f"{self.model} did not answer {len(texts)} vectors of {self.dim}")
        return found


@dataclass(frozen=True)
class HttpReranker:
    """A scorer for rerank() over a cross-encoder service; None where the service fails."""

    url: str
    model: str
    key: str = field(repr=False)
    top: int = 10
    transport: Transport = post_json

    def __call__(self, query: str, texts: Sequence[str]) -> list[tuple[int, float]] | None:
        if not texts:
            return []
        try:
            answer = self.transport(self.url, {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "query": query, "documents": list(texts), "top_n": self.top})
        except (RuntimeError, OSError):
            return None
        return [(int(r["index"]), float(r["relevance_score"])) for r in answer["results"]]
