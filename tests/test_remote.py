"""HTTP embedder and reranker against recorded transports and a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lodeframe.operators.embed import embed_documents, embed_query, with_retry
from lodeframe.operators.ranking import rerank
from lodeframe.operators.remote import HttpEmbedder, HttpReranker, post_json


# services are made inside functions, so that they reach the executors by value


def embedding_service():
    """Answers the length of each text in the first component."""

    def answer(url, headers, body):
        vector = lambda r: {"values": [float(len(r["content"]["parts"][0]["text"]))] + [0.0] * (r["outputDimensionality"] - 1)}
        return {"embeddings": [vector(r) for r in body["requests"]]} if url.endswith(":batchEmbedContents") else {"embedding": vector(body)}

    return answer


def broken_service():
    def answer(url, headers, body):
        raise RuntimeError("rerank (503): down")

    return answer


def reversing_service():
    def answer(url, headers, body):
        n = len(body["documents"])
        return {"results": [{"index": i, "relevance_score": i / 10} for i in range(n - 1, -1, -1)][: body["top_n"]]}

    return answer


def test_one_text_is_a_single_request_and_more_go_in_batches_of_100():
    calls = []

    def service(url, headers, body):
        calls.append((url, headers, body))
        return embedding_service()(url, headers, body)

    e = HttpEmbedder("http://host/v1", "m", "k", 768, service)
    assert embed_query("four", e)[:2] == [4.0, 0.0]
    url, headers, body = calls.pop()
    assert url == "http://host/v1/models/m:embedContent" and headers == {"x-goog-api-key": "k"}
    assert body == {"content": {"parts": [{"text": "four"}]}, "taskType": "RETRIEVAL_QUERY", "outputDimensionality": 768}
    assert [v[0] for v in e.embed(["x" * i for i in range(250)])] == list(range(250))
    assert [len(b["requests"]) for _, _, b in calls] == [100, 100, 50]
    assert calls[0][2]["requests"][0]["taskType"] == "RETRIEVAL_DOCUMENT" and calls[0][2]["requests"][0]["model"] == "models/m"
    assert e.embed([]) == []


def test_dimension_answers_and_key_are_checked():
    with pytest.raises(ValueError):
        HttpEmbedder("http://host", "m", "k", 100)
    with pytest.raises(ValueError):
        HttpEmbedder("http://host", "m", "k", 768, lambda *a: {"embedding": {"values": [1.0]}}).embed(["a"])
    with pytest.raises(ValueError):
        HttpEmbedder("http://host", "m", "k", 768, lambda *a: {"embeddings": []}).embed(["a", "b"])
    assert "hidden" not in repr(HttpEmbedder("http://host", "m", "hidden")) + repr(HttpReranker("http://host", "m", "hidden"))


def test_embedder_runs_on_executors(spark):
    e = HttpEmbedder("http://host", "m", "k", 768, embedding_service())
    rows = embed_documents(spark.createDataFrame([("ab",), (None,), ("abc",)], "text string").coalesce(1), e).collect()
    assert {r["text"]: r["vector"][0] for r in rows} == {"ab": 2.0, None: 0.0, "abc": 3.0}


def test_reranker_reorders_and_keeps_the_first_where_the_service_fails(spark):
    hits = spark.createDataFrame([(1, "a", "x", 0.5, 1), (1, "b", "y", 0.4, 2), (1, "c", "z", 0.3, 3)], "qid long, id string, text string, score double, rank int")
    queries = spark.createDataFrame([(1, "q")], "qid long, text string")
    told = rerank(hits, queries, HttpReranker("http://host", "m", "k", 2, reversing_service()), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["rank"]) for r in told] == [("c", 0.2, 1), ("b", 0.1, 2)]
    kept = rerank(hits, queries, HttpReranker("http://host", "m", "k", 2, broken_service()), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in kept] == [("a", 0.5), ("b", 0.4)]
    assert HttpReranker("http://host", "m", "k", 2, broken_service())("q", []) == []


def test_post_json_over_a_socket_is_retried_on_429():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["X-Key"], body))
            status = 429 if len(seen) == 1 else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"echo": body}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/x"
        assert with_retry(lambda: post_json(url, {"X-Key": "k"}, {"a": 1}), sleep=lambda s: None) == {"echo": {"a": 1}}
    finally:
        server.shutdown()
    assert seen == [("/x", "k", {"a": 1})] * 2
