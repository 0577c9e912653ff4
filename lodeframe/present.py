"""Results as Markdown for reading and as JSON for programs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodeframe.functions.text import truncate

MARKDOWN_TEXT, JSON_TEXT = 500, 800


def shown(hits: DataFrame, limit: int = JSON_TEXT) -> DataFrame:
    """Hits with the text cut for display, in rank order."""
    return hits.withColumn("text", truncate(F.col("text"), limit)).orderBy("qid", "rank")


def markdown(query: str, rows: Sequence[Row], expanded: Sequence[str] = (), fallback: bool = False) -> str:
    asked = f"{query} (+expand: {', '.join(expanded)})" if expanded else query
    if not rows:
        return f'No results for: "{asked}"'
    parts = []
    for i, r in enumerate(rows, 1):
        tag = f" [{r['source']}]" if r["source"] else ""
        parts.append(f"## {i}. [{r['project']}]{tag} {r['role']} (score: {r['score']:.3f})\n- File: {r['sessionFile']}:L{r['lineNumber']}\n- Time: {r['timestamp']}\n- Text:\n{r['text']}")
    note = "\n\n(few session results; notes are included)" if fallback else ""
    return f'Found {len(rows)} results for: "{asked}"\n\n' + "\n\n---\n\n".join(parts) + note


def hit(row: Row) -> dict:
    """One result; an empty source is left out."""
    out = {"project": row["project"], "role": row["role"], "source": row["source"] or None, "score": round(row["score"], 4), "file": row["sessionFile"], "line": row["lineNumber"], "timestamp": row["timestamp"], "text": row["text"]}
    return {k: v for k, v in out.items() if k != "source" or v is not None}


def response(query: str, rows: Sequence[Row], expanded: Sequence[str] = (), fallback: bool | None = None) -> str:
    """The JSON answer of a search; `fallback` only for session search, `expanded` only if there are any."""
    out: dict = {"query": query}
    if expanded:
        out["expanded"] = list(expanded)
    if fallback is not None:
        out["fallback"] = fallback
    return json.dumps(out | {"count": len(rows), "results": [hit(r) for r in rows]}, ensure_ascii=False)
