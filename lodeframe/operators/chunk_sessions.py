"""Session chunks from JSONL logs: one row per message that is worth searching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.score import epoch_ms_to_iso
from lodeframe.functions.text import content_text, project_of, source_of, trim_all, truncate, utf16_length

USER_MIN, ASSISTANT_MIN, TEXT_MAX = 20, 100, 2000


def lines_of(files: DataFrame) -> DataFrame:
    """sessionFile, lineNumber (from 1, blank and bad lines counted), line of files (path, content)."""
    rows = files.select(F.col("path").alias("sessionFile"), F.posexplode(F.split("content", r"\r?\n")).alias("_at", "line"))
    return said_lines(rows.select("sessionFile", (F.col("_at") + 1).alias("lineNumber"), "line"))


def said_lines(numbered: DataFrame) -> DataFrame:
    """Lines (sessionFile, lineNumber, line) that are not blank."""
    return numbered.filter(trim_all(F.col("line")) != "")


def keeps_message(role: Column, text: Column) -> Column:
    """User texts over 20 and assistant texts over 100 UTF-16 units; other roles never."""
    n = utf16_length(text)
    return F.coalesce(((role == "user") & (n > USER_MIN)) | ((role == "assistant") & (n > ASSISTANT_MIN)), F.lit(False))


def message_chunks(messages: DataFrame, limit: int = TEXT_MAX) -> DataFrame:
    """Rows of messages (role, text, ...) that are kept, text cut to `limit` and `...`."""
    return messages.filter(keeps_message(F.col("role"), F.col("text"))).withColumn("text", truncate(F.col("text"), limit))


def session_chunks(lines: DataFrame) -> DataFrame:
    """Chunks of lines (sessionFile, lineNumber, line) of either layout, by path.

    Lines that are no JSON object, and timestamps that are no number where one is
    asked for, skip the row or stay empty; they never fail a file.
    """
    doc = lines.withColumn("doc", F.try_parse_json("line")).filter("doc IS NOT NULL")
    text = lambda path: F.try_variant_get("doc", path, "string")
    doc = doc.withColumns(
        {
            "source": source_of(F.col("sessionFile")),
            "kind": text("$.type"),
            "summary": F.try_variant_get("doc", "$.compaction.summary", "string"),
            "content": F.try_variant_get("doc", "$.message.content", "variant"),
            "said_by": text("$.message.role"),
            "iso": text("$.timestamp"),
            "ms": F.try_variant_get("doc", "$.timestamp", "double"),
        }
    )
    pi = F.col("source") == "pi"
    compaction = pi & (F.col("kind") == "compaction") & (F.coalesce("summary", F.lit("")) != "")
    message = F.when(pi, F.col("kind") == "message").otherwise(F.col("kind").isin("user", "assistant")) & F.col("content").isNotNull()
    role = F.when(compaction, "compaction").when(pi, F.col("said_by")).otherwise(F.col("kind"))
    body = F.when(compaction, F.col("summary")).when(message, content_text(F.col("content")))
    rows = doc.select("sessionFile", "lineNumber", "source", role.alias("role"), body.alias("text"), F.when(pi, epoch_ms_to_iso(F.col("ms"))).otherwise(F.coalesce("iso", F.lit(""))).alias("timestamp"))
    rows = rows.filter(F.col("text").isNotNull() & ((F.col("role") == "compaction") | keeps_message(F.col("role"), F.col("text"))))
    shown = F.when(F.col("role") == "compaction", F.col("text")).otherwise(truncate(F.col("text"), TEXT_MAX))
    kind = F.when(F.col("role") == "compaction", "compaction").when(F.col("role") == "user", "user_message").otherwise("assistant_response")
    return rows.select(
        F.concat_ws(":", "sessionFile", F.col("lineNumber").cast("string")).alias("id"),
        shown.alias("text"),
        "sessionFile",
        project_of(F.col("sessionFile")).alias("project"),
        F.col("lineNumber").cast("int").alias("lineNumber"),
        "timestamp",
        "role",
        "source",
        F.create_map(F.lit("type"), kind).alias("metadata"),
    )


def extract_sessions(files: DataFrame) -> DataFrame:
    return session_chunks(lines_of(files))
