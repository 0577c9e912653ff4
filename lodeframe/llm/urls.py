"""URL filters: a sort-merge range join of reversed-host canonical keys.

A rule (host, path) holds for its host, all subdomains, and paths that start with
its path.  Under the canonical key `reversed host labels + path` every rule is one
interval [key, key + 0xFF), and two such intervals are nested or disjoint.  A url
is keyed once for each of its host suffixes.  Rule starts, rule ends and url keys
are range-partitioned and sorted together; the stack of active nested rules is
known after each event (a start pushes the rule, an end uncovers the rule around
it), so a running last() over the sorted keys gives the innermost rule of each key.
The state at a partition's border is carried from one row per partition.

Defined results: a null url, or one without `://`, has empty host and path and
meets no rule.  Rules with null host or path are ignored; equal rules count once
and block wins over allow.  The longest rule string wins, then the longer host.
Repeated rows stay; very long urls are keys like others; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.ranges import running_last
from lodeframe.llm.session import ready

DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Labels in reverse order, each closed by 0x00, then 0x01 and the path."""
    return F.encode(F.concat(F.array_join(F.reverse(labels), "\x00"), F.lit("\x00\x01"), path), "UTF-8")


def _rule_events(rules: DataFrame) -> DataFrame:
    """(key, kind, state): starts (kind 0) and ends (kind 2), state the rule active after them.

    The rule around another one has a key that is a prefix of it, on the same host.
    """
    clean = (
        rules.filter("host IS NOT NULL AND path IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max(F.col("verdict") == "block").alias("block"))
        .select("host", "path", F.when(F.col("block"), "block").otherwise("allow").alias("verdict"))
    )
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict"
    )
    held = clean.select("host", "path", _key(F.split("host", r"\."), F.col("path")).alias("key"), rule.alias("rule"))
    prefixes = held.select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", 1, n))).alias("prefix"))
    outer = held.select("host", F.col("path").alias("prefix"), F.col("rule").alias("around"))
    around = prefixes.filter("prefix <> path").join(outer, ["host", "prefix"]).groupBy("host", "path").agg(F.max("around").alias("around"))
    held = held.join(around, ["host", "path"], "left")
    starts = held.select("key", F.lit(0).alias("kind"), F.struct(F.col("rule").alias("active")).alias("state"))
    ends = held.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.struct(F.col("around").alias("active")).alias("state"))
    return starts.unionByName(ends)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url)."""
    ready(pages.sparkSession)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("row_no", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.slice(labels, i, F.size(labels)))
    keyed = rows.select("page_id", "host", "path", "row_no", F.explode(suffixes).alias("suffix")).select(
        _key(F.col("suffix"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "row_no", "page_id", "host", "path"
    )
    events = keyed.unionByName(_rule_events(rules), allowMissingColumns=True)
    found = running_last(events, [], ["key", "kind", "row_no"], "state", "here").filter("kind = 1").select("row_no", "page_id", "host", "path", F.col("here.active").alias("active"))
    best = found.groupBy("row_no").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("active").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
