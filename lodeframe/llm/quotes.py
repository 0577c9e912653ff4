"""Quotation linking: quoted passages are traced to the messages that they quote.

A line's quote level is its number of leading `>` marks.  Consecutive lines of one
level above zero are a passage.  A passage, its paragraphs and its lines are
normalised (marks off, white space collapsed, lower case) and hashed, and so are
each message's own text, paragraphs and lines.  Within a conversation a quoted hash
links to the nearest earlier message that has it as its own text; a passage belongs
to the message matched at the coarsest grain, then by most characters, then latest.
A message replies to the source of its shallowest linked passage.  Threads and
depths follow by pointer doubling, and the conversation is ordered by thread, then
depth, then turn, without quotes and attribution lines.

Everything is DataFrame expressions: passages are cut inside a row, hashes meet by
range partitions (a conversation or line of a third of all rows is spread), nothing
is collected per conversation.

Defined results: null and empty texts have an empty body and no quotes.  Messages
without a linked quote start threads of their own.  Rows with a null conv_id or turn
link with nothing and have null position.  Rows that share conv_id and turn are one
node: they share reply_to (the latest), thread, depth and position.  Quoted
lines shorter than MIN_LINE normalised characters link only as a whole passage or
paragraph, which may be a single line of an earlier message.  Very long texts are cut
whole, within their row.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.ranges import positions, running_last
from lodeframe.llm.session import ready
from lodeframe.sources.spread import spread

MIN_LINE = 12
MARKS = r"^[ \t]*((?:>[ \t]?)*)"
ATTRIBUTION = r"(?i)^[ \t]*(on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$"
PASSAGE, PARAGRAPH, LINE = 3, 2, 1


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lines(text: Column) -> Column:
    """array<struct<level, content>>"""

    def line(x):
        return F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("content"))

    return F.transform(F.split(text, r"\r?\n"), line)


def _runs(text: Column) -> Column:
    """array<struct<level, lines: array<string>>>: maximal runs of lines of one level, attributions left out."""

    def cut(lines):
        at = F.sequence(F.lit(0), F.size(lines) - 1)

        def introduces(x, i):
            after = F.get(lines, i + 1)
            return F.coalesce((after["level"] > x["level"]) & F.regexp(x["content"], F.lit(ATTRIBUTION)), F.lit(False))

        starts = F.filter(at, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

        def runs(s):
            def run(i, k):
                stop = F.coalesce(F.get(s, k + 1), F.size(lines))
                part = F.slice(lines, i + 1, stop - i)
                kept = F.filter(part, lambda x, j: ~introduces(x, i + j))
                return F.struct(F.get(lines, i)["level"].alias("level"), F.transform(kept, lambda x: x["content"]).alias("lines"))

            return F.transform(s, run)

        return _bind(starts, runs)

    return _bind(_lines(text), cut)


def _normal(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " ")))


def _units(lines: Column, least: int = MIN_LINE) -> Column:
    """array<struct<grain, hash, chars>> of a run: itself, its paragraphs, its lines of at least so many characters."""

    def unit(grain):
        return lambda x: F.struct(F.lit(grain).alias("grain"), F.xxhash64(x).alias("hash"), F.length(x).alias("chars"))

    def of(joined):
        whole = F.array(_normal(joined))
        paragraphs = F.transform(F.split(joined, r"\n[ \t]*\n"), _normal)
        single = F.filter(F.transform(lines, _normal), lambda x: F.length(x) >= least)
        parts = F.concat(F.transform(whole, unit(PASSAGE)), F.transform(paragraphs, unit(PARAGRAPH)), F.transform(single, unit(LINE)))
        return F.filter(parts, lambda u: u["chars"] > 0)

    return _bind(F.array_join(lines, "\n"), of)


def _body(runs: Column) -> Column:
    own = F.filter(runs, lambda r: r["level"] == 0)
    return F.regexp_replace(F.array_join(F.transform(own, lambda r: F.array_join(r["lines"], "\n")), "\n"), r"^\s+|\s+$", "")


def _links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, run, level, origin: the source of each linked passage."""
    # explode_outer keeps the optimizer from cutting each text again in a filter on the array's size
    known = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.xxhash64("text").alias("copy"), "text")
    cut = known.filter(F.regexp("text", F.lit(r"(?m)^[ \t]*>"))).select("conv_id", "turn", "copy", F.posexplode_outer(_runs(F.col("text"))).alias("run", "r")).filter("r.level > 0")
    quoted = cut.select("conv_id", "turn", "copy", "run", "r.level", F.explode_outer(_units(F.col("r.lines"))).alias("u")).filter("u IS NOT NULL")
    quoted = quoted.select("conv_id", "turn", "copy", "run", "level", "u.*").checkpoint()

    # own text: each run at level 0, and all of them together
    def own_units(runs):
        own = F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["lines"])
        return _bind(own, lambda x: F.flatten(F.transform(F.array_distinct(F.array_append(x, F.flatten(x))), lambda r: _units(r, 1))))

    own = known.select("conv_id", "turn", F.explode_outer(_bind(_runs(F.col("text")), own_units)).alias("u")).filter("u IS NOT NULL").select("conv_id", "turn", "u.hash")
    own = own.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    events = quoted.select("conv_id", "hash", "turn", F.lit(0).alias("kind"), "copy", "run", "level", "grain", "chars", F.lit(None).cast("long").alias("origin")).unionByName(
        own.select("conv_id", "hash", "turn", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("origin")), allowMissingColumns=True
    )
    # at equal turns a quote sorts before the message's own text: only earlier messages are found
    found = running_last(events, ["conv_id", "hash"], ["turn", "kind", "copy", "run", "grain", "chars"], "origin", "source").filter("kind = 0 AND source IS NOT NULL")
    votes = found.groupBy("conv_id", "turn", "copy", "run", "level", "source").agg(F.max("grain").alias("grain"), F.max(F.struct("grain", "chars")).alias("top"), F.sum("chars").alias("chars"))
    return votes.groupBy("conv_id", "turn", "copy", "run", "level").agg(F.max(F.struct("grain", "chars", "source"))["source"].alias("origin"))


def _threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth for the nodes of replies (conv_id, turn, reply_to): pointer doubling."""
    now = replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")).checkpoint()
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        step = now.join(up, ["conv_id", "root"], "left").checkpoint()
        now = step.select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if step.filter("higher IS NOT NULL").isEmpty():
            return now


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message (conv_id, turn, role, text): its text without quotes and its place in reply order.

    conv_id, turn, role, body, n_quotes, n_linked, reply_to, thread, depth, position, chat (JSON of role and content).
    """
    ready(messages.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = spread(messages.select("conv_id", "turn", "role", text.alias("text")))
    links = _links(rows).checkpoint()
    nearest = F.min(F.struct("level", (-F.col("origin")).alias("back")))["back"]
    replies = links.groupBy("conv_id", "turn").agg((-nearest).alias("reply_to"), F.count("*").alias("n_linked"))
    threads = _threads(replies)
    nodes = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    nodes = nodes.join(replies, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    nodes = nodes.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
    placed = positions(nodes, "conv_id", [F.col("thread"), F.col("depth"), F.col("turn")], "position")
    runs = rows.select("conv_id", "turn", "role", _bind(_runs(F.col("text")), lambda r: F.struct(_body(r).alias("body"), F.size(F.filter(r, lambda x: x["level"] > 0)).alias("n_quotes"))).alias("cut"))
    return runs.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "cut.body", F.col("cut.n_quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "reply_to", "thread", "depth", "position", F.to_json(F.struct(F.col("role"), F.col("cut.body").alias("content"))).alias("chat"),
    )
