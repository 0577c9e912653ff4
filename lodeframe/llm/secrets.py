"""Secret scan: fixed patterns plus sliding-window Shannon entropy, in SQL functions only.

Base kinds are found by pattern.  The entropy kind looks at candidate strings (long
runs of token characters).  The first character class that a candidate fits - digits,
hex of lower, upper or mixed case, letters, the base64 alphabet - has its own window
threshold in bits.  A window slides over the candidate with a count per symbol that is
raised for the entering and lowered for the leaving character, so that the running sum
of c*log2(c) gives the entropy without a recount; merged windows at or above the
threshold become one span.  Candidates that an allow pattern fits (words, paths, dates,
uuids, repeated symbols) are suppressed before, and spans that hold a known filler after.

Folds over matches and characters run in pieces of PIECE, so that their cost is linear
in the text for all that a row may hold.

Defined results: null texts are empty: no spans, hash of the empty string.  Spans
are code points, end exclusive.  Very long texts and candidates are scanned whole.
Repeated rows stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.sources.spread import spread

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Items of a fold whose results are copied when another is found.
PIECE = 256
#: Runs that are scanned for entropy.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Character class -> alphabet and least bits of a window of 20; the first that holds all of a candidate is its class.
CLASSES = {
    "decimal": (_DIGITS, 3.2),
    "hex": (_DIGITS + "abcdef", 3.2),
    "upper hex": (_DIGITS + "ABCDEF", 3.2),
    "mixed hex": (_DIGITS + "abcdefABCDEF", 3.5),
    "letters": (_LOWER + _LOWER.upper(), 4.0),
    "base64": (_DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 3.9),
}
#: Candidates never reported: no digit or no letter beside other signs, a uuid, slash paths of words, one symbol repeated.
ALLOW = (
    r"^[^0-9]*[^0-9A-Za-z][^0-9]*$",
    r"^[^A-Za-z]*[^0-9A-Za-z][^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^/?([A-Za-z_-]+/)+[A-Za-z0-9_-]{0,19}$",
    r"^(.)\1*$",
)
#: Spans never reported hold one of these.
FILLER = r"(?i)example|sample|placeholder|0123456789|abcdefghij|xxxxxx"


def _fold(items: Column, zero: list[Column], found: str, step: Callable[[Column, Column], Column], empty: Column) -> Column:
    """What step(state, item) appends to the state's `found`, an array of the type named, over all items.

    Pieces keep the arrays that are copied short; empty is the result without items.
    """
    none = F.array().cast(found).alias("found")

    def run(items):  # a variable of a lambda, so that the items are made once
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int")), lambda i: F.slice(items, i * PIECE + 1, F.lit(PIECE)))
        states = F.aggregate(pieces, F.array(F.struct(*zero, none)), lambda told, piece: F.concat(told, F.array(F.aggregate(piece, F.element_at(told, -1).withField("found", none), step))))
        return F.when(F.size(items) > 0, F.flatten(F.transform(states, lambda s: s["found"]))).otherwise(empty)

    return F.get(F.transform(F.array(items), run), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, hit>> of the leftmost non-overlapping matches.

    The text between matches, by split(), gives the places that
    regexp_extract_all() does not tell.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(hits, gaps, lambda h, g: F.struct(g.alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())
    kind = "array<struct<start:int,stop:int,hit:string>>"

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("hit")))).alias("found"))

    return _fold(pairs, [F.lit(0).alias("at")], kind, step, F.array().cast(kind))


def _weight(count: Column) -> Column:
    """count * log2(count), 0 for 0."""
    return F.when(count <= 1, F.lit(0.0)).otherwise(count * F.log2(count.cast("double")))


def _window_spans(run: Column, alphabet: Column, bits: Column, window: int = WINDOW) -> Column:
    """Merged spans (from the run's start) of windows with at least `bits` of entropy."""
    spans = "array<struct<start:int,stop:int>>"
    places = F.transform(F.split(run, ""), lambda c: F.instr(alphabet, c))
    # 0 marks a place before the run, and one more item after it closes the last span; symbols count from 1
    both = F.zip_with(F.array_append(places, F.lit(-1)), F.concat(F.array_repeat(F.lit(0), window), places), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    steps = F.filter(both, lambda x: x["new"].isNotNull())

    def moved(counts, at, by):
        return F.transform(counts, lambda c, i: F.when(i == at, c + by).otherwise(c))

    def step(state, x):
        enter = F.get(state["counts"], x["new"])
        total = state["total"] + _weight(enter + 1) - _weight(enter)
        counts = moved(state["counts"], x["new"], 1)
        leave = F.get(counts, x["old"])
        total = F.when(x["old"] > 0, total - _weight(leave) + _weight(leave - 1)).otherwise(total)
        counts = F.when(x["old"] > 0, moved(counts, x["old"], -1)).otherwise(counts)
        at = state["at"] + 1
        hot = (at >= window) & (F.lit(log2(window)) - total / window >= bits - 1e-9)
        # an open span ends where the next hot window starts behind it, or with the run
        is_open = state["stop"] > 0
        last = x["new"] < 0
        apart = hot & (state["stop"] < at - window)
        closes = is_open & (last | F.coalesce(apart, F.lit(False)))
        found = F.when(closes, F.concat(state["found"], F.array(F.struct(state["start"].alias("start"), state["stop"].alias("stop"))))).otherwise(state["found"])
        start = F.when(hot & (~is_open | apart), at - window).otherwise(state["start"])
        return F.when(last, F.struct(state["counts"].alias("counts"), state["total"].alias("total"), at.alias("at"), state["start"].alias("start"), state["stop"].alias("stop"), found.alias("found"))).otherwise(
            F.struct(counts.alias("counts"), total.alias("total"), at.alias("at"), start.alias("start"), F.when(hot, at).otherwise(state["stop"]).alias("stop"), found.alias("found"))
        )

    zero = [F.array_repeat(F.lit(0), F.length(alphabet) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("stop")]
    return _fold(steps, zero, spans, step, F.array().cast(spans))


def _entropy_spans(text: Column) -> Column:
    found = _matches(text, CANDIDATE)
    fine = F.filter(found, lambda m: ~F.exists(F.array(*[F.lit(p) for p in ALLOW]), lambda p: F.regexp(m["hit"], p)))
    classes = F.array(*[F.struct(F.lit(alphabet).alias("alphabet"), F.lit(bits).alias("bits")) for alphabet, bits in CLASSES.values()])

    def spans(m):
        own = F.transform(F.slice(F.filter(classes, lambda c: F.length(F.call_function("translate", m["hit"], c["alphabet"], F.lit(""))) == 0), 1, 1), lambda c: _window_spans(m["hit"], c["alphabet"], c["bits"]))
        told = F.filter(F.flatten(own), lambda s: ~F.regexp(F.substring(m["hit"], s["start"] + 1, s["stop"] - s["start"]), F.lit(FILLER)))
        return F.transform(told, lambda s: F.struct((m["start"] + s["start"]).alias("start"), (m["start"] + s["stop"]).alias("stop")))

    return F.flatten(F.transform(fine, spans))


def _written(spans: Column) -> Column:
    """kind:start:stop by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and entropy: arrays of (start, kind, stop); kind indexes KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def kind(n, spans):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["stop"].alias("stop")))

    assign = F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= MIN_ASSIGN)
    access = F.filter(_matches(text, ACCESS), lambda m: m["stop"] - m["start"] >= MIN_ACCESS)
    # a match of HEX is a whole run, so only runs of the least length need be matched
    runs = _matches(text, HEX[:-1] + "{%d,}" % MIN_HEX)
    docs = spread(docs.select("doc_id", "text"))
    return docs.select("doc_id", F.concat(kind(0, assign), kind(1, access), kind(2, runs)).alias("base"), kind(3, _entropy_spans(text)).alias("entropy"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans for every row of docs."""
    found = find_spans(docs)
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size("entropy").cast("long").alias("n_entropy"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", "entropy")).alias("spans"),
    )
