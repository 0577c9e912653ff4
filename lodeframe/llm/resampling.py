"""Importance resampling towards a target corpus: hashed n-gram features, Gumbel top-k.

Every run of words falls into one of `buckets`; a bucket's gain is its log-ratio of
target to raw frequency in thousandths, and a document's weight the sum of the gains
of its features, looked up in one array of all gains.  A Gumbel number made of the
document's id is added, so that the highest scores are a draw without replacement in
proportion to exp(weight / 1000).  The draw of the k highest is exact: a radix
selection counts the digits of the composite key (score, doc_id), sixteen bits a time,
until the k-th key is known; only the rows up to it are range-sorted and ranked.

What the driver holds: `buckets` gains, at most 65,536 digit counts a step, one
count per partition of the drawn rows.

Defined results: a null or empty text has no features and weight 0.  A null doc_id
is hashed as an empty one and comes last among ties.  Rows that repeat an id are rows
of their own; equal keys are told apart by n_features, and rows that are equal in all
of these get their ranks in any order.  Very long texts are scored whole.  An empty
table gives no rows; an empty target scores against equal shares.  Extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.ranges import numbered
from lodeframe.llm.session import ready, stored
from lodeframe.sources.spread import spread

#: Words before A-Z are lower-cased.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 10_000
ORDERS = (1, 1)
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bits of a digit of the radix selection: at most 2^16 counts come to the driver at a step.
DIGIT = 16


def feature_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    words = F.coalesce(F.regexp_extract_all(text.cast("string"), F.lit(FEATURE_WORD), F.lit(0)), F.array().cast("array<string>"))
    fold = lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # lower() is many times faster, and the same where all characters are ASCII
    return F.transform(words, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(fold(w)))


def feature_buckets(words: Column, buckets: int = BUCKETS, orders: tuple[int, int] = ORDERS) -> Column:
    """Bucket of every run of orders[0] to orders[1] consecutive words, repeats kept."""

    def of_order(held: Column, n: int) -> Column:
        starts = F.slice(held, 1, F.greatest(F.size(held) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.array_join(F.slice(held, i + 1, n), " "))

    def runs(held: Column) -> Column:
        return F.concat(*[held if n == 1 else of_order(held, n) for n in range(orders[0], orders[1] + 1)])

    # the words are bound once: as an expression they would be made anew for each run
    found = F.get(F.transform(F.array(words), runs), 0)
    return F.transform(found, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, `gains`: thousandths of the log-ratio of each bucket, in bucket order.

    raw and target have a column `found` of buckets; explode_outer, as explode would make
    it a second time for a filter on its size.
    """

    def counts(of: DataFrame, name: str) -> DataFrame:
        return of.select(F.explode_outer("found").alias("bucket")).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))

    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(raw, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    held = both.groupBy().agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("of"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))

    def gain(x: Column) -> Column:
        over = (x["t"] + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
        under = (x["s"] + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
        return F.floor(1000 * F.ln(over / under)).cast("long")

    return held.select(F.transform("of", gain).alias("gains"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that the seed and the id decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, orders: tuple[int, int] = ORDERS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row of docs (doc_id, text), by the texts of target (text)."""
    found = spread(docs.select("doc_id", "text")).select("doc_id", feature_words(F.col("text")).alias("words"))
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), feature_buckets(F.col("words"), buckets, orders).alias("found"))
    wanted = target.select(feature_buckets(feature_words(F.col("text")), buckets, orders).alias("found"))
    gain_of = stored(gains(found, wanted, buckets))
    scored = found.withColumn("gains", gain_of.scalar())  # an array of `buckets` longs, sent to each task once
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get("gains", b))
    return scored.select("doc_id", "n_words", F.size("found").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def kth_key(rows: DataFrame, keys: list[Column], k: int) -> list[int]:
    """The k-th smallest row (from 1) by keys, columns of longs: a radix selection.

    rows must have k rows at least.  Digits that all rows share are skipped.
    """
    found, left = [], k
    for key in keys:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        for shift in range(64 - DIGIT, -1, -DIGIT):
            if low >> shift == high >> shift:
                continue
            digit = F.shiftright(key, shift)  # the digits above are fixed by now
            for at, n in sorted(rows.groupBy(digit).count().collect()):
                if left <= n:
                    break
                left -= n
            rows = rows.filter(digit == at)
            low, high = max(low, at << shift), min(high, (at << shift) + (1 << shift) - 1)
        found.append(low)
        rows = rows.filter(key == low)
    return found


def _up_to(keys: list[Column], bound: list[int]) -> Column:
    """Whether a row's keys are at or before the bound, in lexicographic order."""
    steps = list(zip(keys, bound))
    return reduce(lambda after, step: (step[0] < step[1]) | ((step[0] == step[1]) & after), reversed(steps), F.lit(True))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, orders: tuple[int, int] = ORDERS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs; rank is null where the row is not drawn.

    Of the rows with least_words words, floor(percent / 100 of them) are drawn.
    doc_id is of an integer type.
    """
    ready(docs.sparkSession)
    scored = stored(weigh(docs, target, buckets, orders, seed))
    out = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    able = F.col("n_words") >= least_words
    wanted = percent * scored.filter(able).count() // 100
    if not wanted:
        return scored.select(*out, undrawn)
    keys = [F.bitwise_not("score"), F.col("doc_id").isNull().cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("n_features")]
    drawn = able & _up_to(keys, kth_key(scored.filter(able), keys, wanted))
    ranked = numbered(scored.filter(drawn).select(*out), keys, "place")
    rank = F.when(F.col("place") < wanted, F.col("place") + 1).alias("rank")  # rows equal to the last one may be more
    return scored.filter(~drawn).select(*out, undrawn).unionByName(ranked.select(*out, rank))
