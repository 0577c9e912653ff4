"""Links between texts by the Jaccard similarity of their word shingles.

A text is the set of its word shingles, as 64-bit hashes, with BANDS keys, each made of
ROWS minima of the set under one hash function.  Sets of similarity s share a key with
probability 1 - (1 - s^ROWS)^BANDS: at 0.8 all but three of a million such pairs do.
Texts that share a passage only, however common it is, share hardly any.

1. Equal sets collapse to one node.  Each node is compared with two pivots of each list
   of nodes that share a key, and with the links that the caller suggests.
2. Where a list still holds several components, all pairs of unlike components are
   compared by size and bitmap, chunk by chunk inside tasks that report only the pairs
   let through.  Groups of near copies are one component by then.

Every comparison is exact, on the whole sets, after parity bitmaps of the sets have
dropped pairs that differ in too many shingles.

Defined results: A-Z is lower-cased and words are split at ASCII white space.  Texts
of fewer words than the width are one shingle; texts without words are equal.  Very
long texts are handled in blocks of shingles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.graph import components
from lodeframe.llm.kernels import Words, mix64, shingle_hashes, text_chunks
from lodeframe.llm.session import discard, stored

#: Keys of a set, and minima in a key.
BANDS, ROWS = 32, 5
#: Shingles whose minima are taken at once.
BLOCK = 2_048
#: Bits a shingle of a set's parity bitmap, up to twice as many, and most bits.
PARITY_SHARE, PARITY = 4, 1 << 17
#: Nodes of a list's chunk that are compared with all nodes outside its largest component.
CHUNK = 4_096
#: Pairs with one end in common that are compared in one task.
PAIRS = 256
#: Bits of a key: keys that fall together add pairs to compare and lose none.
KEY_BITS = 48
#: Bits of a sieve(): half a megabyte, whatever the input, so that it travels with its tasks.
SIEVE = 1 << 22


def sieve(values: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the low bits of a long column; rows that it lets through by chance are the caller's to drop.

    Of more values than a quarter of its bits it lets most rows through: what follows is then right
    as before, and shuffles most of its input.
    """
    size = SIEVE
    bit = F.col(column).bitwiseAND(F.lit(size - 1))
    word = F.shiftright(bit, 6).cast("int").alias("at")
    found = values.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    found = found.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _hit(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (64 * len(bits) - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def sifted(rows: DataFrame, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose `tie` is in the bitmap, or those whose is not; nothing is shuffled."""
    place = rows.columns.index("tie")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_hit(bits, batch.column(place).to_numpy()) == inside))

    return rows.mapInArrow(run, rows.schema)


def shingle_sets(column: pa.Array, width: int):
    """Sorted distinct shingle hashes of each text of a string column."""
    for start, end, data, offsets in text_chunks(column):
        words = Words(data, offsets)
        hashes = words.hashes(lower=True)
        for i in range(end - start):
            own = hashes[words.first[i] : words.first[i + 1]]
            yield np.unique(shingle_hashes(own, min(width, len(own)))) if len(own) else own


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; equal sets have equal keys, the empty set too."""
    factor, shift = _functions()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), BLOCK):
        least = np.minimum(least, (grams[at : at + BLOCK, None] * factor + shift).min(axis=0))
    least = mix64(least).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, i])
    return key >> np.uint64(64 - KEY_BITS)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([*rows, np.zeros(0, dtype=np.uint64)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))


def parity(grams: np.ndarray) -> np.ndarray:
    """Bitmap with the parity of the shingles that fall on each bit: two sets differ in at least as many shingles as bits.

    The larger of two bitmaps folds to the smaller by the exclusive or of its halves.
    """
    size = min(PARITY, max(64, 1 << int(PARITY_SHARE * len(grams) - 1).bit_length()))
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def nodes(rows: DataFrame, width: int, fingerprint: Callable[[bytes | None], int]) -> DataFrame:
    """(doc_id, tie, fp, node, n, keys, bits) of rows (doc_id, tie, text); equal sets have one node."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            sets = list(shingle_sets(batch.column(2), width))
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets), dtype=np.uint64, count=len(sets))
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2).cast(pa.large_binary())), dtype=np.uint64, count=len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fp.view(np.int64)), pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], type=pa.int32()), _lists([band_keys(s) for s in sets]), _lists([parity(s) for s in sets])],
                names=["doc_id", "tie", "fp", "node", "n", "keys", "bits"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, tie long, fp long, node long, n int, keys array<long>, bits array<long>")


def _postings(prints: DataFrame, bits: np.ndarray) -> DataFrame:
    """(key, node, n) of the keys that are in the bitmap."""

    def run(batches):
        for batch in batches:
            keys = batch.column(2)
            flat = keys.flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(keys.offsets.to_numpy()))
            hit = np.flatnonzero(_hit(bits, flat))
            take = pa.array(row[hit])
            for at in range(0, len(hit), 1 << 16):
                some = slice(at, at + (1 << 16))
                part = take[some]
                yield pa.RecordBatch.from_arrays([pa.array(flat[hit[some]]), batch.column(0).take(part), batch.column(1).take(part)], names=["key", "node", "n"])

    return prints.select("node", "n", "keys").mapInArrow(run, "key long, node long, n int")


def _most_differ(m, n, similarity: float):
    """Shingles that two sets of m and n may have alone at the similarity."""
    return (m + n) * (1 - similarity) / (1 + similarity) + 1e-6


def _differing_bits(s, t):
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda u, v: u.bitwiseXOR(v))).otherwise(x)
    apart = F.zip_with(fold(s, t), fold(t, s), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(apart, F.lit(0), lambda total, x: total + x)


def _linked(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity; bitmaps drop most others, the sets decide.

    Where many pairs share an end it should be a: its text is shuffled once.
    """
    one, other = (classes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits", "tie")]) for x in "ab")
    near = _differing_bits(F.col("bits_a"), F.col("bits_b")) <= _most_differ(F.col("n_a"), F.col("n_b"), similarity)
    # sizes first: bitmaps of sets whose sizes allow the similarity fold once at most
    alike = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    pairs = pairs.join(one, "a").join(other, "b").filter(F.when(alike, near).otherwise(False)).select("a", "b", "tie_a", "tie_b").checkpoint()
    owners = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(f"tie_{x}").alias("tie")) for x in "ab"])).alias("o")).select("o.*").distinct().checkpoint()
    # rows that repeat have one text
    texts = stored(sifted(rows.select("tie", "text"), sieve(owners, "tie")).join(owners, "tie").dropDuplicates(["tie"]).select("node", "text"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width)):
                apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                keep.append(apart <= _most_differ(len(x), len(y), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    # the text of an end that many pairs share is dealt out to several tasks
    parts = pairs.groupBy(F.col("a").alias("node")).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")).checkpoint()
    shared = texts.join(parts, "node").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("x"))
    dealt = pairs.join(parts.withColumnRenamed("node", "a"), "a").select("a", "b", F.pmod(F.hash("b"), F.col("parts")).alias("part"))
    both = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(shared, ["a", "part"])
    found = both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").checkpoint()
    discard(texts)
    return found


def _folded(bits: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, bitmaps and whether folded, by length in words; those of the next length come along, folded."""
    size = np.array([len(x) for x in bits])
    out = {}
    for words in np.unique(np.concatenate([size, size[size > 1] // 2])).tolist():
        own, next_ = np.flatnonzero(size == words), np.flatnonzero(size == 2 * words)
        maps = [np.array([bits[i] for i in own], dtype=np.uint64).reshape(-1, words)]
        wide = np.array([bits[i] for i in next_], dtype=np.uint64).reshape(-1, 2 * words)
        out[words] = np.concatenate([own, next_]), np.concatenate([*maps, wide[:, :words] ^ wide[:, words:]]), np.repeat([False, True], [len(own), len(next_)])
    return out


def _near_pairs(one, other, similarity: float):
    """Places (i, j) of unlike labels whose sizes and bitmaps allow the similarity; one and other are (n, label, folded)."""
    found_i, found_j = [], []
    for words in one[2].keys() & other[2].keys():
        (at, x, halved), (to, y, cut) = one[2][words], other[2][words]
        step = max(1, (1 << 20) // max(1, len(to) * words))
        for k in range(0, len(at), step):
            i = at[k : k + step]
            m, n = one[0][i][:, None], other[0][to][None, :]
            fit = (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-6) & (one[1][i][:, None] != other[1][to][None, :]) & ~(halved[k : k + step, None] & cut)
            apart = np.bitwise_count(x[k : k + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
            p, q = np.nonzero(fit & (apart <= _most_differ(m, n, similarity)))
            found_i.append(i[p])
            found_j.append(to[q])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _unlike(left: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of unlike labels of a list that sizes and bitmaps allow; left is (key, node, n, label, most, bits).

    A list is cut into chunks; the nodes outside its largest component pass all of them.
    Only pairs that the bitmaps let through leave a task, each from the first list that
    holds both.
    """
    chunks = left.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).checkpoint()
    lists = left.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("lists"))  # BANDS at most
    rows = left.join(chunks, "key").join(lists, "node").withColumn("few", F.col("label") != F.col("most"))
    columns = ["key", "node", "n", "label", "bits", "lists", "few"]
    home = rows.select(F.pmod(F.hash("node"), F.col("chunks")).alias("chunk"), F.lit(0).alias("role"), *columns)
    few = rows.filter("few").select(F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), *columns)
    dealt = home.unionByName(few).withColumn("bucket", F.xxhash64("key", "chunk")).select("bucket", "role", *columns)

    def part(batch, a, b):
        rows = batch.slice(a, b - a)
        node, n, label = (rows.column(i).to_numpy() for i in (3, 4, 5))
        bits, lists = ([x.values.to_numpy() for x in rows.column(i)] for i in (6, 7))
        return node, n, label, [x.view(np.uint64) for x in bits], lists, rows.column(8).to_numpy(zero_copy_only=False)

    def run(batches):
        now, home, other = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            bucket, role, key = (batch.column(i).to_numpy() for i in (0, 1, 2))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (role[1:] != role[:-1])) + 1
            edges = [0, *cuts.tolist(), len(batch)]
            out = []
            for a, b in zip(edges, edges[1:]):
                if bucket[a] != now:
                    now, home, other = bucket[a], [], None
                if role[a] == 0:
                    home.append(part(batch, a, b))
                    continue
                if not home:  # a chunk that the hash left empty
                    continue
                if other is None:
                    nodes, n, label = (np.concatenate([h[i] for h in home]) for i in (0, 1, 2))
                    bits, lists = ([x for h in home for x in h[i]] for i in (3, 4))
                    other = nodes, (n, label, _folded(bits)), lists, np.concatenate([h[5] for h in home])
                own, n, label, bits, lists, _ = part(batch, a, b)
                i, j = _near_pairs((n, label, _folded(bits)), other[1], similarity)
                once = ~other[3][j] | (own[i] < other[0][j])  # two nodes that both pass are met twice
                for x, y in zip(i[once].tolist(), j[once].tolist()):
                    if np.intersect1d(lists[x], other[2][y], assume_unique=True)[0] == key[a]:
                        out.append((own[x], other[0][y]))
            if out:
                x, y = np.array(out, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket", "role").mapInArrow(run, "a long, b long")


def links(rows: DataFrame, prints: DataFrame, suggested: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes that span every link of the similarity.

    rows are (doc_id, tie, text), prints their nodes(), suggested are pairs (a, b) of nodes to compare first.
    """
    classes = stored(prints.groupBy("node").agg(F.min("tie").alias("tie"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    # checkpointed, so that AQE can split a frequent key in the joins
    lists = prints.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key").checkpoint()
    hits = stored(_postings(prints, sieve(lists, "key")).join(lists, "key", "left_semi").distinct())
    ends = ((F.min, "low"), (F.max, "high"))
    pivots = stored(hits.groupBy("key").agg(*[f(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias(p) for f, p in ends]).filter("low.node <> high.node"))
    stars = hits.join(pivots, "key").select("node", "n", F.explode(F.array("low", "high")).alias("p"))
    alike = lambda m, n: F.least(m, n) >= similarity * F.greatest(m, n) - 1e-6
    stars = stars.filter((F.col("node") != F.col("p.node")) & alike(F.col("n"), F.col("p.n"))).select(F.col("p.node").alias("a"), F.col("node").alias("b"))
    # of the two ways round, the one whose a is a pivot; where both are, one
    first = stars.unionByName(suggested).groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max("a").alias("a"))
    first = first.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"), "low", "high").checkpoint()
    edges = _linked(rows, classes, first.select("a", "b"), width, similarity)

    found = components(edges).withColumnRenamed("node", "member").checkpoint()
    told = hits.join(pivots.select("key"), "key", "left_semi").join(found, F.col("node") == F.col("member"), "left")
    told = stored(told.select("key", "node", "n", F.coalesce("component", "node").alias("label")))
    mixed = told.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.mode("label", True).alias("most")).filter("l0 < l1").select("key", "most").checkpoint()
    left = stored(told.join(mixed, "key").join(classes.select("node", "bits"), "node"))
    discard(hits, pivots, told)
    rest = _unlike(left, similarity).distinct().join(first.select("low", "high"), [F.col("a") == F.col("low"), F.col("b") == F.col("high")], "left_anti").checkpoint()
    # of the first links their stars, which span the same groups
    stars = found.filter("member <> component").select(F.col("member").alias("a"), F.col("component").alias("b"))
    edges = stars.unionByName(_linked(rows, classes, rest, width, similarity))
    discard(classes, left)
    return edges
