"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two that differ in at most three bits
share at least five bytes.  Any five of eight positions hold three that lie in one
half (0-3 or 4-7), so the index posts every distinct fingerprint under the eight
triples of positions inside a half: each linked pair meets in a posting list.
There, shared positional bytes are tallied, pairs below five are dropped, and the
rest is verified by Hamming distance.  Posting lists of many fingerprints are posted
again by five positions, and cut into tiles of bounded size; a tile reports a
spanning forest, not its pairs.

Defined results: very long texts are hashed in slices.  Null, empty and blank texts have fingerprint zero; it links like
any other.  A null doc_id keeps its row and never names a component unless all ids
of the component are null.  Repeated rows stay, each with its result.  Extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import overlap
from lodeframe.llm.graph import components, local_labels
from lodeframe.llm.kernels import word_slices
from lodeframe.llm.session import discard, ready, stored
from lodeframe.sources.spread import spread

MAX_DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a posting-list tile side.
TILE = 256
#: Fingerprints of a posting list beyond which it is cut by two more positions.
HOT = 4096

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def _shingles(words: list[bytes], width: int, seed: int) -> np.ndarray:
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    stops = [*gaps.tolist(), len(joined)][width - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), dtype="<u8", count=len(stops))


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text."""
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in word_slices((text or b"").translate(_FOLD)):
        words = tail + words
        if len(words) >= width:
            hashes = _shingles(words, width, seed)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
            total += len(hashes)
        tail = words[max(0, len(words) - width + 1) :] if width > 1 else []
    if not total and tail:  # fewer words than the width: the whole sequence
        ones, total = np.unpackbits(_shingles(tail, len(tail), seed).view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        got = np.fromiter((fingerprint(x.as_py()) for x in column), dtype=np.uint64, count=len(column))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])


def _node_batches(batches, width: int):
    """Rows (doc_id, tie, text) to (doc_id, tie, node): the node is the fingerprint."""
    for batch in batches:
        got = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(2).cast(pa.large_binary())), dtype=np.uint64, count=len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], names=["doc_id", "tie", "node"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a signed long."""
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)
    tally = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(8):
        tally += x[:, None, i] == y[None, :, i]
    return tally


def links_within(fps: np.ndarray, distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one tile at Hamming distance of at most `distance`, count-filtered first."""
    out_a, out_b = [], []
    for at in range(0, len(fps), 512):
        a = np.ascontiguousarray(fps[at : at + 512])
        i, j = np.nonzero(_shared_bytes(a, fps) >= 8 - distance)
        keep = i + at < j
        i, j = i[keep] + at, j[keep]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= distance
        out_a.append(i[near])
        out_b.append(j[near])
    return np.concatenate(out_a), np.concatenate(out_b)


def _tile_edges(batches):
    """Rows (bucket, fp) sorted by bucket; a bucket may span batches."""

    def flush(fps):
        if len(fps) < 2:
            return None
        fps = np.unique(fps)
        a, b = links_within(fps)
        label = local_labels(len(fps), a, b)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return (fps[moved], fps[label[moved]]) if len(moved) else None

    left, held = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        if not len(batch):
            continue
        bucket = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        edges = [0, *cuts.tolist(), len(bucket)]
        found = []
        for a, b in zip(edges, edges[1:]):
            if left is not None and bucket[a] == left:
                held = np.concatenate([held, fp[a:b]])
            else:
                found.append(flush(held))
                left, held = bucket[a], fp[a:b]
        found = [x for x in found if x]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]).view(np.int64)) for k in (0, 1)], names=["a", "b"])
    last = flush(held)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in last], names=["a", "b"])


def _byte(i: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _posted(positions: tuple[int, ...], mark: int) -> Column:
    """Key of the bytes at the positions; mark tells keys of other positions apart."""
    return reduce(lambda key, i: key * 256 + _byte(i), positions, F.lit(mark).cast("long"))


def link_edges(classes: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that span every link at MAX_DISTANCE.

    A list of more than HOT fingerprints is posted again under its triple and each two
    of the five other positions: a linked pair shares two of these at least.
    """
    postings = classes.select("fp", F.explode(F.array(*[_posted(t, i + 1) for i, t in enumerate(TRIPLES)])).alias("key"))
    # checkpointed, so that AQE can split a frequent key in the join
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").checkpoint()
    listed = postings.join(lists, "key")
    finer = F.array(*[F.array(*[_posted((*t, *two), 8 + 16 * i + k) for k, two in enumerate(combinations(sorted({*range(8)} - {*t}), 2))]) for i, t in enumerate(TRIPLES)])
    again = listed.filter(F.col("n") > HOT).select("fp", F.explode(F.get(finer, (F.shiftright("key", 24) - 1).cast("int"))).alias("key"))
    small = again.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").checkpoint()
    listed = listed.filter(F.col("n") <= HOT).unionByName(again.join(small, "key"))
    cut = listed.withColumn("side", F.ceil(F.col("n") / tile).cast("long")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("side")))
    tiles = cut.select("key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)).alias("other"))
    bucket = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return (
        tiles.select(bucket.alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tile_edges, "a long, b long")
    )


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links."""
    ready(docs.sparkSession)
    prints = fingerprints(docs).checkpoint()
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")).checkpoint()
    found = components(link_edges(classes)).checkpoint()
    labelled = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("label"))
    # checkpointed, so that AQE can split a large component in the join
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id")).checkpoint()
    names = labelled.select("fp", "label").join(least, "label").select("fp", "component_id").checkpoint()
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar_names(rows: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, node) of rows (doc_id, tie, text), and (node, label) of components of nodes by similarity."""
    prints = stored(overlap.nodes(spread(rows), width, partial(fingerprint, width=width)))
    classes = prints.groupBy("fp").agg(F.min("node").alias("least_node"), F.max("node").alias("most_node")).checkpoint()
    by_fp = link_edges(classes.select("fp")).distinct()
    ends = [classes.select(F.col("fp").alias(x), F.col("least_node").alias(f"node_{x}")) for x in ("a", "b")]
    near = by_fp.join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    equal = classes.filter("least_node < most_node").select(F.col("least_node").alias("a"), F.col("most_node").alias("b"))
    suggested = near.unionByName(equal).filter("a <> b").checkpoint()
    return prints, components(overlap.links(rows, prints, suggested, width, similarity)).checkpoint()


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of docs without all but one document of each component, columns unchanged.

    Links are fingerprints of `width` words at MAX_DISTANCE or, if a similarity is given,
    sets of `width`-word shingles with at least that Jaccard similarity.  Then the byte
    index suggests pairs, overlap.links() adds those that it cannot reach, and all are
    compared exactly.

    The row with the smallest id stays, of several the one with the smallest hash of
    all its columns.  Rows without an id stay only where their component has no id, one
    of each.
    """
    ready(docs.sparkSession)
    tie = F.xxhash64(*[f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    rows = docs.select("doc_id", tie.alias("tie"), F.col("text").cast("string").alias("text"))
    if similarity is None:
        prints = spread(rows).mapInArrow(partial(_node_batches, width=width), f"doc_id {dict(docs.dtypes)['doc_id']}, tie long, node long").checkpoint()
        found = components(link_edges(prints.select(F.col("node").alias("fp")).distinct().checkpoint())).checkpoint()
    else:
        prints, found = _similar_names(rows, width, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    least = prints.groupBy("node").agg(F.min(order).alias("own"), F.count("*").alias("rows"))
    named = least.join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("node", "own", "rows", F.coalesce("component", "node").alias("label")).checkpoint()
    groups = named.groupBy("label").agg(F.min("own").alias("own"), F.sum("rows").alias("rows")).filter("rows > 1").checkpoint()
    members = stored(prints.select("node", "tie").join(named.select("node", "label").join(groups.select("label"), "label"), "node").select("tie").distinct())
    # only rows of groups are shuffled, and few others; the tie tells rows apart but for repeated ones
    bits = overlap.sieve(members, "tie")
    tied = docs.select(tie.alias("tie"), *[F.col(f"`{c}`").alias(f"_{n}") for n, c in enumerate(docs.columns)])
    gone = members.join(groups.select(F.col("own.tie").alias("tie")), "tie", "left_anti").checkpoint()
    discard(members)
    if similarity is not None:
        discard(prints)
    grouped = overlap.sifted(tied, bits).join(gone, "tie", "left_anti").dropDuplicates(["tie"])
    return grouped.unionByName(overlap.sifted(tied, bits, inside=False)).drop("tie").toDF(*docs.columns)
