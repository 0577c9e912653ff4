"""Substring dedup: words covered by a window that also starts in a document with a smaller id.

A window is WINDOW consecutive words.  Each window names as its anchor the smallest
hash of the ANCHOR-word runs inside it, so equal windows have equal anchors.  The
consecutive windows of a document that share one anchor form a bundle: about one
row per 13 words.

1. Bundles are aggregated by anchor before anything is searched.  An anchor seen in
   one document only has no repeats.  Equal bundles collapse to their smallest id.
2. The distinct bundles of all other anchors go to shards by anchor.  Those of an
   anchor with more than HOT bundles go window by window, equal windows merged first.
   A shard builds a compressed FM-index over their words, taken as runs of STRIDE words
   at stride STRIDE so that a window is WINDOW / STRIDE symbols.  Every bundle of the
   shard is streamed through backward search over the wavelet matrix, which gives each
   position its matching statistic; where it reaches a window, the range of suffixes
   gives the smallest document that holds it.
3. Windows found in a smaller document become intervals per document.

No text leaves its document except the distinct bundles of step 2, and no shard
grows with a group of copies.

Defined results: null, empty and short texts have no windows; nothing is removed and
the hash is that of the words joined by one space.  Very long texts are bundled in
slices of SLICE words and rewritten in slices too.  Rows with a null doc_id neither
lose words nor cause losses.  Rows that repeat a doc_id are not smaller than each
other; each is judged by its own text.  Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.fmindex import FMIndex
from lodeframe.llm.kernels import Words, _powers, mix64, shingle_hashes, text_chunks, window_hashes, word_slices
from lodeframe.llm.session import discard, ready, stored
from lodeframe.sources.spread import spread

WINDOW = 50
ANCHOR = 25
STRIDE = 10
#: Distinct bundles of an anchor beyond which its windows are dealt out one by one.
HOT = 64
#: Bundles per shard aimed at.
SHARD_BUNDLES = 20_000
#: Words of a row that are bundled at once.
SLICE = 1 << 20
_PLACE_BITS = np.uint64(24)
_PIECES = ["window", "anchor", "bundle", "skip", "n", "least_id", "words"]
_ENTRY = ["window", "anchor", "bundle", "n", "least_id", "words"]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, span = len(x), 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if width > span:
        x = np.minimum(x[: n - width + 1], x[width - span :])
    return x


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash of every run of `width`, by blocks whose places fit the low bits."""
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    step = int(low) + 1 - width
    out = []
    for at in range(0, len(x) - width + 1, step):
        part = x[at : at + step + width - 1]
        keyed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append((_sliding_min(keyed, width) & low).astype(np.int64) + at)
    return np.concatenate(out)


def bundles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor, bundle hash) of each bundle; rows own `counts` of the word hashes, in order."""
    empty = np.zeros(0, dtype=np.int64)
    if len(hashes) < WINDOW:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    runs = window_hashes(hashes, ANCHOR)
    pick = _sliding_argmin(runs, WINDOW - ANCHOR + 1)
    inside = row[: len(pick)] == row[WINDOW - 1 :]
    begins = inside.copy()
    begins[1:] &= ~(inside[:-1] & (pick[1:] == pick[:-1]))
    first = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~(inside[1:] & (pick[1:] == pick[:-1]))
    n = np.flatnonzero(ends) + 1 - first
    _, power, inverse = _powers(3001, len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    whole = mix64((sums[first + n + WINDOW - 1] - sums[first]) * inverse[first] + n.astype(np.uint64))
    return row[first], first - (np.cumsum(counts) - counts)[row[first]], n, runs[pick[first]], whole


def _sliced(words: Words):
    """(word hashes, words per row, first word) of the rows; a row of more than SLICE words comes in slices.

    Slices overlap by a window less one word: each window begins in one of them.
    """
    hashes, counts = words.hashes(), np.diff(words.first)
    if len(counts) > 1 or len(hashes) <= SLICE:
        yield hashes, counts, 0
        return
    for at in range(0, len(hashes) - WINDOW + 1, SLICE):
        part = hashes[at : at + SLICE + WINDOW - 1]
        yield part, np.array([len(part)]), at


def _bundle_batches(batches):
    for batch in batches:
        for start, _, data, offsets in text_chunks(batch.column(2)):
            for hashes, counts, word in _sliced(Words(data, offsets)):
                row, at, n, anchor, whole = bundles(hashes, counts)
                if len(row):
                    take = pa.array(row + start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array((at + word).astype(np.int32)), pa.array(n.astype(np.int32))],
                        names=["anchor", "bundle", "doc_id", "text_hash", "at", "n"],
                    )


def _content_batches(batches):
    """Rows (wanted: array of (anchor, bundle, at, n, hot), least_id, text) to (window, anchor, bundle, skip, n, least_id, words).

    A bundle of a frequent anchor gives a row per window, named by its hash; a batch tells the words of a window once.
    """
    kind = pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), kind]
    for batch in batches:
        out, told = [], set()
        for wanted, least, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
            hashes = Words(data, np.array([0, len(data)])).hashes()
            for w in wanted:
                own = hashes[w["at"] : w["at"] + w["n"] + WINDOW - 1]
                if w["hot"]:
                    for j, k in enumerate(window_hashes(own, WINDOW).view(np.int64).tolist()):
                        out.append((k, w["anchor"], w["bundle"], j, 1, least, None if k in told else own[j : j + WINDOW].view(np.int64)))
                        told.add(k)
                else:
                    out.append((None, w["anchor"], w["bundle"], 0, w["n"], least, own.view(np.int64)))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=_PIECES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=_PIECES)


def least_documents(contents: list[np.ndarray], windows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every window of every bundle, in order: the smallest id among the bundles that hold it.

    The index holds all bundles, and each is streamed through it: a position's matching
    statistic is the number of symbols from it that occur elsewhere too, and where that
    reaches a whole window the range of suffixes tells the documents.
    """
    width = WINDOW // STRIDE
    sizes = np.array([len(c) for c in contents])
    flat = np.concatenate(contents).view(np.uint64)
    owner = np.repeat(np.arange(len(contents)), sizes)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    runs = shingle_hashes(flat, STRIDE)
    keep = offset[: len(runs)] + STRIDE <= sizes[owner[: len(runs)]]
    runs, owner, offset = runs[keep], owner[: len(keep)][keep], offset[: len(keep)][keep]
    _, symbols = np.unique(runs, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    # residue sequences: symbols of one bundle at equal offset modulo STRIDE, each closed by 0
    order = np.lexsort((offset, offset % STRIDE, owner))
    lane = owner[order] * STRIDE + offset[order] % STRIDE
    last = np.concatenate([lane[1:] != lane[:-1], [True]])
    place = np.arange(len(order)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    text = np.zeros(int(place[-1]) + 2, dtype=np.int64)
    text[place] = symbols[order]
    where = np.empty(len(order), dtype=np.int64)
    where[order] = place
    holder = np.full(len(text), np.iinfo(np.int64).max)
    holder[place] = least[owner[order]]
    index = FMIndex(text, int(symbols.max()) + 1)
    # the windows: (bundle, j) begins at the symbol of offset j
    begin = where[offset < windows[owner]]
    patterns = text[begin[:, None] + np.arange(width)]
    lo, hi, matched = index.search(patterns)
    out = np.repeat(least, windows)
    long = np.flatnonzero(matched == width)
    if len(long):
        by_suffix = np.append(holder[index.suffixes], np.iinfo(np.int64).max)
        spans, back = np.unique(lo[long] * (len(text) + 1) + hi[long], return_inverse=True)
        a, b = spans // (len(text) + 1), spans % (len(text) + 1)
        out[long] = np.minimum.reduceat(by_suffix, np.stack([a, b], axis=1).ravel())[::2][back]
    return out


def _shard_batches(batches):
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    words = table.column("words").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    offsets = words.offsets.to_numpy()
    flat = words.values.to_numpy()
    n = table.column("n").to_numpy()
    least = table.column("least_id").to_numpy()
    found = least_documents([flat[a:b] for a, b in zip(offsets, offsets[1:])], n, least)
    ends = np.cumsum(n)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(found))
    out = pa.table({"window": table.column("window"), "anchor": table.column("anchor"), "bundle": table.column("bundle"), "least": lists})
    yield from out.to_batches(max_chunksize=4096)


def _remove_batches(batches):
    """Rows (doc_id, text, spans) to the digest of each document."""
    for batch in batches:
        total, removed, digest = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            # starts and ends of the removed words, merged and in order
            edges = sorted((s["at"], s["at"] + s["n"] + WINDOW - 1) for s in spans or [])
            at, gone, first, sha = 0, 0, True, hashlib.sha256()
            drop: list[list[int]] = []
            for a, b in edges:
                if drop and a <= drop[-1][1]:
                    drop[-1][1] = max(drop[-1][1], b)
                else:
                    drop.append([a, b])
            for words in word_slices((text.as_py() or "").encode()):
                kept, here = [], 0
                while drop and drop[0][0] < at + len(words):
                    a, b = drop[0]
                    kept += words[here : max(here, a - at)]
                    here = min(b - at, len(words))
                    gone += here - max(0, a - at)
                    if b > at + len(words):
                        break
                    drop.pop(0)
                kept += words[here:]
                if kept:
                    sha.update((b"" if first else b" ") + b" ".join(kept))
                    first = False
                at += len(words)
            total.append(at)
            removed.append(gone)
            digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans: runs (at, n) of window starts that also start in a smaller document."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("text_hash"), text.alias("text"))
    seen = stored(spread(source).mapInArrow(_bundle_batches, "anchor long, bundle long, doc_id long, text_hash int, at int, n int"))
    anchors = seen.groupBy("anchor").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"))
    # stored, as an aggregation right below a join on its key would keep AQE from splitting a frequent anchor
    anchors = stored(anchors.filter("least_id < most_id").select("anchor"))
    hits = stored(seen.join(anchors, "anchor"))
    discard(seen, anchors)

    classes = stored(hits.groupBy("anchor", "bundle").agg(F.min(F.struct("doc_id", "text_hash", "at", "n")).alias("own")))
    crowded = stored(classes.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot")))
    wanted = (
        classes.join(crowded, "anchor", "left")
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .groupBy("own.doc_id", "own.text_hash")
        .agg(F.collect_list(F.struct("anchor", "bundle", F.col("own.at").alias("at"), F.col("own.n").alias("n"), "hot")).alias("wanted"))
        .withColumnRenamed("doc_id", "least_id")
        .withColumnRenamed("text_hash", "own_hash")
    )
    # rows that repeat an id and a text are one owner: its windows go to the index once
    owners = source.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    joined = owners.join(wanted, (F.col("doc_id") == F.col("least_id")) & (F.col("text_hash") == F.col("own_hash"))).select("wanted", "least_id", "text")
    pieces = stored(joined.mapInArrow(_content_batches, "window long, anchor long, bundle long, skip int, n int, least_id long, words array<long>"))
    discard(classes, crowded)
    # equal windows of frequent anchors are one entry of the index, merged before they are dealt out
    windows = pieces.filter("window IS NOT NULL").groupBy("window").agg(F.min("least_id").alias("least_id"), F.first("words", ignorenulls=True).alias("words"))
    entries = pieces.filter("window IS NULL").select(F.col("anchor").alias("shard"), "window", "anchor", "bundle", "n", "least_id", "words")
    entries = entries.unionByName(windows.select(F.col("window").alias("shard"), "window", F.lit(0).cast("long").alias("anchor"), F.lit(0).cast("long").alias("bundle"), F.lit(1).alias("n"), "least_id", "words"))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.count() // SHARD_BUNDLES + 1)
    found = stored(entries.repartition(shards, "shard").select(*_ENTRY).mapInArrow(_shard_batches, "window long, anchor long, bundle long, least array<long>"))
    told = found.filter("window IS NOT NULL").select("window", F.get("least", F.lit(0)).alias("one"))
    parts = pieces.filter("window IS NOT NULL").select("window", "anchor", "bundle", "skip").join(told, "window")
    parts = parts.groupBy("anchor", "bundle").agg(F.sort_array(F.collect_set(F.struct("skip", "one"))).alias("parts"))  # at most n parts of a bundle
    least = stored(found.filter("window IS NULL").select("anchor", "bundle", "least").unionByName(parts.select("anchor", "bundle", F.col("parts.one").alias("least"))))
    discard(pieces, found)
    smaller = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), i)), lambda i: i.isNotNull())
    judged = hits.join(least, ["anchor", "bundle"]).select("doc_id", "text_hash", "at", "n", smaller.alias("smaller"))
    runs = F.when(F.size("smaller") == F.col("n"), F.array(F.struct("at", "n"))).otherwise(F.transform("smaller", lambda j: F.struct((F.col("at") + j).cast("int").alias("at"), F.lit(1).alias("n"))))
    spans = stored(judged.filter(F.size("smaller") > 0).select("doc_id", "text_hash", F.explode(runs).alias("run")).groupBy("doc_id", "text_hash").agg(F.collect_set("run").alias("spans")))
    discard(hits, least)
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    spans = repeated_windows(docs).withColumnRenamed("doc_id", "span_id").withColumnRenamed("text_hash", "span_hash")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    joined = rows.join(spans, (F.col("doc_id") == F.col("span_id")) & (F.hash("text") == F.col("span_hash")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_remove_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")
