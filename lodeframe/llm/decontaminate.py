"""Benchmark decontamination: size-partitioned MinHash containment search.

An item's sketch is its k smallest shingle hashes.  Items are partitioned by their
number n of distinct shingles (powers of two); within a partition k is
n - ceil(t n) + 1, so a document that holds a share t of the item's shingles holds
at least one sketch hash: the search loses nothing, however long the document is.
Documents too short for a partition skip it.  Candidates are verified by exact
containment of word shingles.  Documents are only mapped, never shuffled.

The item index is broadcast in blocks of about BLOCK_SHINGLES shingles; a larger
benchmark is searched block by block, each against all documents, and the driver holds
one block at a time.

Defined results: very long texts are searched whole, a chunk of their own.  Words are compared with A-Z lower-cased, split at ASCII white
space.  Items under five words are one shingle of all their words; items without
words never match.  Null texts have no words.  Repeated items and
repeated documents are each reported.  Empty tables give no rows; extra columns are kept by
drop_contaminated() and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.kernels import Words, shingle_hashes, text_chunks
from lodeframe.llm.session import WORD, ready, stored

WIDTH = 5
THRESHOLD = 0.8
BLOCK_SHINGLES = 1_000_000
_TABLE_BITS = 20
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes | None, width: int) -> set[tuple[bytes, ...]]:
    words = (text or b"").translate(_FOLD).split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


class ItemIndex:
    """Bottom-k sketches of items by shingle width and size class."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD):
        self.threshold, self.ids, self.texts = threshold, [], []
        self.widths, self.hashes, self.need = [], [], []
        for item_id, text in items:
            words = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
            n = int(words.first[-1])
            if not n:
                continue
            width = min(WIDTH, n)
            found = np.unique(shingle_hashes(words.hashes(lower=True), width))
            self.ids.append(item_id)
            self.texts.append(text)
            self.widths.append(width)
            self.hashes.append(found)
            self.need.append(ceil(threshold * len(found) - 1e-9))
        self.parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, int]] | None = None

    def partitions(self):
        """(width, size class) -> sketch hashes sorted, their items, a bit table, least shingles needed."""
        if self.parts is None:
            rows: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
            for i, found in enumerate(self.hashes):
                key = (self.widths[i], len(found).bit_length())
                rows.setdefault(key, []).append((found[: len(found) - self.need[i] + 1], i))
            self.parts = {}
            for key, members in rows.items():
                keys = np.concatenate([k for k, _ in members])
                owner = np.concatenate([np.full(len(k), i) for k, i in members])
                order = np.argsort(keys, kind="stable")
                table = np.zeros(1 << _TABLE_BITS, dtype=bool)
                table[keys & np.uint64((1 << _TABLE_BITS) - 1)] = True
                self.parts[key] = keys[order], owner[order], table, min(self.need[i] for _, i in members)
        return self.parts

    def search(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shingles found) of each row of a string column that holds an item."""
        out = []
        for start, _, data, offsets in text_chunks(column):
            words = Words(data, offsets)
            hashes = words.hashes(lower=True)
            counts = np.diff(words.first)
            row_of = np.repeat(np.arange(len(counts)), counts)
            widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            pairs: set[tuple[int, int]] = set()
            for (width, _), (keys, owner, table, least) in self.partitions().items():
                if width not in widths:
                    got = shingle_hashes(hashes, width)
                    rows = row_of[: len(got)]
                    inside = rows == row_of[width - 1 :]
                    widths[width] = got[inside], rows[inside]
                got, rows = widths[width]
                hit = np.flatnonzero(table[got & np.uint64((1 << _TABLE_BITS) - 1)] & (counts[rows] - width + 1 >= least))
                lo = np.searchsorted(keys, got[hit])
                hi = np.searchsorted(keys, got[hit], side="right")
                for h, a, b in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    pairs.update((int(rows[h]), int(owner[x])) for x in range(a, b))
            exact: dict[tuple[int, int], set] = {}
            for row, item in sorted(pairs):
                width = self.widths[item]
                got, rows = widths[width]
                own = got[np.searchsorted(rows, row) : np.searchsorted(rows, row, side="right")]
                if np.isin(self.hashes[item], own).sum() < self.need[item]:
                    continue
                if (row, width) not in exact:
                    exact[row, width] = shingles(data[offsets[row] : offsets[row + 1]].tobytes(), width)
                wanted = shingles(self.texts[item], width)
                found = len(wanted & exact[row, width])
                if found >= ceil(self.threshold * len(wanted) - 1e-9):
                    out.append((start + row, item, found))
        return out


def item_blocks(items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_SHINGLES) -> tuple[int, Iterator[ItemIndex]]:
    """How many indexes of bounded size together hold every item, and the indexes one after another."""
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    count = max(1, ceil(words / block))

    def build():
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
        dealt = stored(dealt.repartition("block")) if count > 1 else dealt
        for i in range(count):
            yield ItemIndex([(r["item_id"], r["text"].encode()) for r in dealt.filter(F.col("block") == i).collect()], threshold)

    return count, build()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment of each item held by each document."""
    ready(docs.sparkSession)
    columns = docs.select("doc_id", F.col("text").cast("string"))

    def over(index: ItemIndex):
        def run(batches):
            for batch in batches:
                found = index.search(batch.column(1))
                if found:
                    size = [len(shingles(index.texts[i], index.widths[i])) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([r for r, _, _ in found])), pa.array([index.ids[i] for _, i, _ in found], type=pa.int64()), pa.array(size, type=pa.int64()), pa.array([n for _, _, n in found], type=pa.int64())],
                        names=["doc_id", "item_id", "n_shingles", "n_found"],
                    )

        return columns.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, n_shingles long, n_found long")

    count, blocks = item_blocks(items, threshold, block)
    # a result is stored before the next block is read: the driver holds one
    found = reduce(DataFrame.unionByName, (stored(over(x)) if count > 1 else over(x) for x in blocks))
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of docs that hold no item, columns unchanged."""
    ready(docs.sparkSession)
    at = docs.columns.index("text")

    def over(frame: DataFrame, index: ItemIndex) -> DataFrame:
        def run(batches):
            for batch in batches:
                keep = np.ones(len(batch), dtype=bool)
                keep[[r for r, _, _ in index.search(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        return frame.mapInArrow(run, docs.schema)

    count, blocks = item_blocks(items, threshold, block)
    return reduce(lambda frame, index: stored(over(frame, index)) if count > 1 else over(frame, index), blocks, docs)
