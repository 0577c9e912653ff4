"""The k best rows of each of many queries, kept while a partition streams past."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells (rows by queries) of a tile: bounds what a task holds however large its batches are.
CELLS = 1 << 19


class Best:
    """The k rows of least key, then least id, of each of n queries; holds a bounded number of rows."""

    def __init__(self, n: int, k: int):
        self.k, self.room, self.edge = k, 4 * n * k + (1 << 16), np.full(n, np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, query: np.ndarray, key: np.ndarray, row: np.ndarray, ids: pa.Array) -> None:
        """Rows (numbers in ids) with the queries they answer; ties of the k-th stay until ids decide."""
        near = np.flatnonzero(key <= self.edge[query])
        if len(near):
            self.parts.append((query[near], key[near], ids.take(pa.array(row[near]))))
            self.size += len(near)
            if self.size > self.room:
                self._fold()

    def _fold(self) -> None:
        query, key = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, key, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        key = key[order]
        self.edge[query[rank == self.k - 1]] = key[rank == self.k - 1]
        self.parts, self.size = [(query, key, ids.take(pa.array(order)))], len(order)

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """Numbers of the queries, keys and ids of what is kept; None if there is nothing."""
        if not self.parts:
            return None
        self._fold()
        return self.parts[0]
