"""Connected components on DataFrames: forests contracted inside partitions, and pointer jumping.

Each round is one table: an equi-join that sends every node to the root of its root,
which AQE can split at a frequent root, and a contraction of the edges that meet in a
partition, dealt out by their larger end.  No component is ever gathered in one task or on
the driver.  Roots only become smaller, so the rounds settle, and what no round changes
is a star for each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.session import discard, stored

#: Edges that a task contracts at once.
EDGES = 1 << 20


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), b < a, of a partition to a forest: (node, smallest node reachable in its part).

    At most EDGES edges are held.  Where a part ends inside the edges of one a, its root is
    carried on, so that of sorted input every a comes out with one edge for itself.
    """

    def parts():
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            n += len(batch)
            if n >= EDGES:
                yield np.concatenate(held, axis=1), False
                held, n = [], 0
        if held:
            yield np.concatenate(held, axis=1), True

    carried = np.zeros((2, 0), dtype=np.int64)
    for edges, ends in parts():
        edges = np.concatenate([carried, edges], axis=1)
        if not edges.shape[1]:
            continue
        nodes, place = np.unique(edges, return_inverse=True)
        a, b = place.reshape(edges.shape)
        label = local_labels(len(nodes), a, b)
        moved = label != np.arange(len(nodes))
        carried = np.zeros((2, 0), dtype=np.int64)
        if not ends:
            carried = np.array([[edges[0, -1]], [nodes[label[a[-1]]]]])
            moved[a[-1]] = False
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])
    if carried.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(carried[0]), pa.array(carried[1])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), longs; component is the smallest node reachable.

    Self loops and repeated edges are allowed; null ends are dropped; no edges give no rows.
    """
    now = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    # dealt out by both ends first: of a hub's edges each partition keeps one
    now = stored(now.repartition("a", "b").mapInArrow(_contract, "a long, b long"))
    seen = None
    for _ in range(rounds):
        # every node to the root of its root, then the roots that a node has are joined by their smallest;
        # stored, as an aggregation right below the join would keep AQE from splitting a frequent root
        above = stored(now.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "b"))
        jumped = now.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b"))
        after = stored(jumped.repartition("a").sortWithinPartitions("a").mapInArrow(_contract, "a long, b long"))
        discard(now, above)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
