"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors collapse to one class with a count.  Classes are rotated to principal
axes (fitted on a bounded sample; the fit only steers the pruning) and cut into
ranges of the first axis of at most BLOCK classes; a range that ties keep larger is
cut by hash.  Linked unit vectors differ by at most sqrt(2 - 2t) along any axis, so
only pairs of ranges that near each other meet, one task per pair; the driver knows
one row per range.  Inside, tiles accumulate the products of the leading axes, then
of twice as many, and so on; after each step the product of the suffix norms bounds
what is left of the cosine, and pairs that cannot reach the threshold stop.  The rest
is verified by the cosine of the original vectors.  All of it is in double precision;
float vectors travel as floats, which loses nothing.  A task reports links as counts per
class and a spanning forest, never as pairs.

Defined results: a vector that is null, empty, zero, or has null or non-finite
components links with nothing: no links, itself as component.  Vectors of different
length never link; very long ones come in smaller blocks.  A null vec_id keeps its row and names no component unless alone.
Repeated rows are vectors of their own and link.  Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.graph import components, local_labels
from lodeframe.llm.session import ready

THRESHOLD = 0.9
#: Classes in a range of the first axis, at most, and components of all of its vectors.
BLOCK, BLOCK_VALUES = 32_768, 1 << 21
#: Least classes in a range that is made smaller to keep all cores busy.
LEAST_BLOCK = 512
#: Vectors of a tile side, axes accumulated first, vectors the rotation is fitted on.
TILE = 1_024
LEADING = 16
SAMPLE = 20_000
#: Components that the sample holds at most, whatever the dimension.
SAMPLE_VALUES = 2_000_000
#: Largest table of blocks that is broadcast.
BROADCAST_ROWS = 200_000
_MARGIN = 1e-7


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray | None, threshold: float):
    """Links of unit vectors a with b (or within a): counts for a, counts for b, labels of a then b."""
    own = b is None
    b, weight_b = (a, weight_a) if own else (b, weight_b)
    ra, rb = a @ axes, b @ axes
    order_a, order_b = np.argsort(ra[:, 0], kind="stable"), np.argsort(rb[:, 0], kind="stable")
    # places where the accumulation is looked at, and what is left of each vector there
    dim = axes.shape[1]
    stops = [min(LEADING, dim)]
    while stops[-1] < dim:
        stops.append(min(2 * stops[-1], dim))
    tails_a, tails_b = ([np.sqrt(np.maximum((r[:, k:] ** 2).sum(axis=1), 0)) for k in stops] for r in (ra, rb))
    reach = sqrt(max(0.0, 2 - 2 * threshold)) + _MARGIN
    links_a, links_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    shift = 0 if own else len(a)
    label = np.arange(len(a) + (0 if own else len(b)))
    for i in range(0, len(a), TILE):
        x = order_a[i : i + TILE]
        for j in range(i if own else 0, len(b), TILE):
            y = order_b[j : j + TILE]
            if ra[x[0], 0] - rb[y[-1], 0] > reach or rb[y[0], 0] - ra[x[-1], 0] > reach:
                continue
            k = stops[0]
            sums = ra[x, :k] @ rb[y, :k].T
            p, q = np.nonzero(sums + np.outer(tails_a[0][x], tails_b[0][y]) >= threshold - _MARGIN)
            sums, p, q = sums[p, q], x[p], y[q]
            if own and i == j:
                once = p < q
                sums, p, q = sums[once], p[once], q[once]
            for at in range(0, len(p), 1 << 16):
                u, v, total = p[at : at + (1 << 16)], q[at : at + (1 << 16)], sums[at : at + (1 << 16)]
                for low, high, ta, tb in zip(stops, stops[1:], tails_a[1:], tails_b[1:]):
                    total = total + np.einsum("ij,ij->i", ra[u, low:high], rb[v, low:high])
                    live = total + ta[u] * tb[v] >= threshold - _MARGIN
                    u, v, total = u[live], v[live], total[live]
                near = np.einsum("ij,ij->i", a[u], b[v]) >= threshold
                u, v = u[near], v[near]
                links_a += np.bincount(u, weights=weight_b[v], minlength=len(a)).astype(np.int64)
                links_b += np.bincount(v, weights=weight_a[u], minlength=len(b)).astype(np.int64)
                fresh = label[u] != label[v + shift]
                if fresh.any():
                    merged = local_labels(len(label), np.concatenate([np.arange(len(label)), u[fresh]]), np.concatenate([label, v[fresh] + shift]))
                    label = merged
    return links_a, links_b, label


def _pair_task(axes_of: dict[int, np.ndarray], threshold: float):
    """Arrow function over rows (pair, side, class_id, n, vector) sorted by pair and side.

    Side 2 is a block compared within itself, 0 and 1 are two blocks.
    """

    def solve(side, ids, n, vectors):
        x = _unit(np.concatenate(vectors))
        left = side != 1
        axes = axes_of.get(x.shape[1])
        axes = np.eye(x.shape[1]) if axes is None else axes
        if side[0] == 2:
            la, lb, label = compare(x, None, axes, n, None, threshold)
            links = la + lb
        else:
            la, lb, label = compare(x[left], x[~left], axes, n[left], n[~left], threshold)
            links = np.concatenate([la, lb])
            ids = np.concatenate([ids[left], ids[~left]])
        told = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return ids[told], links[told], ids[label[told]]

    def run(batches):
        now, parts = None, []
        for batch in batches:
            if not len(batch):
                continue
            pair = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for a, b in zip(cuts, cuts[1:]):
                if now is not None and pair[a] != now and parts:
                    yield told(parts)
                    parts = []
                now = pair[a]
                part = batch.slice(a, b - a)
                parts.append((part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(4))))
        if parts:
            yield told(parts)

    def told(parts):
        got = solve(*(np.concatenate([p[i] for p in parts]) for i in range(3)), [p[3] for p in parts])
        return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in got], names=["class_id", "links", "to"])

    return run


def link_classes(classes: DataFrame, total: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """class_id, links, to over classes (class_id, n, dim, vector): partial link counts and forest edges.

    With b ranges there are up to b (b + 1) / 2 tasks: small tables get enough ranges for every core.
    """
    spark = classes.sparkSession
    widest = classes.agg(F.max("dim")).first()[0] or 1
    ranges_for_cores = ceil(2 * sqrt(spark.sparkContext.defaultParallelism))
    block = max(1, min(block, BLOCK_VALUES // widest, max(LEAST_BLOCK, ceil(total / ranges_for_cores))))
    size = max(256, min(SAMPLE, SAMPLE_VALUES // widest))
    sample = classes.select("dim", "vector").sample(min(1.0, size / max(1, total)), seed=7).limit(2 * size).collect()
    axes_of: dict[int, np.ndarray] = {}
    edges: list[tuple[int, int, float, float]] = []
    count = max(1, ceil(total / block))
    for dim in sorted({r["dim"] for r in sample}):
        x = _unit(np.array([r["vector"] for r in sample if r["dim"] == dim], dtype=np.float64))
        values, vectors = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(0), x.mean(0)))
        axes_of[dim] = np.ascontiguousarray(vectors[:, ::-1])
        marks = np.quantile(x @ axes_of[dim][:, 0], np.linspace(0, 1, count + 1)[1:-1]) if count > 1 else []
        borders = [-np.inf, *np.unique(marks).tolist(), np.inf]
        edges += [(dim, i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(borders, borders[1:]))]
    first = {d: a[:, 0].tolist() for d, a in axes_of.items()}

    def place(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            axis, lane = np.zeros(len(batch)), np.zeros(len(batch), dtype=np.int32)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                if int(d) in first:
                    axis[mine] = _unit(_matrix(batch.column(3).take(pa.array(mine)))) @ np.array(first[int(d)])
                    lane[mine] = np.searchsorted([hi for e, _, _, hi in edges if e == d][:-1], axis[mine], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(axis), pa.array(lane)], names=[*batch.schema.names, "axis", "lane"])

    placed = classes.select("class_id", "n", "dim", "vector").mapInArrow(place, f"class_id long, n long, dim int, vector {classes.schema['vector'].dataType.simpleString()}, axis double, lane int").checkpoint()
    ranges = placed.groupBy("dim", "lane").agg(F.count("*").alias("rows"), F.min("axis").alias("lo"), F.max("axis").alias("hi")).collect()
    ranges.sort(key=lambda r: (r["dim"], r["lane"]))
    blocks = [(r["dim"], r["lane"], s, ceil(r["rows"] / block), r["lo"], r["hi"]) for r in ranges for s in range(ceil(r["rows"] / block))]
    reach = sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    # ranges lie in order along the axis, so the blocks that a block may meet are a run of indices
    table, first_met, last_met = [], 0, [0] * len(blocks)
    for j, b in enumerate(blocks):
        while blocks[first_met][0] != b[0] or b[4] - blocks[first_met][5] > reach:
            first_met += 1
        table.append((*b[:4], j, first_met))
    last = len(blocks) - 1
    for i in range(len(blocks) - 1, -1, -1):
        while blocks[last][0] != blocks[i][0] or blocks[last][4] - blocks[i][5] > reach:
            last -= 1
        last_met[i] = last
    table = [(*t, end) for t, end in zip(table, last_met)]
    met = spark.createDataFrame(table, "dim int, lane int, salt long, salts long, at long, first long, last long")
    rows = placed.join(F.broadcast(met) if len(table) <= BROADCAST_ROWS else met, ["dim", "lane"]).filter(F.pmod(F.xxhash64("class_id"), F.col("salts")) == F.col("salt"))
    # side 2: the block within itself; 0 and 1: the earlier and the later of two blocks
    pairs = F.transform(
        F.sequence(F.col("first"), F.col("last")),
        lambda k: F.struct((F.least(k, F.col("at")) * len(table) + F.greatest(k, F.col("at"))).alias("pair"), F.when(k == F.col("at"), 2).when(k > F.col("at"), 0).otherwise(1).alias("side")),
    )
    rows = rows.select("class_id", "n", "vector", F.explode(pairs).alias("p")).select(F.col("p.pair").alias("pair"), F.col("p.side").alias("side"), "class_id", "n", "vector")
    rows = rows.select("pair", "side", "class_id", "n", "vector").repartition("pair").sortWithinPartitions("pair", "side")
    return rows.mapInArrow(_pair_task(axes_of, threshold), "class_id long, links long, to long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    ready(vectors.sparkSession)
    floats = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("embedding") if floats else F.col("embedding").cast("array<double>")
    fine = F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, vector).alias("vector"))
    grouped = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    classes = grouped.withColumn("class_id", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")).checkpoint()
    found = link_classes(classes, classes.count(), threshold).checkpoint()
    links = found.groupBy("class_id").agg(F.sum("links").alias("links")).checkpoint()
    reach = components(found.select(F.col("class_id").alias("a"), F.col("to").alias("b")))
    labelled = classes.join(links, "class_id", "left").join(reach.withColumnRenamed("node", "class_id"), "class_id", "left")
    labelled = labelled.select("class_id", "vector", "least_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component")).checkpoint()
    # checkpointed, so that AQE can split a large component and a frequent vector in the joins
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id")).checkpoint()
    named = labelled.join(least, "component").select("vector", "n_links", "component_id").checkpoint()
    out = rows.join(named, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
