"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned to their principal axes, so that the leading
dimensions spread most, and fall into grid cells as wide as the threshold's
distance.  Sorted by their cells, first dimension first, two vectors within
that distance are never further apart than neighbouring cells in any
dimension.  Each vector goes to its slab on the first axis and, as a visitor,
to the next one; slabs are dealt into runs of bounded length of their own and
of visiting vectors, and each pair of runs is joined recursively: intervals
that are more than a cell apart in some dimension, or whose boxes are too far
apart, are skipped, and small ones are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, components, cut, small

RUN = 4096  #: vectors of a run, about
LEAF, GRID = 128, 8  #: vectors of intervals that are compared exactly; dimensions of the grid


def _unit(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch whose vector is fit for use, and these vectors in double precision, of length 1."""
    lists = b.column("embedding")
    good, out = [], []
    for i, v in enumerate(lists.to_pylist()):
        if v and None not in v:
            x = np.array(v, float)
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(x).max()
            if np.isfinite(x).all() and top > 0:
                x = x / top
                good.append(i)
                out.append(x / np.sqrt(x @ x))
    return np.array(good, int), out


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            yield part, *_unit(part)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, good, x in _stack(batches):
        units: list[bytes | None] = [None] * b.num_rows
        for i, v in zip(good.tolist(), x, strict=True):
            units[i] = v.tobytes()
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(units, pa.binary())], ["vec_id", "unit"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sum and sum of outer products of the vectors of each dimension."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        units = b.column("unit").to_pylist()
        for d in {len(u) for u in units}:
            x = np.frombuffer(b"".join(u for u in units if len(u) == d)).reshape(-1, d // 8)
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            total[d // 8] = total.get(d // 8, 0) + x.T @ x
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["dim", "m"])


def _axes(units: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and leading principal axes for each dimension that occurs; a matrix for each comes to the driver from each of a few tasks."""
    rows = units.mapInArrow(_moments, "dim int, m binary").repartition(4).mapInArrow(_add, "dim int, m binary").collect()
    total: dict[int, np.ndarray] = {}
    for dim, m in rows:
        total[dim] = total.get(dim, 0) + np.frombuffer(m).reshape(dim + 1, dim + 1)
    out = {}
    for dim, m in total.items():
        mean = m[0, 1:] / m[0, 0]
        _, v = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[dim] = mean, v[:, ::-1][:, :GRID]
    return out


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for d, m in zip(b.column("dim").to_pylist(), b.column("m").to_pylist(), strict=True):
            total[d] = total.get(d, 0) + np.frombuffer(m)
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["dim", "m"])


def _cells(batches: Iterator[pa.RecordBatch], axes: dict, eps: float) -> Iterator[pa.RecordBatch]:
    """Each vector's slab (its dimension and first cell), the cells of the next two axes, a sort key of all, and its place on the axes."""
    eps = max(eps, 2.0**-13)  # cells may be wider than the distance, and so no number of them overflows
    for b in batches:
        units = b.column("unit").to_pylist()
        slab, second, third, order, at = [], [], [], [], []
        for u in units:
            x = np.frombuffer(u)
            mean, v = axes[len(x)]
            place = (x - mean) @ v
            c = np.floor(place / eps).astype(np.int64)
            at.append(np.concatenate([place, np.zeros(GRID - len(place))]).tolist())
            slab.append(len(x) << 32 | int(c[0] + (1 << 16)))
            second.append(int(c[1]) if len(c) > 1 else 0)
            third.append(int(c[2]) if len(c) > 2 else 0)
            order.append((c + (1 << 15)).astype(">u2").tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in (slab, second, third)), pa.array(order, pa.binary()), pa.array(at, pa.list_(pa.float64()))], [*b.schema.names, "slab", "second", "third", "cells", "spot"])


def _join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps: float, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places of two sorted sequences (or of one with itself), by recursion over halves."""
    a32, b32 = a.astype(np.float32), b.astype(np.float32)  # to find candidates; doubles decide
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        gap = np.maximum(0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        if gap @ gap > eps * eps * (1 + 1e-9):
            continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a32[i:j] @ b32[k:m].T >= least - 1e-4)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            near = np.einsum("ij,ij->i", a[x], b[y]) >= least
            x, y = x[near], y[near]
            if len(x):
                yield x, y
            continue
        h, q = (i + j) // 2 if j - i > LEAF else j, (k + m) // 2 if m - k > LEAF else m
        for s, t in ((i, h), (h, j)):
            for u, w in ((k, q), (q, m)):
                if s < t and u < w and not (same and s >= w):
                    stack.append((s, t, u, w))


def _match(batches: Iterator[pa.RecordBatch], axes: dict, eps: float, least: float) -> Iterator[pa.RecordBatch]:
    """Links within each pair of runs: counts by vector, and the edges of a forest."""
    held: pa.Table | None = None

    def tables() -> Iterator[pa.Table]:
        nonlocal held
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            key = held["pair"].to_pylist()
            last = key[-1]
            at = next(i for i in range(len(key) - 1, -2, -1) if i < 0 or key[i] != last) + 1
            if at:
                yield held.slice(0, at)
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield held

    for t in tables():
        key = np.array(t["pair"].to_pylist())
        for at in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
            part = t.slice(at[0], len(at))
            ids, weight, side = part["id"].to_numpy(), part["copies"].to_numpy(), part["side"].to_numpy()
            x = np.frombuffer(b"".join(part["unit"].to_pylist())).reshape(len(ids), -1)
            cells = np.array(part["cells"].to_pylist(), object)
            order = np.lexsort((cells, side))
            ids, weight, side, x = ids[order], weight[order], side[order], x[order]
            mean, v = axes[x.shape[1]]
            p = (x - mean) @ v
            split = int((side == 0).sum())
            same = split == len(ids)
            a, b = (slice(0, split), slice(0, split)) if same else (slice(0, split), slice(split, None))
            links, label, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
            for i, j in _join(x[a], x[b], p[a], p[b], eps, least, same):
                j = j + (0 if same else split)
                links += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
                label = _joined(label, i, j, edges)
            on = np.flatnonzero(links)
            none = pa.nulls(len(on), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on]), none], ["id", "links", "other"])
            if edges:
                m, n = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[m]), pa.array(np.zeros(len(m), np.int64)), pa.array(ids[n])], ["id", "links", "other"])


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """Labels of components after the links (i, j); those that join two components are appended to ``edges``.  A pair of labels is looked at once."""
    on = np.flatnonzero(label[i] != label[j])
    if not len(on):
        return label
    i, j = i[on], j[on]
    pairs = np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])], 1)
    pairs, first = np.unique(pairs, axis=0, return_index=True)
    names, place = np.unique(pairs, return_inverse=True)
    forest = Forest(len(names))
    for (p, q), k in zip(place.reshape(-1, 2).tolist(), first.tolist(), strict=True):
        if forest.join(p, q):
            edges.append((int(i[k]), int(j[k])))
    new = np.arange(len(label))
    new[names] = names[[forest.find(k) for k in range(len(names))]]
    return new[label]


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Near-duplicate classes of ``vectors(vec_id, embedding)``: one row per vector with
    ``vec_id``, ``n_links`` (other vectors of cosine ``threshold`` or more),
    ``component_id`` (smallest vec_id reachable over links) and ``kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and so do those of different dimensions.  Directions
    that are equal to the last bit are compared once, and count as often as
    they come; their copies link with each other.  Rows that repeat a vec_id
    with another vector are vectors of their own; of an empty table there are
    no rows.  Other columns are left out.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = cut(vectors.mapInArrow(_units, "vec_id long, unit binary"))
    classes = units.where("unit IS NOT NULL AND vec_id IS NOT NULL").withColumn("key", F.sha2("unit", 256)).select("vec_id", "key", "unit")
    # a kind is one direction: its vector, its smallest vec_id, and a number of its own
    kinds = cut(classes.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    kinds = cut(kinds.withColumn("id", F.monotonically_increasing_id()))
    reps = kinds.select("id", "copies", "unit")
    axes = _axes(reps.select("unit"))
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-12
    cells = cut(reps.mapInArrow(partial(_cells, axes=axes, eps=eps), "id long, copies long, unit binary, slab long, second long, third long, cells binary, spot array<double>"))
    # runs of a slab, in the order of the cells on the next two axes, which a unit sphere has few of; hot cells are split
    sizes = cells.groupBy("slab", "second", "third").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("slab").orderBy("second", "third").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("at", F.coalesce(before, F.lit(0)))
    inside = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("k") / RUN)))
    runs = cells.join(sizes, ["slab", "second", "third"]).withColumn("run", F.floor((F.col("at") + inside * RUN) / RUN))
    runs = cut(runs.select("id", "copies", "unit", "slab", "cells", "spot", "run"))
    # boxes of runs on all axes: two that are further apart than the distance are no pair
    corner = lambda f: F.array(*(f(F.col("spot")[k]) for k in range(GRID)))
    boxes = cut(runs.groupBy("slab", "run").agg(corner(F.min).alias("lo"), corner(F.max).alias("hi")))
    runs = runs.drop("spot")
    own = boxes.toDF("slab", "r0", "lo0", "hi0")
    gaps = F.zip_with(F.zip_with("lo", "hi0", lambda x, y: x - y), F.zip_with("lo0", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    close = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps * (1 + 1e-9)
    same_slab = own.join(boxes.withColumnRenamed("run", "r1"), "slab").where(F.col("r0") <= F.col("r1")).where(close).select("slab", "r0", F.col("slab").alias("slab1"), "r1")
    next_slab = own.join(boxes.select((F.col("slab") - 1).alias("slab"), F.col("slab").alias("slab1"), F.col("run").alias("r1"), "lo", "hi"), "slab").where(close).select("slab", "r0", "slab1", "r1")
    pairs = same_slab.unionByName(next_slab).withColumn("pair", F.concat_ws(":", "slab", "r0", "slab1", "r1"))
    left = runs.join(pairs.select("slab", F.col("r0").alias("run"), "pair"), ["slab", "run"]).withColumn("side", F.lit(0))
    right = runs.join(pairs.where("slab != slab1 OR r0 != r1").select(F.col("slab1").alias("slab"), F.col("r1").alias("run"), "pair"), ["slab", "run"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("pair", "side", "id", "copies", "cells", "unit").repartition("pair").sortWithinPartitions("pair")
    found = cut(both.mapInArrow(partial(_match, axes=axes, eps=eps, least=threshold), "id long, links long, other long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = cut(components(found.where("other IS NOT NULL"), "id", "other"))
    kinds = kinds.drop("unit").join(links, "id", "left").join(comps.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    kinds = cut(kinds)
    kinds = kinds.join(small(cut(kinds.groupBy("c").agg(F.min("first").alias("component_id")))), "c")
    kinds = kinds.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = classes.select("vec_id", "key").join(kinds, "key").select("vec_id", "n_links", "component_id")
    alone = units.where("unit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
