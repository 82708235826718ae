"""Hard negatives of anchor vectors, by blocked dense products.

Components are whole numbers, so that a product of float64 matrices is exact
while its bound stays below 2**53; rows beyond that are multiplied as whole
numbers of any size.  Anchors are dealt into blocks and rows into blocks, and
each anchor block meets each block of rows in a cell of its own, whose two
sides travel together.  A cell keeps the best few rows of each anchor; these
lists merge over cells by a ranked window.  The first pass finds each anchor's
positives, the second the negatives within each positive's window of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut

ANCHORS, ROWS = 8192, 8192  #: anchors and rows of a cell, about
COLUMNS, WIDE_COLUMNS = 512, 64  #: rows multiplied at once, and rows of which some are beyond float64
TASKS = 100_000  #: tasks at most; beyond, a task has several cells
EXACT = float(2**53)
POINT = "row long, vec_id long, label long, dim int, x binary"


def _pack(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Whole components of each vector, in as few bytes as hold them all."""
    for b in batches:
        e = b.column("embedding")
        values, off = e.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(e.value_lengths().to_numpy(zero_copy_only=False))])
        whole = np.floor(scale * values)
        out = []
        for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            v = whole[i:j]
            most = np.abs(v).max(initial=0)
            out.append(v.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("label"), pa.array(np.diff(off), pa.int32()), pa.array(out, pa.binary())], ["row", "vec_id", "label", "dim", "x"])


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.zeros((len(raw), dim))
    sizes = np.array([len(r) for r in raw])
    for size, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
        at = np.flatnonzero(sizes == size * dim) if dim else []
        if len(at):
            x[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), dim)
    return x


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Anchors and rows of each cell and dimension; they come sorted, a cell's anchors first."""
    held: list[pa.RecordBatch] = []

    def split(b: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        n = int(b.num_rows - np.asarray(b.column("other").cast(pa.int8())).sum())
        return b.slice(0, n), b.slice(n)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
        cell, dim = np.asarray(t.column("cell")), np.asarray(t.column("dim"))
        at = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (dim[1:] != dim[:-1])]))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield split(t.slice(i, j - i))
        held = [t.slice(at[-1])]
    if held:
        yield split(held[0])


def _products(a: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Inner products of all anchors with some rows at a time, and the place of the first of them: as doubles where that is exact, else as whole numbers."""
    dim = max(1, a.shape[1])
    big_a, big_c = np.abs(a).max(1, initial=0), np.abs(c).max(1, initial=0)
    if dim * big_a.max(initial=0) * big_c.max(initial=0) < EXACT:
        for i in range(0, len(c), COLUMNS):
            yield i, a @ c[i : i + COLUMNS].T
        return
    most = np.sqrt(EXACT / dim) / 2
    whole = np.frompyfunc(int, 1, 1)
    for i in range(0, len(c), WIDE_COLUMNS):
        part = c[i : i + WIDE_COLUMNS]
        s = np.empty((len(a), len(part)), object)
        fit_a, fit_c = big_a < most, big_c[i : i + WIDE_COLUMNS] < most
        s[np.ix_(fit_a, fit_c)] = (a[fit_a] @ part[fit_c].T).astype(np.int64).astype(object)
        for rows, columns in ((~fit_a, fit_c | True), (fit_a, ~fit_c)):
            if rows.any() and columns.any():
                s[np.ix_(rows, columns)] = whole(a[rows]).astype(object) @ whole(part[columns]).astype(object).T
        yield i, s


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``k`` greatest of each line of ``s``, which is spent; of equal ones the first."""
    line, at, value = np.arange(len(s)), [], []
    for _ in range(min(k, s.shape[1])):
        i = s.argmax(1)
        at.append(i)
        value.append(s[line, i])
        s[line, i] = -np.inf
    return np.stack(at, 1), np.stack(value, 1)


def _merge(best: tuple | None, at: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest of what was found before and now; the earlier of equal ones."""
    if best is None:
        return at, value
    at, value = np.concatenate([best[0], at], 1), np.concatenate([best[1], value], 1)
    order = np.argsort(-value, 1, kind="stable")[:, :k]
    return np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)


def _long(values: list) -> pa.Array:
    return pa.array([max(-(2**63), min(2**63 - 1, int(v))) for v in values], pa.int64())


def _sides(anchors: pa.RecordBatch, rows: pa.RecordBatch) -> tuple:
    dim = anchors.column("dim")[0].as_py()
    side = lambda b: (np.asarray(b.column("row")), np.asarray(b.column("label")), _matrix(b.column("x").to_pylist(), dim))
    return *side(anchors), *side(rows), np.asarray(rows.column("vec_id"))


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each cell and anchor the ``k`` best other rows of its label."""
    for anchors, rows in _cells(batches):
        if not anchors.num_rows or not rows.num_rows:
            continue
        row, label, a, other, other_label, c, ids = _sides(anchors, rows)
        best = None
        for i, s in _products(a, c):
            j = slice(i, i + s.shape[1])
            s[(label[:, None] != other_label[j]) | (row[:, None] == other[j])] = -np.inf
            at, value = _best(s, k)
            best = _merge(best, at + i, value, k)
        at, value = best
        line, place = np.nonzero(value != -np.inf)
        at = at[line, place]
        yield pa.RecordBatch.from_arrays([pa.array(row[line]), pa.array(ids[at]), pa.array(other[at]), _long(value[line, place].tolist())], ["row", "vec_id", "other_row", "score"])


def _negatives(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Of each cell, anchor and positive the ``k`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's."""
    for anchors, rows in _cells(batches):
        if not anchors.num_rows or not rows.num_rows:
            continue
        row, label, a, other, other_label, c, ids = _sides(anchors, rows)
        scores = anchors.column("scores").to_pylist()
        count = np.array([len(x) for x in scores])
        bounds = []
        for r in range(int(count.max(initial=0))):
            own = np.flatnonzero(count > r)
            p = [scores[i][r] for i in own]
            # low * p <= 100 * s <= high * p, for whole s
            bounds.append((own, np.array([-(-low * x // 100) for x in p], object), np.array([high * x // 100 for x in p], object)))
        found: list[tuple | None] = [None] * len(bounds)
        for i, s in _products(a, c):
            s[label[:, None] == other_label[i : i + s.shape[1]]] = -np.inf
            for r, (own, least, most) in enumerate(bounds):
                kind = s.dtype if s.dtype == object else float
                t = s[own]
                t[(t < least.astype(kind)[:, None]) | (t > most.astype(kind)[:, None])] = -np.inf
                at, value = _best(t, k)
                found[r] = _merge(found[r], at + i, value, k)
        for r, (own, _, _) in enumerate(bounds):
            at, value = found[r]
            line, place = np.nonzero(value != -np.inf)
            at = at[line, place]
            yield pa.RecordBatch.from_arrays([pa.array(row[own[line]]), pa.array(np.full(len(line), r), pa.int32()), pa.array(ids[at]), pa.array(other[at]), _long(value[line, place].tolist())], ["row", "place", "vec_id", "other_row", "score"])


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """Hard negatives of the rows of ``vectors(vec_id, label, embedding)`` whose vec_id is divisible by ``every``.

    A row's score is the inner product of its components, floor(``scale`` * x),
    with the anchor's; greater scores come first, then smaller vec_ids.  An
    anchor's positives are its first ``positives`` other rows of the same label;
    for each, the first ``negatives`` rows of other labels come back that score
    ``low`` to ``high`` percent of it: ``anchor_id``, ``positive_id``, ``rank``
    (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null vec_id or label, a null vector, or a component that is null
    or not finite (scaled or not) take no part.  Zero and empty vectors do, and
    score 0; only vectors of the same dimension meet.  Rows that repeat an id, or
    a whole row, are rows of their own: each anchor row has its own results, and
    copies of it are other rows of its label.  Scores are exact, and cut to the
    range of a long where they come back.  Other columns are left out; of an
    empty table there are no rows.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf")))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit).withColumn("row", F.monotonically_increasing_id())
    points = cut(kept.select("row", "vec_id", "label", "embedding").mapInArrow(partial(_pack, scale=scale), POINT))
    anchors = points.where(F.col("vec_id") % every == 0)
    asked, total = points.agg(F.count_if(F.col("vec_id") % every == 0), F.count("*")).first()
    across, down = max(1, -(-asked // ANCHORS)), max(1, -(-total // ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    share = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    rows = points.withColumn("other", F.lit(True)).withColumn("part", each(across)).withColumn("cell", F.col("part") * down + share(down)).drop("part")

    def met(anchors: DataFrame) -> DataFrame:
        """Both sides of all cells, a cell's in one task."""
        dealt = anchors.withColumn("other", F.lit(False)).withColumn("part", each(down)).withColumn("cell", share(across) * down + F.col("part")).drop("part")
        both = dealt.unionByName(rows, allowMissingColumns=True)
        tasks = min(TASKS, across * down)
        both = both.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int"))
        return both.sortWithinPartitions("cell", "dim", "other", "vec_id", "row")

    with arrow_rows(spark, 2 * ROWS):
        near = met(anchors).mapInArrow(partial(_positives, k=positives), "row long, vec_id long, other_row long, score long")
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other_row")
        near = cut(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))
        lists = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("found"))
        asking = anchors.join(lists.select("row", F.transform("found", lambda x: x["score"]).alias("scores")), "row")
        far = met(asking).mapInArrow(partial(_negatives, k=negatives, low=low, high=high), "row long, place int, vec_id long, other_row long, score long")
        order = Window.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id", "other_row")
        far = cut(far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives))
    pairs = near.select("row", (F.col("place") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(pairs, ["row", "place"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
