"""Approximate nearest neighbours by a navigable small-world graph for each shard.

Vectors are dealt into the cells of at most ``CELLS`` centres, fitted on a
bounded sample, and cells of more than ``SHARD`` vectors into shards of about
that length by a hash.  Each shard builds a hierarchical graph, whose levels are
stored as flat arrays of neighbours.  A query searches its own cell's shards
first; the distance of its k-th find there tells which other cells can hold a
nearer vector (by the plane between two centres, so that no cell is left out
that can), and it searches theirs next; the shards' results are merged.
Where vectors cluster, few cells are left; where they don't, all are searched.
Copies of a vector stand for one node with the smallest ids, as many as an
answer can hold, since no other copy can be among the nearest.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD = 4096  #: vectors of a shard, about
CELLS, SAMPLE = 256, 8192  #: centres at most, and vectors that they are fitted on, about
LINKS, BUILD, SEARCH = 16, 64, 64  #: neighbours of a node (twice as many on level 0); candidates when building and searching


class Graph:
    """A hierarchical navigable small-world graph: ``levels[l]`` has a row of neighbours for each node, -1 where there is none."""

    def __init__(self, x: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 1):
        n = len(x)
        self.x, self.norm = x.astype(np.float32), (x.astype(np.float32) ** 2).sum(1)
        height = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 12)
        self.levels = [np.full((n, 2 * links if level == 0 else links), -1, np.int32) for level in range(int(height.max(initial=0)) + 1)]
        self.seen, self.stamp = np.zeros(n, np.int64), 0
        self.entry, self.top = 0, int(height[0]) if n else 0
        for i in range(1, n):
            at = self.entry
            for level in range(self.top, height[i], -1):
                at = self._descend(x[i], at, level)
            near = [(self._far(x[i], np.array([at]))[0], at)]
            for level in range(min(self.top, height[i]), -1, -1):
                near = self._search(x[i], [a for _, a in near], level, build)
                self._connect(i, near, level, links)
            if height[i] > self.top:
                self.entry, self.top = i, int(height[i])

    @classmethod
    def stored(cls, x: np.ndarray, levels: list[np.ndarray], entry: int) -> "Graph":
        """A graph from its arrays."""
        g = cls.__new__(cls)
        g.x, g.norm, g.levels = x.astype(np.float32), (x.astype(np.float32) ** 2).sum(1), levels
        g.seen, g.stamp, g.entry, g.top = np.zeros(len(x), np.int64), 0, entry, len(levels) - 1
        return g

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return self.norm[nodes] - 2 * (self.x[nodes] @ q.astype(np.float32))

    def _descend(self, q: np.ndarray, at: int, level: int) -> int:
        best = self._far(q, np.array([at]))[0]
        while True:
            near = self.levels[level][at]
            near = near[near >= 0]
            if not len(near):
                return at
            d = self._far(q, near)
            k = int(d.argmin())
            if d[k] >= best:
                return at
            best, at = d[k], int(near[k])

    def _search(self, q: np.ndarray, start: list[int], level: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found, nearest first."""
        self.stamp += 1
        start = list(dict.fromkeys(start))
        self.seen[start] = self.stamp
        todo = list(zip(self._far(q, np.array(start)).tolist(), start, strict=True))
        best = [(-d, a) for d, a in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        table = self.levels[level]
        while todo:
            d, at = heapq.heappop(todo)
            if len(best) == width and d > -best[0][0]:
                break
            near = table[at]
            near = near[near >= 0]
            near = near[self.seen[near] != self.stamp]
            if not len(near):
                continue
            self.seen[near] = self.stamp
            far = self._far(q, near)
            if len(best) == width:
                on = far < -best[0][0]
                near, far = near[on], far[on]
            for f, a in zip(far.tolist(), near.tolist(), strict=True):
                if len(best) < width or f < -best[0][0]:
                    heapq.heappush(todo, (f, a))
                    heapq.heappush(best, (-f, a))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, a) for d, a in best)

    def _choose(self, centre: int, nodes: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that are nearer to the centre than to one already chosen; then the nearest others."""
        between = self.norm[nodes][:, None] + self.norm[nodes] - 2 * (self.x[nodes] @ self.x[nodes].T)
        chosen, rest = [], []
        for k in range(len(nodes)):
            if len(chosen) == most:
                break
            (chosen if not chosen or between[k, chosen].min() > far[k] + self.norm[centre] else rest).append(k)
        return nodes[(chosen + rest)[:most]]

    def _connect(self, i: int, near: list[tuple[float, int]], level: int, links: int) -> None:
        table = self.levels[level]
        nodes, far = np.array([a for _, a in near]), np.array([d for d, _ in near])
        own = self._choose(i, nodes, far, links)
        table[i, : len(own)] = own
        for a in own.tolist():
            row = table[a]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = i
            else:
                nodes = np.append(row, i)
                far = self._far(self.x[a], nodes)
                order = np.argsort(far, kind="stable")
                kept = self._choose(a, nodes[order], far[order], table.shape[1])
                row[:] = -1
                row[: len(kept)] = kept

    def nearest(self, q: np.ndarray, width: int = SEARCH) -> list[int]:
        at = self.entry
        for level in range(self.top, 0, -1):
            at = self._descend(q, at, level)
        return [a for _, a in self._search(q, [at], 0, width)]


def _good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors fit for use, as bytes of doubles."""
    for b in batches:
        ids, out = [], []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
            if i is not None and v and None not in v:
                x = np.array(v, float)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "x"])


GRAPHS = "shard int, dim int, x binary, ids binary, counts binary, levels array<binary>, entry int"


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of rows with the same ``key``."""
    rows = (r for b in batches for r in b.to_pylist())
    for k, run in itertools.groupby(rows, itemgetter(key)):
        yield k, list(run)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A graph for each shard and dimension; a shard's points come in a run."""
    names = ["shard", "dim", "x", "ids", "counts", "levels", "entry"]
    for shard, points in _groups(batches, "shard"):
        points.sort(key=lambda r: (len(r["x"]), r["ids"][0]))
        for dim, run in itertools.groupby(points, lambda r: len(r["x"]) // 8):
            own = list(run)
            x = np.frombuffer(b"".join(r["x"] for r in own)).reshape(len(own), -1)
            g = Graph(x - x.mean(0))
            ids, counts = np.concatenate([np.array(r["ids"], np.int64) for r in own]), np.array([len(r["ids"]) for r in own], np.int32)
            levels = pa.array([[level.tobytes() for level in g.levels[: g.top + 1]]], pa.list_(pa.binary()))
            one = [pa.array([v], t) for v, t in ((shard, pa.int32()), (dim, pa.int32()), (x.tobytes(), pa.binary()), (ids.tobytes(), pa.binary()), (counts.tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*one, levels, pa.array([g.entry], pa.int32())], names)


def _search(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Nearest candidates of each shard for its queries, which come one by one after the shard's graphs."""
    shard, graphs, out = None, {}, []

    def found() -> pa.RecordBatch:
        q, v, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            if r["shard"] != shard:
                shard, graphs = r["shard"], {}
            if not r["query"]:
                x = np.frombuffer(r["x"]).reshape(-1, r["dim"])
                levels = [np.frombuffer(v, np.int32).reshape(len(x), -1) for v in r["levels"]]
                middle, counts = x.mean(0), np.frombuffer(r["counts"], np.int32)
                graphs[r["dim"]] = x, middle, Graph.stored(x - middle, levels, r["entry"]), np.frombuffer(r["ids"], np.int64), np.cumsum(counts) - counts, counts
            elif r["dim"] in graphs:
                x, middle, graph, ids, start, counts = graphs[r["dim"]]
                q, me = np.frombuffer(r["x"]), r["query_id"]
                nodes = graph.nearest(q - middle, max(width, k + 1))
                d = np.sqrt(((x[nodes] - q) ** 2).sum(1))
                best = sorted((s, int(v)) for s, n in zip(d.tolist(), nodes, strict=True) for v in ids[start[n] : start[n] + counts[n]] if v != me)[:k]
                out += [(me, v, s) for s, v in best]
                if len(out) > 10_000:
                    yield found()
                    out = []
    yield found()


def _fit(points: DataFrame, total: int, per_shard: int) -> dict[int, np.ndarray]:
    """Centres for each dimension, by a few rounds of Lloyd's on about ``SAMPLE`` vectors of the smallest hash."""
    share = min(1.0, SAMPLE / max(1, total))
    few = points.where(F.shiftrightunsigned(F.xxhash64("x"), 24) < int(share * (1 << 40))).limit(2 * SAMPLE).select("x").collect()
    out, rng = {}, np.random.default_rng(3)
    for dim, run in itertools.groupby(sorted((bytes(r[0]) for r in few), key=len), len):
        x = np.stack([np.frombuffer(v) for v in run])
        n = int(min(CELLS, max(1, round(len(x) / share / per_shard)), max(1, len(x) // 16)))
        c = x[rng.choice(len(x), n, replace=False)]
        for _ in range(8):
            near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(n)])
        out[dim // 8] = np.unique(c, axis=0)
    return out


def _home(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x - centres) ** 2).sum(1)


def _place(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each vector's cell: the number of its nearest centre, after those of lesser dimensions; vectors of a dimension without centre have one of their own."""
    first = dict(zip(sorted(centres), np.cumsum([0, *(len(centres[d]) for d in sorted(centres))]).tolist(), strict=False))
    for b in batches:
        cell = []
        for v in b.column("x").to_pylist():
            x = np.frombuffer(v)
            cell.append(first[len(x)] + int(_home(x, centres[len(x)]).argmin()) if len(x) in centres else -len(x))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])


def _others(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Cells other than a query's own that can hold a vector nearer than ``reach``."""
    first = dict(zip(sorted(centres), np.cumsum([0, *(len(centres[d]) for d in sorted(centres))]).tolist(), strict=False))
    for b in batches:
        query, cell, xs = [], [], []
        for r in b.to_pylist():
            x = np.frombuffer(r["x"])
            if len(x) not in centres:
                continue
            c = centres[len(x)]
            far, own = _home(x, c), r["cell"] - first[len(x)]
            apart = np.sqrt(((c - c[own]) ** 2).sum(1))
            bound = (far - far[own]) / np.maximum(2 * apart, 1e-300)
            for k in np.flatnonzero((bound <= r["reach"] * (1 + 1e-9)) & (np.arange(len(c)) != own)).tolist():
                query.append(r["query_id"])
                cell.append(first[len(x)] + k)
                xs.append(r["x"])
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(xs, pa.binary()), pa.array(cell, pa.int32())], ["query_id", "x", "cell"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH, per_shard: int = SHARD) -> DataFrame:
    """The ``k`` nearest of ``vectors(vec_id, embedding)`` found for each row of ``queries`` (of the same columns), by Euclidean distance.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (the
    distance in double precision); ties go to the smaller vec_id, and a row is
    no neighbour of its own id.  Vectors that are null, empty, zero, or hold
    null or non-finite components take no part; only vectors of the same
    dimension are compared.  Repeated rows of an id count once; of an id with
    several vectors, as of a query with several, the nearest pair counts.  Of
    empty tables there are no rows.
    """
    kind = "vec_id long, x binary"
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_good, kind)
    points = pick(vectors).distinct()
    points = points.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(f"place <= {k + 1}")
    points = cut(points.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    centres = _fit(points, points.count(), per_shard)
    placed = cut(points.mapInArrow(partial(_place, centres=centres), "x binary, ids array<long>, cell int"))
    # shards are numbered cell after cell; there are as many cells as centres and dimensions
    sizes = cut(placed.groupBy("cell").agg(F.ceil(F.count("*") / per_shard).cast("int").alias("parts")))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.broadcast(cut(sizes.withColumn("at", F.coalesce(F.sum("parts").over(order), F.lit(0)).cast("int"))))
    shards = sizes.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0] or 1
    shard = (F.col("at") + F.pmod(F.xxhash64("x"), F.col("parts"))).cast("int").alias("shard")
    dealt = placed.join(sizes, "cell").select(shard, "ids", "x")
    graphs = cut(dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_build, GRAPHS))
    asked = pick(queries).distinct().select(F.col("vec_id").alias("query_id"), "x")
    asked = cut(asked.mapInArrow(partial(_place, centres=centres), "query_id long, x binary, cell int"))

    def search(asked: DataFrame) -> DataFrame:
        each = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("parts") - 1))
        rows = asked.join(sizes, "cell").select(each.alias("shard"), F.lit(True).alias("query"), "query_id", (F.octet_length("x") / 8).cast("int").alias("dim"), "x")
        both = graphs.withColumns({"query": F.lit(False), "query_id": F.lit(None).cast("long")}).unionByName(rows, allowMissingColumns=True)
        return both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "query").mapInArrow(partial(_search, k=k, width=width), "query_id long, vec_id long, score double")

    near = cut(search(asked))
    nth = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nth = nth.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(f"rank = {k}")
    reach = asked.join(nth.select("query_id", F.col("score").alias("reach")), "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    rest = reach.mapInArrow(partial(_others, centres=centres), "query_id long, x binary, cell int")
    found = near.unionByName(search(rest)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
