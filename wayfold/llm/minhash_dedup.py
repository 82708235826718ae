"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct shingles (``width`` words in a row).  Each
of several independent trees starts with all documents; a node picks two
minwise positions by a hash of its path, and a document follows both, into the
child that its minimum there names.  Two sets of similarity s take the same
child with chance s, so unlike ones part quickly.  Small nodes are compared
exhaustively, in blocks of two parts each.  Large nodes are dealt into parts,
each with the node's pivot, and branch again while they hold documents of more
than one known component.  Where few documents are outside a node's largest
component, they join each part, which settles the node; nodes that branching
no longer parts are compared part by part, which leaves out no pair.
Sketches (minimum values) only choose candidates: the full shingle sets of a
block's candidates then meet in it, and confirm its links.

Null, empty and blank texts have empty sets and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, arrow_rows, compact, cut, mix, renewed, small, text_chunks, word_hashes

#: Whether a node's documents outside its largest component are so few that they join each block.
FEW = "others <= 32 AND 4 * others <= size"
POSITIONS = 64  #: minimum values in a sketch
LIMIT = 512  #: documents of a part of a node, all of which are compared
WHOLE = 4096  #: documents of a node up to which all its parts are compared with each other
TREES = 5
DEPTH = 6  #: rounds of branching, of two levels each, at most
ROWS = 1024  #: rows of texts, sketches or sets that Python gets at once
LEAST = 32  #: shared minima from which a pair is confirmed on full sets: 0.75 of 64 less 4.6 standard deviations

_rng = np.random.default_rng(7919)
_PLACE = (_rng.integers(1, 2**63, 16, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_PERMUTE = (_rng.integers(1, 2**63, POSITIONS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and n + 1 offsets."""
    h, off = word_hashes(texts)
    counts, n = np.diff(off), len(off) - 1
    doc = np.repeat(np.arange(n), counts)
    values, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(h) >= width:
        m = len(h) - width + 1
        s = np.zeros(m, np.uint64)
        for k in range(width):
            s += h[k : k + m] * _PLACE[k]
        whole = doc[:m] == doc[width - 1 :]
        values.append(mix(s[whole]))
        owner.append(doc[:m][whole])
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        s = np.full(len(short), k, np.uint64)
        for j in range(k):
            s += h[off[short] + j] * _PLACE[j]
        values.append(mix(s))
        owner.append(short)
    v, o = np.concatenate(values), np.concatenate(owner)
    if len(owner[-1]) or any(len(x) for x in owner[2:]):
        order = np.argsort(o, kind="stable")
        v, o = v[order], o[order]
    at = np.searchsorted(o, np.arange(n + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[keep], np.searchsorted(o[keep], np.arange(n + 1))


def _prints(v: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Size of each set, and two fingerprints of it."""
    n, full = np.diff(off), np.flatnonzero(np.diff(off))
    f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        f1[full] = np.add.reduceat(mix(v + np.uint64(1)), off[full])
        f2[full] = np.bitwise_xor.reduceat(mix(v + np.uint64(2)), off[full])
    return pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches):
        v, off = shingle_sets(b.column("text"), width)
        full = np.flatnonzero(np.diff(off))
        sig = np.zeros((len(off) - 1, POSITIONS), np.uint32)
        if len(full):
            for j in range(POSITIONS):
                sig[full, j] = np.minimum.reduceat((v * _PERMUTE[j]).view(np.uint32)[1::2], off[full])
        n, f1, f2 = _prints(v, off)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, f1, f2, pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches):
        v, off = shingle_sets(b.column("text"), width)
        n, f1, f2 = _prints(v, off)
        items = pa.array([v[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, f1, f2, items], ["first", "n_shingles", "f1", "f2", "items"])


def _branch(batches: Iterator[pa.RecordBatch], trees: tuple[int, ...], levels: int) -> Iterator[pa.RecordBatch]:
    """Two children of each (node, id, sig), and theirs, ``levels`` deep, with the node they come from; with ``trees``, of each tree's root for each (id, sig)."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.asarray(b.column("id"))
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, POSITIONS).astype(np.uint64)
        nodes = [np.full(len(ids), t + 1, np.uint64) for t in trees] or [np.asarray(b.column("node")).view(np.uint64)]
        rows, above = np.arange(len(ids)), nodes
        for _ in range(levels):
            below = []
            for node in nodes:
                x = mix(node + np.uint64(0x632BE59BD9B4E019))
                first = x % np.uint64(POSITIONS)
                second = (first + np.uint64(1) + (x >> np.uint64(32)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
                below += [mix(mix(node * np.uint64(0xD6E8FEB86659FD93) + place) + sig[rows, place.astype(np.int64)]) for place in (first, second)]
            nodes, above = below, [a for a in above for _ in range(2)]
        for node, parent in zip(nodes, above, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids), pa.array(parent.view(np.int64))], ["node", "id", "parent"])


def _whole_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of whole blocks, of about ``rows`` rows, with the places where blocks start; rows come sorted by (node, block)."""
    held: list[pa.RecordBatch] = []

    def ready(last: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        nonlocal held
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        node, block = np.asarray(b.column("node")), np.asarray(b.column("block"))
        at = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (block[1:] != block[:-1])]))
        if last:
            yield b, np.append(at, b.num_rows)
        elif len(at) > 1:
            yield b.slice(0, at[-1]), at
            held = [b.slice(at[-1])]
        else:
            held = [b]

    for b in batches:
        for i in range(0, b.num_rows, rows):
            held.append(b.slice(i, rows))
            if sum(h.num_rows for h in held) >= rows:
                yield from ready(False)
    if held:
        yield from ready(True)


def _candidates(sig: np.ndarray, comp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within each block that share enough minima and are of two components."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.diff(at)
    end = np.repeat(at[1:], size)
    place = np.arange(len(comp))
    for d in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(place[: len(comp) - d] + d < end[: len(comp) - d])
        i = i[comp[i] != comp[i + d]]
        if not len(i):
            continue
        # a quarter of the minima first: far pairs are the most
        i = i[(sig[i, :16] == sig[i + d, :16]).sum(1) >= 4]
        i = i[(sig[i] == sig[i + d]).sum(1) >= LEAST]
        left.append(i)
        right.append(i + d)
    return np.concatenate(left), np.concatenate(right)


def _sketches(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block that are candidates with another one."""
    for b, at in _whole_blocks(batches, 4096):
        i, j = _candidates(_sketches(b), np.asarray(b.column("comp")), at)
        yield b.take(pa.array(np.unique(np.concatenate([i, j])))).select(["node", "block", "id"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each block that hold on full sets: a forest over its components."""
    for b, at in _whole_blocks(batches, 1024):
        sig, comp, ids = _sketches(b), np.asarray(b.column("comp")), np.asarray(b.column("id"))
        raw = b.column("items")
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            i, j = _candidates(sig[lo:hi], comp[lo:hi], np.array([0, hi - lo]))
            if not len(i):
                continue
            sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(lo, hi)]
            both = _shared(sets, i, j)
            n = np.array([len(x) for x in sets])
            on = 100 * both >= percent * (n[i] + n[j] - both)
            left.append(lo + i[on])
            right.append(lo + j[on])
        i, j = np.concatenate(left), np.concatenate(right)
        groups = {c: k for k, c in enumerate(dict.fromkeys(np.concatenate([comp[i], comp[j]]).tolist()))}
        forest = Forest(len(groups))
        keep = np.array([forest.join(groups[p], groups[q]) for p, q in zip(comp[i].tolist(), comp[j].tolist(), strict=True)], bool)
        yield pa.RecordBatch.from_arrays([pa.array(ids[i[keep]]), pa.array(ids[j[keep]])], ["a", "b"])


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sorted sets: one by one, or for all at once as a product where most pairs are asked for."""
    m = len(sets)
    values = np.concatenate(sets)
    distinct, place, count = np.unique(values, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)
    if m * m * len(often) / 2.5e9 > 2.5e-5 * len(i):
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    column = np.full(len(distinct), -1)
    column[often] = np.arange(len(often))
    owner, column = np.repeat(np.arange(m), [len(x) for x in sets]), column[place]
    total = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for k in range(0, len(often), 2048):
        a, z = np.searchsorted(column, [k, k + 2048])
        x = np.zeros((m, min(2048, len(often) - k)), np.float32)
        x[owner[a:z], column[a:z] - k] = 1
        total += x @ x.T
    return np.round(total[i, j]).astype(np.int64)


def minhash_dedup(docs: DataFrame, width: int = 5, percent: int = 75, trees: int = TREES) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``: one row per document with
    ``doc_id``, ``n_shingles`` (set size), ``component_id`` (smallest doc_id
    reachable over links of ``percent`` similarity or more) and ``kept``
    (doc_id = component_id).

    Repeated rows give repeated rows; rows that repeat a doc_id with other texts
    are documents of their own.  Documents of a null doc_id come back with an
    empty component, and link with nothing.  Very long texts are read whole; of
    an empty table there are no rows.  Other columns are left out.
    """
    with arrow_rows(docs.sparkSession, ROWS):
        return _classes(docs, width, percent, trees)


def _classes(docs: DataFrame, width: int, percent: int, trees: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    sketches = compact(known.mapInArrow(partial(_sketch, width=width), "doc_id long, n_shingles long, f1 long, f2 long, sig binary"))
    filled = sketches.where("n_shingles > 0")
    prints = ["f1", "f2", "n_shingles"]
    # a class holds all documents of one set: its sketch, its smallest doc_id, and a number of its own
    classes = compact(filled.groupBy(prints).agg(F.min("doc_id").alias("first"), F.first("sig").alias("sig")))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    reps = classes.select("id", "sig")

    sets, comps = None, None

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("comp", F.col("id")) if comps is None else rows.join(comps.select(F.col("v").alias("id"), "c"), "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c")

    def opened(rows: DataFrame, least: int) -> DataFrame:
        """Rows of nodes of ``least`` or more documents and of more than one component, with the node's size, its largest component and how many documents are in others."""
        kinds = rows.groupBy("node", "comp").agg(F.count("*").alias("k"))
        sizes = kinds.groupBy("node").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("main"))
        sizes = sizes.where(f"size >= {least} AND size > main.k").select("node", "size", F.col("main.comp").alias("main"), (F.col("size") - F.col("main.k")).alias("others"))
        # cut, so that the join is of two plain shuffles: then adaptive execution splits the rows of a hot node, or sends the sizes to all
        return rows.join(cut(sizes), "node")

    def blocks(rows: DataFrame) -> DataFrame:
        """Rows with their block.  A node of up to ``WHOLE`` documents, or one that is to be compared in ``all``, has one for each pair of its parts; another one has its parts, each with the documents outside the node's largest component, where they are few, or with its pivot."""
        rows = rows.withColumn("n", F.ceil(F.col("size") / LIMIT)).withColumn("block", F.pmod(F.xxhash64("id", "node"), "n"))
        each = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
        each_pair = F.transform(each, lambda x: F.least("block", x) * F.col("n") + F.greatest("block", x))
        everywhere = F.when(F.expr(FEW), F.col("comp") != F.col("main")).otherwise(F.col("id") == F.col("main"))
        block = F.when(F.col("all") | (F.col("size") <= WHOLE), each_pair).when(everywhere, each).otherwise(F.array("block"))
        return rows.select("node", F.explode(block).alias("block"), "id", "comp")

    def settle(rows: DataFrame) -> None:
        """Compare the blocks of ``rows``, confirm the candidates, and renew the components."""
        nonlocal sets, comps
        dealt = blocks(rows).join(reps, "id").select("node", "block", "id", "comp", "sig")
        dealt = dealt.repartition("node", "block").sortWithinPartitions("node", "block", "id")
        suspects = compact(dealt.mapInArrow(_suspect, "node long, block long, id long"))
        ids = compact(suspects.select("id").distinct())
        if ids.isEmpty():
            return
        new = ids if sets is None else ids.join(sets.select("id"), "id", "left_anti")
        new = small(cut(new.join(classes.drop("sig"), "id")))
        texts = known.join(new.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
        made = texts.mapInArrow(partial(_sets, width=width), "first long, n_shingles long, f1 long, f2 long, items binary")
        more = compact(made.join(new, ["first", *prints]).select("id", "items").dropDuplicates(["id"]))
        sets = more if sets is None else sets.unionByName(more)
        full = labelled(suspects).join(reps.join(small(ids), "id", "left_semi"), "id").join(sets.join(small(ids), "id", "left_semi"), "id")
        full = full.select("node", "block", "id", "comp", "sig", "items").repartition("node", "block").sortWithinPartitions("node", "block", "id")
        comps = renewed(comps, full.mapInArrow(partial(_confirm, percent=percent), "a long, b long"))

    live = None
    for some in ((0,), tuple(range(1, trees))):
        rows = opened(labelled(reps.mapInArrow(partial(_branch, trees=some, levels=1), "node long, id long, parent long")).drop("parent"), 2)
        if live is not None:
            again = opened(labelled(live.select("node", "id")), LIMIT + 1)
            rows = rows.unionByName(again)
        rows = compact(rows)
        settle(rows.withColumn("all", F.lit(False)))
        live = rows.where(f"size > {WHOLE} AND NOT ({FEW})")
    for depth in range(DEPTH):
        live = compact(opened(labelled(live.select("node", "id")), WHOLE + 1))
        if live.isEmpty():
            break
        few, many = live.where(FEW), live.where(f"NOT ({FEW})")
        below = many.join(reps, "id").select("node", "id", "sig").mapInArrow(partial(_branch, trees=(), levels=2), "node long, id long, parent long").distinct()
        # branching goes on while it parts a node: where the large children hold as many rows as it has, they would only be the same pairs again
        parted = compact(opened(labelled(below), 2))
        kept = parted.where(f"size > {WHOLE} AND NOT ({FEW})").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("rows"))
        alike = many.groupBy("node").agg(F.first("size").alias("n")).join(kept, "node", "left")
        alike = cut(alike.where(F.lit(depth == DEPTH - 1) | (F.col("rows") >= F.col("n"))).select("node"))
        rows = parted.join(alike.select(F.col("node").alias("parent")), "parent", "left_anti").select(few.columns)
        rows = compact(rows.unionByName(few))
        stuck = many.join(alike, "node", "left_semi").select(few.columns)
        settle(rows.withColumn("all", F.lit(False)).unionByName(stuck.withColumn("all", F.lit(True))))
        live = rows.where(f"size > {WHOLE} AND NOT ({FEW})")

    kinds = classes.select(*prints, F.col("first").alias("component_id"))
    if comps is not None:
        whole = classes.drop("sig").join(comps.select(F.col("v").alias("id"), "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
        least = whole.groupBy("c").agg(F.min("first").alias("component_id"))
        kinds = whole.join(small(cut(least)), "c").select(*prints, "component_id")
    shared = filled.select("doc_id", "n_shingles", "f1", "f2").join(kinds, prints)
    alone = sketches.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "n_shingles", "component_id"]
    nulls = docs.where("doc_id IS NULL").mapInArrow(partial(_sketch, width=width), "doc_id long, n_shingles long, f1 long, f2 long, sig binary").withColumn("component_id", F.col("doc_id"))
    out = shared.select(cols).unionByName(alone.select(cols)).unionByName(nulls.select(cols))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
