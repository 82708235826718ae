"""Best-fit packing of tokenised documents into sequences of bounded length.

Lengths alone travel.  Each partition packs its pieces by best-fit
decreasing.  A lower bound from dual feasible functions certifies the bin
count where it is met: such a partition hands on its emptiest bin alone.  One
that has a gap hands on its emptiest bins, with an eighth of the pieces that a
partition may hold; they meet those of seven other partitions and are packed
anew.  The rounds end with one partition, which is as small as any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, cut, text_chunks

CAPACITY = 2048
#: Pieces that the first partitions hold on the average, and partitions that meet in one in a round.
PIECES, FAN_IN = 20_000, 8
_ENCODERS: dict[str, object] = {}


def encoder(model: str):
    """Byte-level BPE from a ``tokenizers`` file, once for each worker.

    The file's pieces, merges and added tokens go into the quicker of the two
    public encoders; both give the same ids, added tokens in a text included.
    """
    if model not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(model), encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # letters that stand for bytes: printable ones for themselves, the others in order from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letter[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        _ENCODERS[model] = tiktoken.Encoding(model, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[model]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], model: str, end: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = partial(encoder(model).encode, allowed_special="all")
    for b in text_chunks(batches):
        out = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), end], np.uint32)
            at = len(ids) % capacity or capacity
            cuts = [0, *range(at, len(ids) + 1, capacity)]
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                out.append((doc, k, i, j - i, crc32_of(ids[i:j]), ids[i:j].tobytes() if with_ids else None))
        doc, piece, start, length, crc, raw = zip(*out, strict=True)
        arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(raw, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def token_pieces(docs: DataFrame, model: str = "byte_bpe_50k.json", end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of ``docs(doc_id, text)``, each document closed by ``end``.

    Null text counts as empty: one piece, of ``end`` alone.  Only documents
    longer than ``capacity`` are cut; then every piece but the first is full.
    Strings of the file's added tokens give these tokens, as ``tokenizers`` has it.
    Very long texts are encoded whole; an empty table has no pieces.  With ``with_ids`` a column
    ``ids`` has the little-endian unsigned 32-bit ids.  Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kernel = partial(_pieces, model=model, end=end, capacity=capacity, with_ids=with_ids)
    return docs.mapInArrow(kernel, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item by best-fit decreasing: the fullest open bin that still has room."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, n = 0, 0  # bit r of have: some bin has room for r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = have >> size
        if room:
            r = size + (room & -room).bit_length() - 1
            k = open_bins[r].pop()
            if not open_bins[r]:
                have &= ~(1 << r)
        else:
            r, k, n = capacity, n, n + 1
        bins[i] = k
        if r > size:
            open_bins[r - size].append(k)
            have |= 1 << (r - size)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    u(k): x -> x where (k + 1) x / capacity is whole, else floor((k + 1) x / capacity) capacity / k.
    v(e): x -> capacity above capacity - e, x from e on, 0 below e.
    """
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 21):
        y = (k + 1) * x
        best = max(best, -(-int(np.where(y % capacity == 0, k * x, y // capacity * capacity).sum()) // (k * capacity)))
    for e in np.unique(np.minimum(x, capacity - x)[(x <= capacity) & (np.minimum(x, capacity - x) > 0)]):
        best = max(best, -(-int(np.where(x > capacity - e, capacity, np.where(x >= e, x, 0)).sum()) // capacity))
    return best


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, hand_on: int) -> Iterator[pa.RecordBatch]:
    """Pack each group of a partition.  Rows of the bins that are handed on, with ``hand_on`` pieces or little more, get no sequence."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    part = t["part"].to_numpy()
    for p in np.unique(part):
        own = t.filter(pa.array(part == p)).sort_by([("length", "descending"), ("copy", "ascending")])
        x, copies = own["length"].to_numpy(), own["copy"].to_numpy()
        bins = best_fit(x, capacity)
        used = np.bincount(bins, x).astype(np.int64)
        keep = np.ones(len(used), bool)
        if hand_on:
            emptiest = np.argsort(used, kind="stable")
            pieces = np.cumsum(np.bincount(bins)[emptiest])
            most = int(np.searchsorted(pieces, hand_on, "right")) if len(used) > lower_bound(x, capacity) else 1
            keep[emptiest[: max(1, most)]] = False
            keep |= used == capacity
        order = np.argsort(bins, kind="stable")
        at = np.cumsum(x[order]) - x[order]
        starts = np.searchsorted(bins[order], np.arange(len(used)))
        offset = np.empty(len(x), np.int64)
        offset[order] = at - at[starts][bins[order]]
        name = np.minimum.reduceat(copies[order], starts)[bins]
        gone = ~keep[bins]
        yield from pa.table([own["copy"], own["length"], pa.array(np.full(len(x), p)), pa.array(name, mask=gone), pa.array(offset, mask=gone)], ["copy", "length", "part", "sequence_id", "offset"]).to_batches()


def best_fit_packing(pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with ``sequence_id`` and gapless ``offset``.

    Full pieces are sequences of their own.  The others are packed in rounds;
    bins that are done in a round keep their place.  Rows that repeat a
    (doc_id, piece) are packed as often as they come; null doc_ids are packed
    like others.  Columns that the packing doesn't know come back unchanged.
    """
    pieces = cut(pieces.withColumn("copy", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity).select("copy", "length")
    parts, done = max(1, -(-short.count() // per_part)), []
    rest = short.withColumn("part", F.pmod(F.xxhash64("copy"), F.lit(parts)))
    while True:
        kernel = partial(_pack, capacity=capacity, hand_on=per_part // FAN_IN if parts > 1 else 0)
        packed = cut(rest.repartition(parts, "part").mapInArrow(kernel, "copy long, length long, part long, sequence_id long, offset long"))
        done.append(packed.where("sequence_id IS NOT NULL").select("copy", "sequence_id", "offset"))
        if parts == 1:
            break
        parts = -(-parts // FAN_IN)
        rest = packed.where("sequence_id IS NULL").select("copy", "length", F.floor(F.col("part") / FAN_IN).alias("part"))
    places = reduce(DataFrame.unionByName, done)
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("copy"), "offset": F.lit(0).cast("long")})
    return full.unionByName(pieces.where(F.col("length") < capacity).join(places, "copy")).drop("copy")


def sequences(docs: DataFrame, placed: DataFrame, **how) -> DataFrame:
    """Token ids of each sequence, as binary, from ``docs`` and the places of their pieces."""
    ids = token_pieces(docs, with_ids=True, **how).select("doc_id", "piece", "ids")
    rows = placed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.transform("parts", lambda p: p["ids"]).alias("parts"))
