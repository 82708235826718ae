"""Helpers shared by the training-data operators: reading, lineage cuts, text kernels and components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at once, whatever the size of the Arrow batch.
CHUNK_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where none is set, a new one of this machine if Spark runs within one process, as in tests, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
        # else checkpoints that nothing refers to any more stay until the folder goes; Spark asks for it when it writes one
        sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: it survives lost executors, and goes when nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``cut``, in partitions of about ``rows`` rows (eight at least): many nearly empty ones would each write files in every later shuffle."""
    d = cut(df)
    return d.coalesce(max(8, -(-d.count() // rows)))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, for rows with whole texts, and its path, to be given to ``discard`` when nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` has written, by the file system that Spark wrote it with."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows (of a few numbers each); a shuffled join takes larger ones."""
    return F.broadcast(df) if df.count() <= most else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what runs hands rows to Python in batches of at most ``rows``: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_mod(col: str, k: int) -> F.Column:
    """crc32 of an integer column as text, modulo ``k``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % k


# ---------------------------------------------------------------- text kernels

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for ``n`` places at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return buf, off - off[0] if len(off) else np.zeros(1, np.int64)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes: a longer text comes alone, and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes that are not ASCII white space."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans; with ``lower``, A-Z count as a-z."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((BYTE_LOWER if lower else BYTE)[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and n + 1 offsets of the texts' words."""
    buf, off = flat(texts)
    start, end, doc = words(buf, off)
    return span_hashes(buf, start, end, lower), np.searchsorted(doc, np.arange(len(off)))


def crc32_of(values: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(values, "<u4").tobytes())


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table, by alternating large-star and small-star steps.

    Returns ``(v, c)`` for each vertex with an edge: c is the smallest vertex
    that v reaches.  Only minima and equi joins are used, so that a hub with
    many edges is pre-aggregated or split by adaptive execution; the state is
    checkpointed after each round, and nothing but a count and a checksum of
    it comes to the driver.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    parts, seen = max(8, -(-e.count() // 50_000)), None
    e = e.coalesce(parts)
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.coalesce(parts).distinct().coalesce(parts))
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.unionByName(roots).select(F.col("u").alias("v"), F.col("v").alias("c"))


def renewed(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components ``(v, c)`` after more ``links(a, b)``: only links between known components are worked on."""
    if comps is None:
        return compact(components(links))
    for k in "ab":
        links = links.join(comps.select(F.col("v").alias(k), F.col("c").alias(f"c{k}")), k, "left").withColumn(k, F.coalesce(f"c{k}", k)).drop(f"c{k}")
    more = compact(components(links.where("a != b")))
    old = comps.join(more.select(F.col("v").alias("c"), F.col("c").alias("d")), "c", "left").select("v", F.coalesce("d", "c").alias("c"))
    return compact(old.unionByName(more.join(comps, "v", "left_anti")))


class Forest:
    """Union-find over small integers, for the pairs of one bounded block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
