"""Toxicity by a factorization machine over hashed terms.

Terms are runs of letters and digits, A-Z as a-z, hashed to ``BUCKETS``.  The
machine has a bias, a weight for each chosen bucket and a vector of ``RANK``
factors, so that it learns which terms count more (or less) together than
alone.  It is fitted on at most ``per_class`` labelled rows of either label,
those of the smallest hash of doc_id; the bias is then moved to the share of
toxic rows among all labelled ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, flat, span_hashes, text_chunks

BUCKETS, CHOSEN, RANK = 1 << 18, 512, 8
OFTEN, PAIRS = 2048, 128  #: terms among which pairs are looked for, those of the greatest variance; and pairs whose terms are chosen, at most
SURE = 32.0  #: squared deviation, in variances, from which a pair's evidence counts: among all pairs of ``OFTEN`` chance gives one in ten times
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each term of the texts, and the text that it is in."""
    buf, off = flat(texts)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside, edge = _TERM[buf], np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return (span_hashes(buf, start, end) % np.uint64(BUCKETS)).astype(np.int64), doc


def _sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of a batch of texts."""
    bucket, doc = terms(b.column("text"))
    key = np.unique(doc * BUCKETS + bucket)
    return key // BUCKETS, key % BUCKETS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of either label that have each bucket, in this partition."""
    total = np.zeros((2, BUCKETS), np.int64)
    for b in text_chunks(batches):
        row, bucket = _sets(b)
        label = np.asarray(b.column("label"))[row]
        for k in (0, 1):
            total[k] += np.bincount(bucket[label == k], minlength=BUCKETS)
    k = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[0, k]), pa.array(total[1, k])], ["bucket", "n0", "n1"])


def _bits(batches: Iterator[pa.RecordBatch], index: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Which of the ``width`` chosen buckets each row has, a bit each."""
    for b in text_chunks(batches):
        row, bucket = _sets(b)
        x = np.zeros((b.num_rows, width), bool)
        k = index[bucket]
        x[row[k >= 0], k[k >= 0]] = True
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r.tobytes() for r in np.packbits(x, 1)], pa.binary())], ["label", "bits"])


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns of ``x`` that belong to a pair whose coming together differs between the labels, beyond what either does alone."""
    n = np.array([(y == k).sum() for k in (0, 1)])
    p = [x[y == k].mean(0, dtype=np.float64) for k in (0, 1)]
    both = x.mean(0, dtype=np.float64)
    spread = both * (1 - both)
    found = []
    for i in range(0, x.shape[1], 512):
        # difference of the two labels' covariances
        gap = 0.0
        for k in (0, 1):
            own = x[y == k].astype(np.float32)
            gap = (2 * k - 1) * (own[:, i : i + 512].T @ own / n[k] - np.outer(p[k][i : i + 512], p[k])) + gap
        z = gap**2 / np.maximum(np.outer(spread[i : i + 512], spread) * (1 / n).sum(), 1e-12)
        z[np.arange(x.shape[1]) <= np.arange(i, i + len(z))[:, None]] = 0
        a, b = np.nonzero(z >= SURE)
        found += zip((-z[a, b]).tolist(), (a + i).tolist(), b.tolist(), strict=True)
    return np.unique([c for _, a, b in sorted(found)[:PAIRS] for c in (a, b)]).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> dict[str, np.ndarray]:
    """Machine from ``docs(doc_id, text)`` and ``labels(doc_id, label)``; without a row of either label, it gives a constant."""
    labels = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = (counts.get(1, 0) + 0.5) / (total + 1)
    chosen = [labels.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows of two numbers
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("label", "text")
    model = {"index": np.full(BUCKETS, -1, np.int16), "bias": np.float64(np.log(share / (1 - share))), "w": np.zeros(0), "v": np.zeros((0, RANK))}
    # counts come first, at most BUCKETS rows; then a few bytes of each row of the sample, however long its text
    found = texts.mapInArrow(_counts, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 5").collect()
    n = np.array([min(per_class, counts.get(k, 0)) for k in (0, 1)], float)
    if not found or not n.all():
        return model
    bucket, in_rows = np.array([r[0] for r in found]), np.array([[r[1], r[2]] for r in found], float).T
    p = (in_rows + 0.5) / (n[:, None] + 1)
    both = (in_rows.sum(0) + 0.5) / (n.sum() + 1)
    chi = (p[1] - p[0]) ** 2 / (both * (1 - both))
    best = np.lexsort((bucket, -chi))[:CHOSEN]
    best = bucket[best[chi[best] > 0]]
    often = bucket[np.lexsort((bucket, -both * (1 - both)))[:OFTEN]]
    able = np.union1d(best, often)
    model["index"][able] = np.arange(len(able))
    rows = texts.mapInArrow(partial(_bits, index=model["index"], width=max(1, len(able))), "label int, bits binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    y = np.array([r[0] for r in rows], np.float64)
    model["index"][:] = -1
    if not 0 < y.sum() < len(y):
        return model
    n = np.array([len(y) - y.sum(), y.sum()])
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(able)]
    # terms that part the labels by themselves, and those that do so in pairs
    at = np.searchsorted(able, np.sort(often))
    columns = np.union1d(np.searchsorted(able, best), at[paired(x[:, at], y)])
    best, x = able[columns], x[:, columns].astype(np.float32)
    model["index"][best] = np.arange(len(best))
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    rng = np.random.default_rng(5)
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    theta = [np.zeros(1, np.float32), np.zeros(len(best), np.float32), rng.normal(0, 0.05, (len(best), RANK)).astype(np.float32)]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, 401):
        b, w, v = theta
        xv = x @ v
        z = b + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        xg = x.T @ g
        grad = [np.array([g.sum()]), xg + 2e-4 * w, x.T @ (xv * g[:, None]) - v * xg[:, None] + 1e-3 * v]
        for k in range(3):
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            s[k] = 0.99 * s[k] + 0.01 * grad[k] ** 2
            theta[k] = theta[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-9)
    b, w, v = theta
    # half of the weight went to either label; the share of toxic rows moves the bias by at most two
    return model | {"bias": float(b[0]) + np.clip(np.log(share / (1 - share)), -2, 2), "w": w.astype(float), "v": v.astype(float)}


def scores(texts: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    bucket, doc = terms(texts)
    k = model["index"][bucket].astype(np.int64)
    doc, k = doc[k >= 0], k[k >= 0]
    width = max(1, len(model["w"]))
    key = np.unique(doc * width + k)
    doc, k = key // width, key % width
    z = np.full(len(texts), model["bias"])
    if len(k):
        n = len(texts)
        z += np.bincount(doc, model["w"][k], n)
        for v in model["v"].T:
            z += 0.5 * (np.bincount(doc, v[k], n) ** 2 - np.bincount(doc, v[k] ** 2, n))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches):
        s = scores(b.column("text"), model)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = 6000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, toxic)`` of documents whose crc32(doc_id)
    modulo ``folds`` is not ``held``.  Null and empty texts have no terms and
    score by the bias; null doc_ids count as not held out.  Very long texts are
    read whole; repeated rows give repeated rows, an empty table none.  Other
    columns are left out.

    The machine sees the ``CHOSEN`` term buckets of ``BUCKETS`` that part the
    labels most by themselves, and those of the ``PAIRS`` pairs of common terms
    that do so most together; the bias is moved by the log odds of the toxic
    share, within 2.  Labels that contradict each other within a document count
    as toxic.
    """
    out = crc_mod("doc_id", folds) == held
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels.where(~out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")), per_class)
    rows = docs.withColumn("held_out", F.coalesce(out, F.lit(False)))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, score double, predicted int")
