"""Quality by hierarchical empirical Bayes.

A document classifier (an additive logistic model over binned text
statistics) gives each document's own evidence.  Grouped sums of it give each
host a posterior, shrunk toward the global mean, and each path of a host one
shrunk toward the host's.  How strongly is taken from the spread between
groups, so that sparse sites stay near the prior.  A document's score joins
its own log odds with those of its path against the global ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, flat, small, span_hashes, text_chunks, words

BINS = 12
RIDGES = (0.1, 0.3, 1.0, 3.0)  #: of which cross-validation within the training rows takes one
_CLASSES = np.zeros((256, 8), bool)
_CLASSES[65:91, 0] = True  # capitals
_CLASSES[97:123, 1] = True  # small letters
_CLASSES[48:58, 2] = True  # digits
_CLASSES[128:, 3] = True  # beyond ASCII
_CLASSES[[33, 63], 4] = True  # ! ?
_CLASSES[[44, 46, 58, 59], 5] = True  # . , : ;
_CLASSES[10, 6] = True  # line ends
_CLASSES[33:127, 7] = True
_CLASSES[[33, 63, 44, 46, 58, 59], 7] = False
_CLASSES[48:58, 7] = _CLASSES[65:91, 7] = _CLASSES[97:123, 7] = False  # other signs


def _repeats(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values in each group, and the count of the commonest."""
    v = values.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        v[a:b].sort()
    first = np.ones(len(v), bool)
    first[1:] = v[1:] != v[:-1]
    first[off[:-1][off[:-1] < len(v)]] = True
    at = np.flatnonzero(first)
    runs = np.diff(np.append(at, len(v)))
    starts = np.searchsorted(at, off)
    most = np.zeros(len(off) - 1)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        most[full] = np.maximum.reduceat(runs, starts[full])
    return np.diff(starts), most


def statistics(texts: pa.Array) -> np.ndarray:
    """Statistics of each whole text; of empty texts they are zero."""
    buf, off = flat(texts)
    n = len(off) - 1
    size = np.maximum(1, np.diff(off))
    out = [np.log1p(np.diff(off))]
    share = []
    for k in range(_CLASSES.shape[1]):
        share.append(np.diff(np.concatenate([[0], np.cumsum(_CLASSES[buf, k])])[off]))
    out += [share[0] / np.maximum(1, share[0] + share[1])] + [x / size for x in share[2:]]
    start, end, doc = words(buf, off)
    woff = np.searchsorted(doc, np.arange(n + 1))
    h = span_hashes(buf, start, end)
    count = np.maximum(1, np.diff(woff))
    kinds, most = _repeats(h, woff)
    out += [np.bincount(doc, end - start, n) / count, kinds / count, most / count]
    same = np.zeros(n)
    if len(h) > 1:
        same = np.bincount(doc[1:], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), n)
    out.append(same / count)
    ends = np.zeros(len(buf) + 1, bool)
    ends[off] = True
    ends[1:] |= np.append(buf, 0)[:-1] == 10 if len(buf) else False
    places = np.flatnonzero(ends)
    if len(buf):
        a, b = places[:-1], places[1:]
        line = span_hashes(buf, a, b - (buf[b - 1] == 10))
        loff = np.searchsorted(np.searchsorted(off, a, "right") - 1, np.arange(n + 1))
        kinds, most = _repeats(line, loff)
        lines = np.maximum(1, np.diff(loff))
        out += [kinds / lines, np.diff(loff) / count]
    else:
        out += [np.zeros(n), np.zeros(n)]
    return np.stack(out, 1)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches):
        x = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> dict:
    """Additive logistic model from at most ``per_class`` rows of either label, those of the smallest hash of doc_id."""
    labels = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    chosen = [labels.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows of two numbers
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("label", "text").mapInArrow(_sample, "label int, x binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    y = np.array([r[0] for r in rows], float)
    prior = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return {"edges": None, "bias": prior}
    x = np.stack([np.frombuffer(r[1]) for r in rows])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    design = _design(x, edges)
    w = _newton(design, y, _ridge(design, y))
    w[0] += prior
    return {"edges": edges, "w": w, "bias": prior}


def _newton(design: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of the penalised logistic fit in which both labels weigh alike."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    w, penalty = np.zeros(design.shape[1]), np.full(design.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty), design.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _ridge(design: np.ndarray, y: np.ndarray, folds: int = 3, most: int = 4000) -> float:
    """The ridge of least balanced log loss by cross-validation over at most ``most`` of the training rows."""
    order = np.random.default_rng(13).permutation(len(y))[:most]
    design, y = design[order], y[order]
    fold, loss = np.arange(len(y)) % folds, np.zeros(len(RIDGES))
    for k in range(folds):
        on, off = fold != k, fold == k
        if not (0 < y[on].sum() < on.sum() and 0 < y[off].sum() < off.sum()):
            return 1.0
        for i, ridge in enumerate(RIDGES):
            z = np.clip(design[off] @ _newton(design[on], y[on], ridge, 12), -30, 30)
            each = np.logaddexp(0, np.where(y[off] == 1, -z, z))
            loss[i] += each[y[off] == 1].mean() + each[y[off] == 0].mean()
    return RIDGES[int(loss.argmin())]


def _design(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    cols = [np.ones((len(x), 1))]
    for c, e in zip(x.T, edges, strict=True):
        cols.append(np.eye(len(e) + 1)[np.searchsorted(e, c, "right")])
    return np.concatenate(cols, 1)


def log_odds(texts: pa.Array, model: dict) -> np.ndarray:
    if model["edges"] is None:
        return np.full(len(texts), model["bias"])
    return np.clip(_design(statistics(texts), model["edges"]) @ model["w"], -12, 12)


def _evidence(batches: Iterator[pa.RecordBatch], model: dict, keep: bool) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches):
        z = pa.array(log_odds(b.column("text"), model))
        if keep:
            yield pa.RecordBatch.from_arrays([*b.columns, z], [*b.schema.names, "log_odds"])
        else:
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("path"), z], ["host", "path", "log_odds"])


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """Shrunk means of ``evidence(host, path, p)`` for each path, and the global mean.

    The prior's weight is the beta distribution's that has the spread between
    groups which sampling leaves unexplained; it is found from one row of sums.
    """
    paths = cut(evidence.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"), F.sum("v").alias("hv"))
    r = hosts.agg(F.sum("hs"), F.sum("hn"), F.count("*"), F.avg(F.col("hs") / F.col("hn")), F.var_pop(F.col("hs") / F.col("hn")), F.avg(F.col("hv") / F.col("hn") ** 2)).first()
    if not r[1]:
        return paths.select("host", "path", F.lit(0.5).alias("host_posterior"), F.lit(0.5).alias("path_posterior")), 0.5
    mean = min(max(r[0] / r[1], 1e-6), 1 - 1e-6)
    strength = _strength(mean, r[4], r[5])
    hosts = hosts.select("host", "hs", "hn", ((F.col("hs") + strength * mean) / (F.col("hn") + strength)).alias("host_posterior"))
    both = cut(paths.join(hosts, "host"))
    # the spread of paths within their hosts has a strength of its own, from hosts of two paths or more
    several = both.where("n < hn")
    off = F.col("s") / F.col("n") - F.col("hs") / F.col("hn")
    q = several.agg(F.avg(off * off), F.avg(F.col("v") / F.col("n") ** 2)).first()
    own = strength if q[0] is None else _strength(mean, q[0], q[1])
    return both.select("host", "path", "host_posterior", ((F.col("s") + own * F.col("host_posterior")) / (F.col("n") + own)).alias("path_posterior")), mean


def _strength(mean: float, spread: float, noise: float) -> float:
    """Weight, in documents, of a beta prior whose spread is what noise doesn't explain."""
    return min(max(mean * (1 - mean) / max(spread - noise, 1e-9) - 1, 1.0), 1e4)


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", folds: int = 5, held: int = 0, threshold: float = 0.3, per_class: int = 6000) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` with ``log_odds``, ``host_posterior``, ``path_posterior``, ``score``, ``keep`` and ``held_out``.

    Learns from ``labels(doc_id, quality)`` of documents whose crc32(doc_id)
    modulo ``folds`` is not ``held``.  Null texts count as empty, null hosts
    and paths as the empty one.  Very long texts are read whole; repeated rows
    give repeated rows, and weigh as often in their site's posterior; an empty
    table gives none.  Of contradicting labels of a document the greater counts.  Columns of these names that are there before are replaced.
    """
    docs = docs.drop("log_odds", "host_posterior", "path_posterior", "score", "keep", "held_out")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.where(~out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")), per_class)
    place = {"host": F.coalesce(F.col(host).cast("string"), F.lit("")), "path": F.coalesce(F.col(path).cast("string"), F.lit(""))}
    evidence = docs.select(place["host"].alias("host"), place["path"].alias("path"), "text").mapInArrow(partial(_evidence, model=model, keep=False), "host string, path string, log_odds double")
    groups, mean = posteriors(evidence.select("host", "path", (1 / (1 + F.exp(-F.col("log_odds")))).alias("p")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(partial(_evidence, model=model, keep=True), schema + ", log_odds double")
    # so that texts need no shuffle by host, and a host with many documents no task of its own
    groups = small(groups.withColumnsRenamed({"host": "_host", "path": "_path"}))
    rows = rows.join(groups, (place["host"] == F.col("_host")) & (place["path"] == F.col("_path")), "left").drop("_host", "_path")
    z = F.col("log_odds") + F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) - float(np.log(mean / (1 - mean)))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-z)))
    return rows.withColumns({"keep": F.col("score") >= threshold, "held_out": out})
