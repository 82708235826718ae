"""Language identification by error-correcting output codes.

Each language has a codeword.  A binary naive Bayes classifier over hashed
byte n-grams predicts each bit, learnt from counts of all training texts.
Decoding sums a squared hinge loss over the bits, weighted by how well each
bit's two groups part, and takes the codeword of least loss; a document whose
second codeword is about as near is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, flat, mix, text_chunks

FEATURES, ORDERS = 4096, (2, 3, 4)
AMBIGUOUS = 0.2  #: difference of the two best scores below which a document is flagged
_ROWS = 512  #: texts whose counts are dense at a time
_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_CODE[65:91] = _CODE[97:123]
_CODE[[9, 10, 11, 12, 13]] = _CODE[32]
_STEP = mix(np.arange(1001, 1005, dtype=np.uint64)) | np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_HIGH = np.arange(256) >= 128


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of each text, within the text."""
    n = len(off) - 1
    out = np.zeros(n * FEATURES)
    x, doc = _CODE[buf], np.repeat(np.arange(n), np.diff(off))
    for order in ORDERS:
        m = len(x) - order + 1
        if m <= 0:
            continue
        h = x[:m] * _STEP[0]
        for k in range(1, order):
            h += x[k : k + m] * _STEP[k]
        whole = doc[:m] == doc[order - 1 :]
        out += np.bincount((doc[:m] * FEATURES + (h >> np.uint64(52)).astype(np.int64))[whole], minlength=n * FEATURES)
    return out.reshape(n, FEATURES)


def _groups(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for i in range(0, b.num_rows, _ROWS):
        part = b.slice(i, _ROWS)
        yield part, *flat(part.column("text"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed counts of each language in this partition."""
    total: dict[str, np.ndarray] = {}
    for b in text_chunks(batches):
        for part, buf, off in _groups(b):
            x = counts(buf, off)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + x[langs == lang].sum(0)
    for lang, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * FEATURES, pa.string()), pa.array(np.arange(FEATURES, dtype=np.int32)), pa.array(x.astype(np.int64))], ["lang", "feature", "n"])


def codewords(languages: int) -> np.ndarray:
    """Codewords of +1 and -1: all splits of few languages, else the best of some random codes."""
    if languages <= 5:
        split = [[1 if (c >> i) & 1 else -1 for i in range(languages)] for c in range(1, 2 ** max(0, languages - 1))]
        return np.array(split or [[1] * languages]).T.reshape(languages, -1)
    bits, rng, best, apart = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(11), None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (languages, bits))
        near = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if near > apart and (np.abs(code.sum(0)) < languages).all():
            best, apart = code, near
    return best


def fit(docs: DataFrame) -> dict:
    """Bit classifiers from all rows of ``docs(text, lang)`` with text and language.

    What comes to the driver is a vector of counts for each language.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").mapInArrow(_count, "lang string, feature int, n long")
    rows = rows.groupBy("lang", "feature").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("feature", "n"))).alias("v")).select("lang", F.transform("v", lambda s: s["n"]).alias("v")).collect()
    rows = sorted((r[0], np.array(r[1], float)) for r in rows)
    langs = [r[0] for r in rows if r[1].sum() > 0]
    if not langs:
        return {"langs": []}
    p = np.stack([(r[1] + 0.5) / (r[1].sum() + 0.5 * FEATURES) for r in rows if r[1].sum() > 0])
    code = codewords(len(langs))
    weights, shift, scale, apart = [], [], [], []
    for bit in code.T:
        if (bit > 0).all() or (bit < 0).all():
            w = np.log(p[bit > 0].mean(0) * FEATURES)
            one, zero = float(p.mean(0) @ w), 0.0
        else:
            up, down = p[bit > 0].mean(0), p[bit < 0].mean(0)
            w = np.log(up / down)
            one, zero = min(float(x @ w) for x in p[bit > 0]), max(float(x @ w) for x in p[bit < 0])
        weights.append(w)
        shift.append((one + zero) / 2)
        scale.append(max(1e-6, abs(one - zero) / 2))
        apart.append(max(1e-6, one - zero))
    apart = np.array(apart)
    return {"langs": langs, "code": code, "w": np.stack(weights, 1), "shift": np.array(shift), "scale": np.array(scale), "weight": apart / apart.sum()}


def decode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score, margin and loss of each row of counts.

    The loss, of the nearest codeword, is 0 where all bits agree with it and 1
    where they say nothing, however many languages there are.
    """
    f = (x @ model["w"] / np.maximum(1, x.sum(1, keepdims=True)) - model["shift"]) / model["scale"]
    f = np.clip(f, -3, 3)
    loss = np.stack([(np.maximum(0, 1 - f * c) ** 2) @ model["weight"] for c in model["code"]], 1)
    e = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    e /= e.sum(1, keepdims=True)
    top = e.argmax(1)
    second = np.sort(e, 1)[:, -2] if e.shape[1] > 1 else np.zeros(len(e))
    return top, e.max(1), e.max(1) - second, loss.min(1)


def _predict(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches):
        for part, buf, off in _groups(b):
            total = np.concatenate([[0], np.cumsum(_LETTER[buf])])
            letters = np.diff(total[off]) > 0
            if not letters.all():
                high = np.diff(np.concatenate([[0], np.cumsum(_HIGH[buf])])[off]) > 0
                for i in np.flatnonzero(~letters & high):
                    letters[i] = any(map(str.isalpha, part.column("text")[i].as_py()))
            pred, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            margin, loss = np.zeros(part.num_rows), np.ones(part.num_rows)
            if model["langs"]:
                top, s, m, far = decode(counts(buf, off), model)
                pred[letters] = np.array(model["langs"], object)[top[letters]]
                score[letters], margin[letters], loss[letters] = s[letters], m[letters], far[letters]
            arrays = [part.column(i) for i in range(part.num_columns)] + [pa.array(pred, pa.string()), pa.array(score), pa.array(margin < AMBIGUOUS), pa.array(loss)]
            yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, "lang_pred", "score", "ambiguous", "loss"])


def language_id(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """All columns of ``docs(doc_id, text, lang, ...)`` with ``held_out``, ``lang_pred``, ``score``, ``ambiguous`` and ``loss`` (of the nearest codeword, see ``decode``).

    Learns from text and language of documents whose crc32(doc_id) modulo
    ``folds`` is not ``held``.  Null texts, texts without a letter, and all
    texts where nothing was learnt, are ``und`` with score 0 and loss 1.  Very
    long texts are read whole; repeated rows give repeated rows, an empty
    table none.  Columns of these five names that are there before are replaced.
    """
    docs = docs.drop("held_out", "lang_pred", "score", "ambiguous", "loss").withColumn("text", F.col("text").cast("string"))
    out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    model = fit(docs.where(~out).select("text", F.col("lang").cast("string").alias("lang")))
    rows = docs.withColumn("held_out", out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(partial(_predict, model=model), schema + ", lang_pred string, score double, ambiguous boolean, loss double")
