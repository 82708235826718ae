"""Language-model scoring by subword lattices, beside a smoothed word unigram.

The vocabulary is an existing one; its pieces' probabilities start from the
scores in its file and are estimated anew from the training words by one round
of expectation maximisation over all segmentations.  A word's probability is
the sum over its segmentations, by forward recursion in log space; a text's is
the product over its words and its end.  Words of the training part are arcs
of the lattice themselves, besides.

Texts are read once.  Blocks of them keep their tokens as numbers of the
block's distinct words; those words travel, with counts, to the bucket of
their hash, where counts of all blocks meet and words are scored, and the
answers travel back to the blocks.  No table of words is ever whole in one place.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, flat, small, span_hashes, text_chunks, words
from .pieces import SPACE, Vocabulary, substring_ids, vocabulary

BLOCK_BYTES, BUCKET_BYTES = 32 << 20, 32 << 20
MODEL = "piece_bpe_32k.model"
END = np.uint64(0)  #: stands for the end of a text among word hashes


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind: type | None = None) -> np.ndarray | bytes:
    raw = zstandard.ZstdDecompressor().decompress(bytes(x), max_output_size=1 << 31) if len(x) else b""
    return raw if kind is None else np.frombuffer(raw, kind)


def _take(blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of the spans, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.uint8)
    ends = np.cumsum(size)
    return blob[np.arange(total) - np.repeat(ends - size - start, size)]


# ---------------------------------------------------------------- lattice


def starting_weights(vocab: Vocabulary) -> np.ndarray:
    """Log probabilities from the scores in the vocabulary's file: log probabilities of a unigram one, else negative ranks, by Zipf's law."""
    p = np.zeros(len(vocab.scores))
    used = np.array([bool(t) for t in vocab.texts])
    p[used] = np.exp(vocab.scores[used]) if vocab.kind == "unigram" else 1 / (10 - np.clip(vocab.scores[used], -1e6, 0))
    bytes_ = vocab.byte_ids[vocab.byte_ids >= 0]
    p[bytes_] = p.sum() * 1e-3 / max(1, len(bytes_))
    with np.errstate(divide="ignore"):
        return np.log(p / p.sum())


def lattice(rows: np.ndarray, logp: np.ndarray, vocab: Vocabulary, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log of the summed probability of all segmentations of equally long strings; with ``counts``, also how often each piece is expected in them."""
    n, width = rows.shape
    ids = substring_ids(rows, vocab)
    single = np.where(ids[0] >= 0, logp[ids[0]], -np.inf)
    fallback = vocab.byte_ids[rows]
    single = np.logaddexp(single, np.where(fallback >= 0, logp[fallback], -np.inf))
    weights = [single] + [np.where(i >= 0, logp[i], -np.inf) for i in ids[1:]]
    alpha = np.full((width + 1, n), -np.inf)
    alpha[0] = 0
    for j in range(1, width + 1):
        paths = np.stack([alpha[j - k] + weights[k - 1][:, j - k] for k in range(1, min(j, len(weights)) + 1)])
        top = paths.max(0)
        top[~np.isfinite(top)] = 0
        with np.errstate(divide="ignore"):
            alpha[j] = top + np.log(np.exp(paths - top).sum(0))
    if counts is None:
        return alpha[width], None
    beta = np.full((width + 1, n), -np.inf)
    beta[width] = 0
    expected, pieces, shares, held = np.zeros(len(logp)), [], [], 0
    for i in range(width - 1, -1, -1):
        paths = np.stack([beta[i + k] + weights[k - 1][:, i] for k in range(1, min(width - i, len(weights)) + 1)])
        top = paths.max(0)
        top[~np.isfinite(top)] = 0
        with np.errstate(divide="ignore"):
            beta[i] = top + np.log(np.exp(paths - top).sum(0))
        share = np.exp(alpha[i] + paths - alpha[width]) * counts
        for k in range(1, len(share) + 1):
            piece, s = ids[k - 1][:, i], share[k - 1]
            if k == 1:  # a byte's own piece and the text piece of one byte share what that step has
                byte = fallback[:, i]
                part = np.where(piece >= 0, np.exp(np.where(piece >= 0, logp[piece], 0) - single[:, i]), 0)
                pieces.append(byte[byte >= 0])
                shares.append((s * (1 - part))[byte >= 0])
                s = s * part
            on = piece >= 0
            pieces.append(piece[on])
            shares.append(s[on])
            held += 2 * n
        if held > 1 << 20 or i == 0:
            expected += np.bincount(np.concatenate(pieces), np.concatenate(shares), len(logp))
            pieces, shares, held = [], [], 0
    return alpha[width], expected


def closing(logp: np.ndarray, vocab: Vocabulary) -> float:
    """Log of the factor by which lattice probabilities of words sum to one: a word goes on while a piece without the space sign follows."""
    first = np.array([t.startswith(SPACE) for t in vocab.texts])
    p = np.exp(logp)
    start, more = p[first].sum(), p[~first].sum()
    return float(np.log((1 - more) / start)) if 0 < start and more < 1 else 0.0


def _by_length(blob: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes of words of the same length, each after the space sign."""
    start = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    at = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, b in zip(at, np.append(at[1:], len(order)), strict=True):
        length = int(size[order[a]])
        step = max(1, 400_000 // (length + 3))
        for i in range(a, b, step):
            some = order[i : min(b, i + step)]
            text = blob[start[some][:, None] + np.arange(length)]
            yield some, np.concatenate([np.broadcast_to(np.frombuffer(SPACE, np.uint8), (len(some), 3)), text], 1)


def word_scores(blob: np.ndarray, size: np.ndarray, logp: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    out = np.zeros(len(size))
    for some, rows in _by_length(blob, size):
        out[some] = lattice(rows, logp, vocab)[0]
    return out


# ---------------------------------------------------------------- blocks and buckets

_BLOCKS = "block long, bucket int, texts binary, hashes binary, counts binary, sizes binary, letters binary"
_NAMES = ["block", "bucket", "texts", "hashes", "counts", "sizes", "letters"]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _prepare(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts, and the distinct words of each by bucket."""
    number, held, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], 0

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal number, held, size
        keys = np.concatenate([h[0] for h in held])
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        counts, at, tokens = np.zeros(len(distinct), np.int32), 0, []
        ends = np.cumsum([len(h[0]) for h in held])
        for h in held:
            own = place[at : at + len(h[0])]
            counts[own] += h[1]
            tokens.append(own.astype(np.int32)[h[2]])
            at += len(h[0])
        which = np.searchsorted(ends, first, "right")
        sizes, letters = np.zeros(len(distinct), np.int32), [b""] * len(held)
        order = np.lexsort((first, which))
        for k, h in enumerate(held):
            some = first[which == k] - (ends[k] - len(h[0]))
            letters[k] = _take(h[4], h[5][some], h[6][some]).tobytes()
            sizes[which == k] = h[6][some]
        blob = np.frombuffer(b"".join(letters), np.uint8)
        by_which = np.argsort(which, kind="stable")
        start = np.zeros(len(distinct), np.int64)
        start[by_which] = np.cumsum(sizes[by_which]) - sizes[by_which]
        del order
        texts = pa.BufferOutputStream()
        doc = pa.table({"doc_id": pa.concat_arrays([h[7] for h in held]), "held_out": pa.concat_arrays([h[8] for h in held]), "n": np.concatenate([h[3] for h in held])})
        with pa.ipc.new_stream(texts, doc.schema) as w:
            w.write_table(doc)
        raw = texts.getvalue().to_pybytes()
        yield _row(number, -1, _pack(raw), _pack(np.concatenate(tokens)), b"", b"", b"")
        b = _bucket(distinct, buckets)
        at = np.searchsorted(b, np.arange(buckets + 1, dtype=np.uint64))
        for k in range(buckets):
            i, j = at[k], at[k + 1]
            if i < j:
                yield _row(number, k, b"", distinct[i:j].tobytes(), _pack(counts[i:j]), _pack(sizes[i:j]), _pack(_take(blob, start[i:j], sizes[i:j])))
        number, held, size = number + 1, [], 0

    for b in text_chunks(batches):
        buf, off = flat(b.column("text"))
        start, end, doc = words(buf, off)
        h = span_hashes(buf, start, end)
        h[h == END] = np.uint64(1)
        n = np.bincount(doc, minlength=b.num_rows)
        # an end after the words of each text
        at = np.cumsum(n) + np.arange(b.num_rows)
        keys = np.full(len(h) + b.num_rows, END)
        keys[np.arange(len(h)) + doc] = h
        keys[at] = END
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        train = ~np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), bool)
        count = np.bincount(place, np.repeat(train, n + 1), len(distinct)).astype(np.int32)
        starts, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[np.arange(len(h)) + doc], sizes[np.arange(len(h)) + doc] = start, end - start
        lower = buf.copy()
        lower[(buf >= 65) & (buf <= 90)] += 32
        starts, sizes = starts[first], sizes[first]
        letters = _take(lower, starts, sizes)
        starts = np.cumsum(sizes) - sizes
        held.append((distinct, count, place.astype(np.int32), (n + 1).astype(np.int64), letters, starts, sizes, b.column("doc_id"), b.column("held_out")))
        size += len(buf)
        if size >= BLOCK_BYTES:
            yield from block()
    if held:
        yield from block()


def _row(*values) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], _NAMES)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows that follow each other with the same ``key``, one row at a time; no more of a run is held than its reader holds."""
    one = (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows))
    yield from itertools.groupby(one, itemgetter(key))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each bucket with their counts in all blocks."""
    for bucket, run in _runs(batches, "bucket"):
        rows = list(run)
        h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        c = np.concatenate([_unpack(r["counts"], np.int32) for r in rows]).astype(np.int64)
        size = np.concatenate([_unpack(r["sizes"], np.int32) for r in rows]).astype(np.int64)
        blob = np.frombuffer(b"".join(_unpack(r["letters"]) for r in rows), np.uint8)
        start = np.cumsum(size) - size
        distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(place, c, len(distinct)).astype(np.int64)
        values = (bucket, int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), distinct.tobytes(), _pack(count), _pack(size[first].astype(np.int32)), _pack(_take(blob, start[first], size[first])))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["bucket", "tokens", "known", "once", "hashes", "counts", "sizes", "letters"])


def _expect(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(model)
    logp, total = starting_weights(vocab), np.zeros(len(vocab.scores))
    for b in batches:
        for r in b.to_pylist():
            count, size = _unpack(r["counts"], np.int64), _unpack(r["sizes"], np.int32).astype(np.int64)
            blob, start = np.frombuffer(_unpack(r["letters"]), np.uint8), np.cumsum(size) - size
            on = (count > 0) & (size > 0)
            count, blob, size = count[on], _take(blob, start[on], size[on]), size[on]
            for some, rows in _by_length(blob, size):
                total += lattice(rows, logp, vocab, count[some])[1]
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for v in b.column("v").to_pylist():
            total = np.frombuffer(v) if total is None else total + np.frombuffer(v)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def token_scores(h: np.ndarray, score: np.ndarray, arc: np.ndarray, end: float, new: float, close: float) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of tokens by segmentations alone, and mixed with whole words: an end has ``end``, words share what it leaves.

    ``score`` has the words' lattices, which ``close`` makes sum to one, and ``arc`` the whole words' part of the mixture, ``1 - new`` in all.
    """
    ends = h == END
    alone = np.where(ends, end, score)
    words_ = score + close + np.log1p(-np.exp(end))
    return alone, np.logaddexp(arc, np.log(new) + np.where(ends, end, words_))


def _answer(batches: Iterator[pa.RecordBatch], model: str, logp: np.ndarray, end: float, tokens: int, new: float) -> Iterator[pa.RecordBatch]:
    """Count and log probabilities of each word that a block asks for: of its segmentations alone, and with the whole word as one more arc."""
    vocab = vocabulary(model)
    for bucket, rows in _runs(batches, "bucket"):
        whole = next(rows)  # its block is -1, the least
        h, count = np.frombuffer(whole["hashes"], np.uint64), _unpack(whole["counts"], np.int64)
        size = _unpack(whole["sizes"], np.int32).astype(np.int64)
        score = word_scores(np.frombuffer(_unpack(whole["letters"]), np.uint8), size, logp, vocab)
        with np.errstate(divide="ignore"):
            arc = np.log((1 - new) * count / max(1, tokens))
        score, both = token_scores(h, score, arc, end, new, closing(logp, vocab))
        for r in rows:
            at = np.searchsorted(h, np.frombuffer(r["hashes"], np.uint64))
            yield _row(r["block"], bucket, b"", score[at].tobytes(), _pack(count[at]), b"", both[at].tobytes())


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, subword_score double"


def _score(batches: Iterator[pa.RecordBatch], tokens: int, known: int) -> Iterator[pa.RecordBatch]:
    for _, rows in _runs(batches, "block"):
        own, *answers = rows  # sorted by bucket, the block's own first
        count = np.concatenate([_unpack(r["counts"], np.int64) for r in answers])
        subword, score = (np.concatenate([np.frombuffer(r[c]) for r in answers]) / np.log(10) for c in ("hashes", "letters"))
        base = np.log10((count + 0.5) / (tokens + 0.5 * (known + 1)))
        doc = pa.ipc.open_stream(_unpack(own["texts"])).read_all()
        place = _unpack(own["hashes"], np.int32)
        n = doc["n"].to_numpy()
        at = np.cumsum(n) - n
        sums = [np.add.reduceat(x[place], at) for x in (base, score, subword)]
        seen = np.add.reduceat((count > 0)[place].astype(np.int64), at)
        yield from pa.table([doc["doc_id"], doc["held_out"], doc["n"], pa.array(seen), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "subword_score"]).to_batches()


def lm_score(docs: DataFrame, folds: int = 5, held: int = 1, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``subword_score`` (log10 probabilities) of each row of ``docs(doc_id, text)``.

    ``subword_score`` sums over segmentations into the vocabulary's pieces.
    ``score`` has one more arc for each word of the training part: the whole
    word by its count, which shares a word's probability with the pieces as
    Good and Turing have it (what was seen once weighs for what is new).

    Learns from documents whose crc32(doc_id) modulo ``folds`` is not
    ``held``.  Null texts count as empty: an end alone.  Null doc_ids are in
    the training part.  Very long texts are scored whole; repeated rows give
    repeated rows, and count as often as they come; an empty table has none.
    Other columns are left out.
    """
    out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), out.alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    blocks = cut(docs.mapInArrow(partial(_prepare, buckets=buckets), _BLOCKS))
    asked = blocks.where("bucket >= 0")
    merged = asked.select("bucket", "hashes", "counts", "sizes", "letters").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_merge, "bucket int, tokens long, known long, once long, hashes binary, counts binary, sizes binary, letters binary")
    merged = cut(merged)
    tokens, known, once = merged.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "known", "once"))).first()
    train = docs.where("NOT held_out").count()
    parts = merged.select("counts", "sizes", "letters").mapInArrow(partial(_expect, model=model), "v binary").repartition(4).mapInArrow(_sum, "v binary").collect()
    vocab = vocabulary(model)
    start = np.exp(starting_weights(vocab))
    pieces = np.sum([np.frombuffer(r[0]) for r in parts] or [np.zeros(len(start))], axis=0)
    # each piece has a small part of what the file's scores give it; the end is one more piece
    p = pieces + start * max(1.0, 1e-3 * pieces.sum())
    total = p.sum() + train + 0.5
    with np.errstate(divide="ignore"):
        logp, end = np.log(p / total), float(np.log((train + 0.5) / total))
    new = min(max(once / max(1, tokens), 1e-6), 1 - 1e-6) if tokens else 1 - 1e-6
    whole = merged.select(F.lit(-1).cast("long").alias("block"), "bucket", F.lit(b"").alias("texts"), "hashes", "counts", "sizes", "letters")
    empty = F.lit(b"")
    ask = asked.select("block", "bucket", empty.alias("texts"), "hashes", empty.alias("counts"), empty.alias("sizes"), empty.alias("letters"))
    answers = whole.unionByName(ask).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block").mapInArrow(partial(_answer, model=model, logp=logp, end=end, tokens=tokens, new=new), _BLOCKS)
    texts = blocks.where("bucket < 0")
    # each block has a partition of its own, which adaptive execution joins with no other
    number = max(1, texts.count())
    places = texts.select("block").withColumn("place", (F.row_number().over(Window.orderBy("block")) - 1).cast("int"))
    dealt = texts.unionByName(answers).join(small(places), "block").repartitionById(number, F.col("place")).sortWithinPartitions("block", "bucket").drop("place")
    scored = dealt.select(*_NAMES).mapInArrow(partial(_score, tokens=tokens, known=known), _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "subword_score")
