"""SentencePiece encoding and decoding in numpy batches.

A text's words (runs that start at a space sign) are encoded once for each
batch of texts; equally long ones advance together.  With a unigram
vocabulary the advance is Viterbi's: at each place the substrings that end
there are probed by hash among the sorted piece keys, and vectorised maxima
keep scores and backpointers.  A vocabulary of merges (BPE) has ranks for
scores, whose sum means nothing; there each step merges the best pair of every
word of the group at once, found by the same probes, as the format demands.
Characters that no piece covers fall back to bytes, or else to the unknown piece.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, span_hashes, text_chunks
from .pieces import SPACE, SpanHasher, Vocabulary, substring_ids, vocabulary

MODEL = "piece_bpe_32k.model"
LONG = 1024  #: bytes of a word from which a BPE word is merged alone, by a heap
BATCH_BYTES = 1 << 20  #: of text, of which encoding takes about a hundred times as much


def take_spans(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(size)
    return values[np.arange(total) - np.repeat(ends - size - start, size)]


def viterbi(rows: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number for each of the equally long strings: the segmentation of the greatest summed score."""
    n, width = rows.shape
    ids = substring_ids(rows, vocab)
    first = np.concatenate([(rows & 0xC0) != 0x80, np.ones((n, 1), bool)], 1)
    lowest = float(vocab.scores.min()) - 10
    best, back = np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int64)
    best[0] = 0
    for j in range(1, width + 1):
        paths = []
        for k in range(1, min(j, max(4, len(ids))) + 1):
            piece = ids[k - 1][:, j - k] if k <= len(ids) else np.full(n, -1)
            whole = first[:, j - k] & first[:, j]
            one = whole & ~first[:, j - k + 1 : j].any(1)
            score = np.where(whole & (piece >= 0), vocab.scores[piece], np.where(one & (piece < 0), lowest, -np.inf))
            paths.append(best[j - k] + score)
        paths = np.stack(paths)
        k = paths.argmax(0)
        best[j], back[j] = paths[k, np.arange(n)], k + 1
    ends = [[] for _ in range(n)]
    for i in range(n):
        j = width
        while j > 0:
            ends[i].append((j - int(back[j, i]), j))
            j -= int(back[j, i])
    out, count = [], np.zeros(n, np.int64)
    for i, spans in enumerate(ends):
        for a, b in reversed(spans):
            piece = int(ids[b - a - 1][i, a]) if b - a <= len(ids) else -1
            found = [piece] if piece >= 0 else _unknown(rows[i, a:b], vocab)
            out += found
            count[i] += len(found)
    return np.array(out, np.int32), count


def _unknown(raw: np.ndarray, vocab: Vocabulary) -> list[int]:
    ids = vocab.byte_ids[raw]
    return ids.tolist() if (ids >= 0).all() else [vocab.processor.unk_id()]


def merges(rows: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number for each of the equally long strings: the best pair is merged, leftmost first, until none is a piece."""
    n, width = rows.shape
    hashes = SpanHasher(np.ascontiguousarray(rows).ravel())
    first = (rows & 0xC0) != 0x80
    chars = first.sum(1)
    most = int(chars.max())
    start = np.full((n, most + 1), width, np.int64)
    r, c = np.nonzero(first)
    start[r, np.arange(len(r)) - np.repeat(np.cumsum(chars) - chars, chars)] = c

    def scores(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Score of the piece in each span, or -inf."""
        piece = np.full(len(a), -1, np.int32)
        fit = b - a <= vocab.longest
        at, size = (row * width + a)[fit], (b - a)[fit]
        piece[fit] = vocab.probe(hashes.each(at, size))
        return np.where(piece >= 0, vocab.scores[piece], -np.inf)

    pair = np.full((n, most), -np.inf)
    r, k = np.nonzero(start[:, 1:] < width)
    pair[r, k] = scores(r, start[r, k], start[r, np.minimum(k + 2, most)])
    live = np.arange(n)
    steps = np.arange(most)
    while len(live):
        k = pair[live].argmax(1)
        on = np.isfinite(pair[live, k])
        live, k = live[on], k[on]
        if not len(live):
            break
        # drop the boundary after place k, and the pair there
        move = steps + (steps >= (k + 1)[:, None])
        s = np.concatenate([start[live], np.full((len(live), 1), width)], 1)
        start[live, :most] = np.take_along_axis(s, move, 1)
        start[live, most] = width
        p = np.concatenate([pair[live], np.full((len(live), 1), -np.inf)], 1)
        pair[live] = np.take_along_axis(p, move, 1)
        s = start[live]
        here = np.arange(len(live))
        end = s[here, np.minimum(k + 1, most)]
        after = end < width
        pair[live, k] = -np.inf
        pair[live[after], k[after]] = scores(live[after], s[here, k][after], s[here, np.minimum(k + 2, most)][after])
        before = k > 0
        pair[live[before], k[before] - 1] = scores(live[before], s[here, k - 1][before], end[before])
    r, k = np.nonzero(start[:, :-1] < width)
    a, b = start[r, k], start[r, k + 1]
    piece = np.full(len(a), -1, np.int32)
    fit = b - a <= vocab.longest
    piece[fit] = vocab.probe(hashes.each((r * width + a)[fit], (b - a)[fit]))
    if (piece >= 0).all():
        return piece, np.bincount(r, minlength=n)
    has_bytes = (vocab.byte_ids >= 0).all()
    size = np.where(piece >= 0, 1, (b - a) if has_bytes else 1)
    out = np.repeat(piece, size)
    at = np.cumsum(size) - size
    for i in np.flatnonzero(piece < 0).tolist():
        out[at[i] : at[i] + size[i]] = _unknown(rows[r[i], a[i] : b[i]], vocab)
    return out, np.bincount(r, size, n).astype(np.int64)


def merge_long(raw: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Ids of one long word by the same merges, in n log n steps: a heap of pairs over a linked list of symbols."""
    data, known = raw.tobytes(), vocab.by_text()
    start = np.flatnonzero((raw & 0xC0) != 0x80).tolist()
    end = [*start[1:], len(data)]
    n = len(start)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    score, heap = vocab.scores, []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and end[j] - start[i] <= vocab.longest and (piece := known.get(data[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (-score[piece], i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], alive[j], right[i] = stop, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    ids, i = [], 0
    while i >= 0:
        piece = known.get(data[start[i] : end[i]])
        ids += [piece] if piece is not None else _unknown(raw[start[i] : end[i]], vocab)
        i = right[i]
    return np.array(ids, np.int32)


def encode_words(blob: np.ndarray, start: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words in one array, with each word's place and number in it."""
    advance = merges if vocab.kind == "bpe" else viterbi
    order = np.argsort(size, kind="stable")
    at = np.flatnonzero(np.diff(size[order], prepend=-1))
    ids, place, count, n = [], np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), 0
    for i, j in zip(at.tolist(), np.append(at[1:], len(order)).tolist(), strict=True):
        length = int(size[order[i]])
        if not length:
            continue
        if vocab.kind == "bpe" and length >= LONG:
            for k in order[i:j].tolist():
                ids.append(merge_long(blob[start[k] : start[k] + length], vocab))
                place[k], count[k] = n, len(ids[-1])
                n += len(ids[-1])
            continue
        step = max(1, 1_000_000 // length)
        for k in range(i, j, step):
            some = order[k : min(j, k + step)]
            found, number = advance(blob[start[some][:, None] + np.arange(length)], vocab)
            place[some], count[some] = n + np.cumsum(number) - number, number
            ids.append(found)
            n += len(found)
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), place, count


def encode_batch(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and n + 1 offsets."""
    buf, off = flat(texts)
    n = len(off) - 1
    # the space sign before each text that isn't empty, and for each space
    grow = np.ones(len(buf), np.int64)
    space = buf == 32
    grow[space] = 3
    head = 3 * (np.diff(off) > 0)
    ends = np.concatenate([[0], np.cumsum(grow)])
    shift = np.cumsum(head)
    doc = np.repeat(np.arange(n), np.diff(off))
    to = ends[:-1] + shift[doc]
    blob = np.empty(int(ends[-1] + head.sum()), np.uint8)
    blob[to[~space]] = buf[~space]
    first = ends[off[:-1]] + shift - head
    marks = np.concatenate([to[space], first[head > 0]])
    for k in range(3):
        blob[marks + k] = SPACE[k]
    new_off = np.append(first, len(blob))
    # a word starts at a space sign that doesn't follow another, or with a text
    sign = np.zeros(len(blob), bool)
    sign[marks] = True
    begins = sign.copy()
    begins[3:] &= ~sign[:-3]
    begins[new_off[:-1][head > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(blob))
    h = span_hashes(blob, start, end, lower=False)
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    ids, place, count = encode_words(blob, start[index], (end - start)[index], vocab)
    per_word = count[inverse]
    total = np.concatenate([[0], np.cumsum(per_word)])
    return take_spans(ids, place[inverse], per_word), total[np.searchsorted(start, new_off)]


def piece_texts(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the ids stand for, one after the other, and the number of each one's."""
    texts = [t.replace(SPACE, b" ") for t in vocab.texts]
    for byte, i in enumerate(vocab.byte_ids):
        if i >= 0:
            texts[i] = bytes([byte])
    texts[vocab.processor.unk_id()] = " ⁇ ".encode()
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])


def decode_batch(ids: np.ndarray, off: np.ndarray, blob: np.ndarray, size: np.ndarray) -> list[str]:
    """Texts of the ids between the offsets, without the space sign that encoding put first."""
    start, n = np.cumsum(size) - size, size[ids]
    joined = take_spans(blob, start[ids], n).tobytes()
    at = np.concatenate([[0], np.cumsum(n)])[off].tolist()
    return [joined[a:z].removeprefix(b" ").decode("utf-8", "replace") for a, z in zip(at[:-1], at[1:], strict=True)]


def _encode(batches: Iterator[pa.RecordBatch], model: str, with_text: bool) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(model)
    blob, size = piece_texts(vocab)
    for b in text_chunks(batches, limit=BATCH_BYTES):
        ids, off = encode_batch(b.column("text"), vocab)
        raw = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
        columns, names = [b.column("doc_id"), pa.array(np.diff(off), pa.int64()), raw], ["doc_id", "n_ids", "ids"]
        if with_text:
            columns.append(pa.array(decode_batch(ids, off, blob, size), pa.string()))
            names.append("text")
        yield pa.RecordBatch.from_arrays(columns, names)


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    blob, size = piece_texts(vocabulary(model))
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            raw, off = flat(part.column("ids"))
            out = decode_batch(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), off // 4, blob, size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_ids"), part.column("ids"), pa.array(out, pa.string())], ["doc_id", "n_ids", "ids", "text"])


def encode(docs: DataFrame, model: str = MODEL, with_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_ids`` and ``ids`` (little-endian unsigned 32-bit) of each row of ``docs(doc_id, text)``; ``with_text``, also the ``text`` that decoding the ids gives, in the same pass.

    Null and empty texts have no ids; very long texts and words are encoded
    whole; repeated rows give repeated rows, an empty table none.  Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kernel = partial(_encode, model=model, with_text=with_text)
    return docs.mapInArrow(kernel, "doc_id long, n_ids long, ids binary" + (", text string" if with_text else ""))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded(doc_id, n_ids, ids)`` with the ``text`` that the ids stand for."""
    return encoded.select("doc_id", "n_ids", "ids").mapInArrow(partial(_decode, model=model), "doc_id long, n_ids long, ids binary, text string")
