"""Subword vocabularies: pieces of a SentencePiece model as hashed keys, and probes of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import BYTE, mix, powers, span_hashes

SPACE = "▁".encode()
_LOADED: dict[str, "Vocabulary"] = {}
_SLOTS = 1 << 20


@dataclass
class Vocabulary:
    processor: object
    kind: str  #: "unigram" or "bpe"
    texts: list[bytes]  #: bytes of each piece; of control pieces and the unknown one empty
    scores: np.ndarray
    byte_ids: np.ndarray  #: piece of each byte, or -1
    longest: int
    keys: np.ndarray  #: sorted hashes of the pieces that stand for text
    ids: np.ndarray  #: their ids
    table: np.ndarray
    _by_text: dict[bytes, int] | None = None

    def by_text(self) -> dict[bytes, int]:
        """Pieces that stand for text, by their bytes."""
        if self._by_text is None:
            self._by_text = {self.texts[i]: i for i in self.ids.tolist()}
        return self._by_text

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, or -1: the sorted keys are entered through a table of their leading bits."""
        shape, h = h.shape, h.ravel()
        at = self.table[(h >> np.uint64(44)).astype(np.int64)]
        out = np.full(len(h), -1, np.int32)
        left = np.flatnonzero(at >= 0)
        at = at[left]
        while len(left):
            key = self.keys[at]
            same = key == h[left]
            out[left[same]] = self.ids[at[same]]
            on = (key < h[left]) & (at + 1 < len(self.keys))
            left, at = left[on], at[on] + 1
        return out.reshape(shape)


def vocabulary(model: str = "piece_bpe_32k.model") -> Vocabulary:
    """The model's pieces, read once for each worker; ``model`` is a file of the public tokenizers."""
    if model not in _LOADED:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = sp.vocab_size()
        byte_ids, texts = np.full(256, -1), []
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            texts.append(b"" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) else sp.id_to_piece(i).encode())
        scores = np.array([sp.get_score(i) for i in range(n)])
        used = [i for i in range(n) if texts[i]]
        buf = np.frombuffer(b"".join(texts[i] for i in used), np.uint8)
        end = np.cumsum([len(texts[i]) for i in used])
        start = np.append(0, end[:-1])
        h = span_hashes(buf, start, end, lower=False)
        order = np.argsort(h)
        keys, ids = h[order], np.array(used, np.int32)[order]
        slot = (keys >> np.uint64(44)).astype(np.int64)
        table = np.full(_SLOTS, -1, np.int32)
        table[slot[::-1]] = np.arange(len(keys))[::-1]
        whole = scores[used] == np.round(scores[used])
        _LOADED[model] = Vocabulary(sp, "bpe" if whole.mean() > 0.99 else "unigram", texts, scores, byte_ids, max(map(len, texts)), keys, ids, table)
    return _LOADED[model]


def substring_ids(rows: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """For k = 1, 2, ...: ids of the substrings of k bytes of equally long byte strings, by string and start."""
    n, width = rows.shape
    base, sums = np.arange(n)[:, None] * width, SpanHasher(np.ascontiguousarray(rows).ravel())
    return [vocab.probe(sums.spans(base + np.arange(width - k + 1), k)) for k in range(1, min(width, vocab.longest) + 1)]


class SpanHasher:
    """Hashes of many spans of the same bytes; the running sum is made once."""

    def __init__(self, flat: np.ndarray):
        up, self.down = powers(len(flat) + 1)
        self.total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(BYTE[flat] * up[: len(flat)], out=self.total[1:])

    def each(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.total[start + size] - self.total[start]) * self.down[start] + size.astype(np.uint64))

    def spans(self, start: np.ndarray, k: int) -> np.ndarray:
        return mix((self.total[start + k] - self.total[start]) * self.down[start] + np.uint64(k))
