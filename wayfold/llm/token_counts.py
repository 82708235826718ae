"""Token counts of whole documents, with each distinct pre-token counted once.

Texts are cut into pre-tokens in numpy: runs of one kind of character, found by
a table of kinds that is asked of the tokenizer itself, a character at a time
as they come.  Pre-tokens that the vocabulary (a table of fixed size) holds are
counted from it at once.  Of the others a block of texts hands on each distinct
one with the documents that hold it and how often; all distinct ones of the
corpus are counted once, and join these frequencies.  Sums by document are all
that comes back: no ids are made.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, flat, span_hashes, text_chunks
from .sentencepiece_codec import take_spans

MODEL = "byte_bpe_50k.json"
BLOCK_BYTES, BLOCK_DOCS = 32 << 20, 1 << 16  #: of text, and documents, of a block
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255  #: kinds of characters
SHORT_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")  #: fixed values: what follows an apostrophe in a pre-token of its own
NO_TEXT = b"\xff"  #: a byte that UTF-8 doesn't have
ROW = "block long, piece binary, posts binary, times binary"


class Places:
    """Places of hashes among sorted distinct ones, entered through a table of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(24, max(8, len(keys).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> self.shift).astype(np.int64)
        at, end, left = self.first[slot], self.first[slot + 1], np.arange(len(h))
        while True:
            on = at < end
            at, end, left = at[on], end[on], left[on]
            if not len(left):
                return out
            same = self.keys[at] == h[left]
            out[left[same]] = at[same]
            at, end, left = at[~same] + 1, end[~same], left[~same]


class ByteLevel:
    """A byte-level BPE file of ``tokenizers``: kinds of characters, pieces and their counts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError(f"{path}: not a plain byte-level file")
        self.tok = Tokenizer.from_file(path)
        added = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens that take their surroundings")
        self.added = [t["content"].encode() for t in added]
        # letters that stand for bytes: printable ones for themselves, the others in order from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.letter = [""] * 256
        for b, c in [*zip(plain, plain, strict=True), *((b, 256 + k) for k, b in enumerate(rest))]:
            self.letter[b] = chr(c)
        byte = {c: b for b, c in enumerate(self.letter)}
        own = [bytes(byte[c] for c in p) for p in spec["model"]["vocab"] if all(c in byte for c in p)]
        self._known(own)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    def _known(self, pieces: list[bytes]) -> None:
        """Sorted hashes of the vocabulary's entries, and as how many tokens each counts by itself."""
        size = np.array([len(p) for p in pieces])
        end = np.cumsum(size)
        h = span_hashes(np.frombuffer(b"".join(pieces), np.uint8), end - size, end, lower=False)
        order = np.argsort(h)
        self.places, self.counts = Places(h[order]), np.array([self.count(p) for p in pieces])[order]

    def count(self, piece: bytes) -> int:
        return len(self.tok.model.tokenize("".join(map(self.letter.__getitem__, piece))))

    def kind(self, cps: np.ndarray) -> np.ndarray:
        k = self.kinds[cps]
        if (k == UNKNOWN).any():
            for c in np.unique(cps[k == UNKNOWN]).tolist():
                # which neighbours it shares a pre-token with
                ends = [b for _, (_, b) in self.tok.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}")], [b for _, (_, b) in self.tok.pre_tokenizer.pre_tokenize_str(f"1{chr(c)}")], [b for _, (_, b) in self.tok.pre_tokenizer.pre_tokenize_str(f"!{chr(c)}")]
                self.kinds[c] = next((kind for kind, e in zip((LETTER, NUMBER, OTHER), ends, strict=True) if len(e) == 1), SPACE)
            k = self.kinds[cps]
        return k

    def prepared(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return buf, off

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each pre-token, and the added tokens of each text."""
        added = np.zeros(len(off) - 1, np.int64)
        raw = buf.tobytes()
        breaks, holes = [off[:-1]], []
        at = 0
        while self.added:
            found = min(((k, -len(s)) for s in self.added if (k := raw.find(s, at)) >= 0), default=None)
            if found is None:
                break
            i, at = found[0], found[0] - found[1]
            doc = int(np.searchsorted(off, i, "right")) - 1
            if at > off[doc + 1]:  # across two texts
                at = i + 1
                continue
            added[doc] += 1
            holes.append((i, at))
            breaks.append(np.array([i, at]))
        cps = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        n = len(cps)
        place = np.concatenate([[0], np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000))])
        fresh = np.zeros(n + 1, bool)  # where a text begins, or what stands between added tokens
        fresh[np.searchsorted(place, np.unique(np.concatenate(breaks)))] = True
        fresh[n] = True
        start = fresh.copy()
        kind = self.kind(cps)
        start[1:n] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(start)
        first, last = at[:-1], at[1:]  # runs of one kind
        after = ~fresh[last] if len(first) else np.zeros(0, bool)  # whether another run follows in the text
        # the last space of a run that another follows stands alone, or before it if it is a plain one
        gap = (kind[first] == SPACE) & after
        tail = last[gap] - 1
        start[tail] = True
        plain = tail[cps[tail] == 32]
        start[plain + 1] = False
        # an apostrophe that begins a pre-token takes a short ending with it
        alone = (last - first == 1) & (cps[first] == 39) & after & start[first]
        for i in first[alone].tolist():
            word = raw[place[i + 1] : place[min(n, i + 3)]].decode()
            size = next((len(e) for e in SHORT_ENDINGS if word.startswith(e) and not fresh[i + 1 : i + 1 + len(e)].any()), 0)
            if size:
                start[i + 1] = False
                start[i + 1 + size] = True
        at = place[np.flatnonzero(start)]
        a, z = at[:-1], at[1:]
        if holes:
            keep = ~np.isin(a, [i for i, _ in holes])
            inside = np.zeros(len(a), bool)
            for i, j in holes:
                inside[np.searchsorted(a, i) : np.searchsorted(a, j)] = True
            keep &= ~inside
            a, z = a[keep], z[keep]
        return a, z, np.searchsorted(off, a, "right") - 1, added


class Pieces:
    """A SentencePiece file: a pre-token is a run that begins at a space and holds none further but at its beginning."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.places, self.counts = Places(np.zeros(0, np.uint64)), np.zeros(0, np.int64)

    def count(self, piece: bytes) -> int:
        encode = self.processor.encode
        if piece == b" ":  # alone it would be an empty text's
            return len(encode("a ")) - len(encode("a"))
        return len(encode(piece[1:].decode()))

    def prepared(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A space before each text that isn't empty, as the file's encoder has it."""
        size = np.diff(off)
        where = off[:-1][size > 0]
        return np.insert(buf, where, 32), np.concatenate([[0], np.cumsum(size + (size > 0))])

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start = np.zeros(len(buf) + 1, bool)
        space = buf == 32
        start[1:-1] = space[1:] & ~space[:-1]
        start[off] = True
        at = np.flatnonzero(start)
        return at[:-1], at[1:], np.searchsorted(off, at[:-1], "right") - 1, np.zeros(len(off) - 1, np.int64)


_LOADED: dict[str, ByteLevel | Pieces] = {}


def counter(model: str) -> ByteLevel | Pieces:
    """The file's pre-tokens and counts, read once for each worker."""
    if model not in _LOADED:
        import public_tokenizers

        path = public_tokenizers.path(model)
        _LOADED[model] = Pieces(path) if model.endswith(".model") else ByteLevel(path)
    return _LOADED[model]


class Block:
    """Some texts' pre-tokens beyond the vocabulary, and what else is known of the texts."""

    def __init__(self):
        self.bytes, self.ids, self.sizes, self.known = 0, [], [], []
        self.hashes, self.docs, self.firsts = [], [], []
        self.n = 0

    def add(self, ids: list, texts: pa.Array, counter: ByteLevel | Pieces) -> None:
        buf, off = flat(texts)
        self.ids += ids
        self.sizes.append(np.diff(off))
        self.bytes += len(buf)
        buf, off = counter.prepared(buf, off)
        a, z, doc, known = counter.cuts(buf, off)
        if len(a):
            h = span_hashes(buf, a, z, lower=False)
            at = counter.places.find(h)
            held = at >= 0
            known = known + np.bincount(doc[held], counter.counts[at[held]], len(off) - 1).astype(np.int64)
            a, z, doc, h = a[~held], z[~held], doc[~held], h[~held]
            distinct, index = np.unique(h, return_index=True)
            size = (z - a)[index]
            self.firsts.append((distinct, size, take_spans(buf, a[index], size)))
            self.hashes.append(h)
            self.docs.append((self.n + doc).astype(np.uint16))
        self.known.append(known)
        self.n += len(ids)

    def pieces(self) -> tuple[np.ndarray, list[bytes]]:
        """The distinct pre-tokens in their order, and their hashes."""
        if not self.firsts:
            return np.zeros(0, np.uint64), []
        h, size = (np.concatenate([f[k] for f in self.firsts]) for k in (0, 1))
        raw = np.concatenate([f[2] for f in self.firsts]).tobytes()
        end = np.cumsum(size)
        h, index = np.unique(h, return_index=True)
        pieces = [raw[i:j] for i, j in zip((end - size)[index].tolist(), end[index].tolist(), strict=True)]
        order = sorted(range(len(pieces)), key=pieces.__getitem__)  # neighbours are alike, which makes them short when shuffled
        return h[order], [pieces[i] for i in order]

    def posts(self, hashes: np.ndarray) -> tuple[list[bytes], list[bytes | None]]:
        """For each distinct pre-token its documents in the block, in 16 bits each, and how often each has it, in eight; none for once in all.  More than 255 times go into further places."""
        if not len(hashes):
            return [], []
        order = np.argsort(hashes)
        place = order[Places(hashes[order]).find(np.concatenate(self.hashes))]
        key, count = np.unique(place << 16 | np.concatenate(self.docs), return_counts=True)
        places = (count - 1) // 255 + 1
        key = np.repeat(key, places)
        n = np.full(len(key), 255)
        n[np.cumsum(places) - 1] = count - 255 * (places - 1)
        at = np.searchsorted(key >> 16, np.arange(len(hashes) + 1))
        often = np.add.reduceat(n > 1, at[:-1]) > 0
        docs, times, at = (key & 65535).astype("<u2").tobytes(), n.astype("u1").tobytes(), at.tolist()
        pairs = list(zip(at[:-1], at[1:], strict=True))
        return [docs[2 * i : 2 * j] for i, j in pairs], [times[i:j] if k else None for (i, j), k in zip(pairs, often.tolist(), strict=True)]

    def base(self) -> bytes:
        """Ids, whether they are null, bytes and known tokens of the texts."""
        null = np.array([i is None for i in self.ids], "<i8")
        ids = np.array([i or 0 for i in self.ids], "<i8")
        return np.concatenate([ids, null, *self.sizes, *self.known]).astype("<i8").tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[Block]:
    block, count = Block(), counter(model)
    for b in text_chunks(batches):
        for i in range(0, b.num_rows, BLOCK_DOCS // 4):
            part = b.slice(i, BLOCK_DOCS // 4)
            if block.n and (block.n + part.num_rows > BLOCK_DOCS or block.bytes > BLOCK_BYTES):
                yield block
                block = Block()
            block.add(part.column("doc_id").to_pylist(), part.column("text"), count)
    if block.n:
        yield block


def _distinct(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, model):
        yield pa.RecordBatch.from_arrays([pa.array(block.pieces()[1], pa.binary())], ["piece"])


def _counted(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    count = counter(model).count
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array([count(p) for p in b.column("piece").to_pylist()], pa.int64())], ["piece", "k"])


def _frequencies(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """A row for each block and distinct pre-token, and one for the block itself, whose piece no text can hold."""
    task, names = TaskContext.get().partitionId() << 32, ["block", "piece", "posts", "times"]
    for number, block in enumerate(_blocks(batches, model)):
        name = task | number
        hashes, pieces = block.pieces()
        posts, times = block.posts(hashes)
        for i in range(0, len(pieces), 50_000):
            j = min(len(pieces), i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, name)), *(pa.array(x[i:j], pa.binary()) for x in (pieces, posts, times))], names)
        yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.binary()) for x in (NO_TEXT + name.to_bytes(8, "little"), block.base(), None))], names)


def _partial(batches: Iterator[pa.RecordBatch], held: int = 64) -> Iterator[pa.RecordBatch]:
    """Sums of a task's pre-tokens for each block and document, of at most ``held`` blocks at a time; blocks' own rows as they are."""
    sums: dict[int, np.ndarray] = {}
    names = ["block", "own", "values"]

    def handed() -> pa.RecordBatch:
        at = [np.flatnonzero(s) for s in sums.values()]
        # a text has less than 2**32 tokens
        values = [i.astype("<u2").tobytes() + s[i].astype("<u4").tobytes() for i, s in zip(at, sums.values(), strict=True)]
        blocks = list(sums)
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([False] * len(blocks), pa.bool_()), pa.array(values, pa.binary())], names)

    for b in batches:
        own = b.filter(b.column("own"))
        if own.num_rows:
            yield pa.RecordBatch.from_arrays([own.column("block"), own.column("own"), own.column("posts")], names)
        b = b.filter(pc.invert(b.column("own")))
        if not b.num_rows:
            continue
        raw, off = flat(b.column("posts"))
        docs, size = np.frombuffer(raw.tobytes(), "<u2"), np.diff(off) // 2
        times = np.ones(len(docs), np.int64)
        some = np.asarray(b.column("times").is_valid())
        times[np.repeat(some, size)] = flat(b.column("times").drop_null())[0]
        block, tokens = np.repeat(np.asarray(b.column("block")), size), times * np.repeat(np.asarray(b.column("k")), size)
        order = np.argsort(block, kind="stable")
        distinct, at = np.unique(block[order], return_index=True)
        for name, i, j in zip(distinct.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            if name not in sums:
                if len(sums) == held:
                    yield handed()
                sums[name] = np.zeros(BLOCK_DOCS, np.int64)
            of = order[i:j]
            sums[name] += np.bincount(docs[of], tokens[of], BLOCK_DOCS).astype(np.int64)
    if sums:
        yield handed()


def _totals(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of each block's documents; a block's rows come in a run."""
    name, total, base = None, None, None

    def rows() -> pa.RecordBatch:
        ids, null, size, known = np.frombuffer(base, "<i8").reshape(4, -1)
        n = known + total[: len(ids)]
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null > 0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    for b in batches:
        for block, own, values in zip(*(b.column(c).to_pylist() for c in ("block", "own", "values")), strict=True):
            if block != name:
                if name is not None:
                    yield rows()
                name, total, base = block, np.zeros(BLOCK_DOCS, np.int64), None
            if own:
                base = values
            else:
                n = len(values) // 6
                total[np.frombuffer(values, "<u2", n)] += np.frombuffer(values, "<u4", n, 2 * n)
    if name is not None:
        yield rows()


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes`` (of UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each row of ``docs(doc_id, text)``.

    Tokens are those of the public file ``model``, without begin, end or
    further special tokens; strings of a byte-level file's added tokens count
    as these, as its library has it by default.  Null and empty texts have no
    bytes and no tokens.  Texts and pre-tokens of any length are counted whole;
    repeated rows and null ids give rows as often as they come; an empty table
    gives none.  ``docs`` is read twice, and has to give the same rows both
    times (a stored table does).  Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.select("doc_id", "text").mapInArrow(partial(_distinct, model=model), "piece binary").distinct()
    counts = pieces.mapInArrow(partial(_counted, model=model), "piece binary, k long")
    with arrow_rows(docs.sparkSession, 10_000):
        frequencies = docs.mapInArrow(partial(_frequencies, model=model), ROW)
        own = F.startswith("piece", F.lit(NO_TEXT)).alias("own")
        joined = frequencies.join(counts, "piece", "left").select("block", own, "posts", "times", "k")
        sums = joined.mapInArrow(_partial, "block long, own boolean, values binary")
        return sums.repartition("block").sortWithinPartitions("block").mapInArrow(partial(_totals, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
