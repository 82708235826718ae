"""Alignment of the tokens that two tokenizers give the same text, by a dangling-suffix transducer.

The transducer's state is the side that leads and the bytes of its last token
that the other side has not matched yet; the other side gives the next token.
A transition depends on nothing else, and is remembered by residual and token.
An empty residual closes a group.  Texts are read in units that begin at a
space after another character, where both sides have a boundary in any case;
a unit that has come before in a worker is not aligned again.

What a document's links count corpus-wide comes by request: a block of texts
hands on each of its distinct pairs once, with the number of its documents that
hold it; sums over all blocks go back to the blocks that asked.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, small, text_chunks
from .packing import encoder
from .pieces import SPACE, vocabulary
from .sentencepiece_codec import piece_texts, take_spans

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16  #: of text, and documents, of a block
UNITS, LONG_UNIT = 300_000, 256  #: units that a worker remembers; characters from which one is not kept
TRANSITIONS = 2_000_000  #: that a worker remembers
ODD_SPACE = re.compile(r"\s ")
SHIFT = 32  #: a pair is its A id, shifted by so many bits, and its B id


def units(text: str) -> list[str]:
    """Parts of a text between the spaces that follow another character than white space; a space stands before the text, too."""
    parts = text.split(" ")
    if not (text.startswith(" ") or ODD_SPACE.search(text)):
        return parts
    out, now = [], parts[0]
    for p in parts[1:]:
        if not now or now[-1].isspace():
            now += " " + p
        else:
            out.append(now)
            now = p
    return [*out, now]


class Transducer:
    """State 0 has no residual; every other one a side that leads (0 or 1) and the bytes that the other has not matched."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = a_bytes, b_bytes
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple[int, bytes], int] = {(1, b""): 0}
        self.lead, self.residual = array("b", [1]), [b""]  # with none, side 0 is the next to give a token
        self.memo: dict[int, int] = {}  # by state, shifted, and token

    def _number(self, side: int, residual: bytes) -> int:
        key = (side, residual) if residual else (1, b"")
        if key not in self.numbers:
            self.numbers[key] = len(self.lead)
            self.lead.append(side)
            self.residual.append(residual)
        return self.numbers[key]

    def step(self, state: int, token: int) -> int:
        """State after the side that lags gives ``token``, or -1 where its bytes are others than the residual's."""
        side, left = 1 - self.lead[state], self.residual[state]
        new = self.bytes[side][token]
        if len(new) <= len(left):
            after = self._number(1 - side, left[len(new) :]) if left.startswith(new) else -1
        else:
            after = self._number(side, new[len(left) :]) if new.startswith(left) else -1
        self.memo[state << SHIFT | token] = after
        return after

    def _steps(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """State of each unit after its next token: transitions are looked up once for each different one."""
        key, inverse = np.unique(state << SHIFT | token, return_inverse=True)
        memo = self.memo
        after = [memo.get(k) for k in key.tolist()]
        for i, v in enumerate(after):
            if v is None:
                after[i] = self.step(int(key[i]) >> SHIFT, int(key[i]) & ((1 << SHIFT) - 1))
        return np.array(after, np.int64)[inverse]

    def align(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """All units at once, a token of each at a time.  Whether each unit's bytes are the same on both sides; unit, A id and B id of the links between tokens that share a byte; unit, and places in ``a`` and ``b`` of the ends of the groups."""
        if len(self.memo) > TRANSITIONS:
            self.forget()
        n = len(a_ends)
        at = np.stack([np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])])
        ends, tokens = np.stack([a_ends, b_ends]), (np.append(a, 0), np.append(b, 0))
        state, ahead, same = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        live = np.flatnonzero((at < ends).any(0))
        links, groups = [[np.zeros(0, np.int64)] * 3], [[np.zeros(0, np.int64)] * 3]
        while len(live):
            lead = np.array(self.lead)
            now = state[live]
            side = 1 - lead[now]
            place = at[side, live]
            out = place >= ends[side, live]  # the side that should go on has no token left
            same[live[out]] = False
            live, now, side, place = live[~out], now[~out], side[~out], place[~out]
            token = np.where(side == 0, tokens[0][np.minimum(place, len(a))], tokens[1][np.minimum(place, len(b))])
            after = self._steps(now, token)
            at[side, live] += 1
            on = after >= 0
            same[live[~on]] = False
            live, now, side, token, after = live[on], now[on], side[on], token[on], after[on]
            linked = now > 0
            other = ahead[live]
            links.append([live[linked], np.where(side == 0, token, other)[linked], np.where(side == 0, other, token)[linked]])
            state[live] = after
            closed = after == 0
            groups.append([live[closed], *at[:, live[closed]]])
            forward = ~closed & (np.array(self.lead)[after] == side)
            ahead[live[forward]] = token[forward]
            live = live[(at[:, live] < ends[:, live]).any(0)]
        same &= state == 0
        return same, *(tuple(np.concatenate(c)[order] for c in zip(*found, strict=True)) for found in (links, groups) if (order := np.argsort(np.concatenate([f[0] for f in found]), kind="stable")) is not None)


class Aligner:
    """Units as they come: tokens of both sides, groups and pairs of each, remembered by the unit's text."""

    def __init__(self, a_model: str, b_model: str):
        self.a = encoder(a_model)
        vocab = vocabulary(b_model)
        self.b = vocab.processor
        blob, size = piece_texts(vocab)
        raw, end = blob.tobytes(), np.cumsum(size).tolist()
        b_bytes = [raw[i:j] for i, j in zip([0, *end[:-1]], end, strict=True)]
        a_bytes = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        self.sizes = np.array([len(x) for x in a_bytes]), size
        self.transducer = Transducer(a_bytes, b_bytes)
        # each id as text, followed by each sign
        signed = [f"{i}{sign}".encode() for i in range(max(len(a_bytes), len(b_bytes))) for sign in ",|;"]
        self.text, self.text_size = np.frombuffer(b"".join(signed), np.uint8), np.array([len(t) for t in signed])
        self.text_start = np.cumsum(self.text_size) - self.text_size
        # a piece with a space within could join two units: then texts are whole units
        self.parted = not any(SPACE in t.lstrip(SPACE) for t in vocab.texts)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.unlike: set[int] = set()  # whose bytes are not the same on both sides
        self.n_a, self.n_b, self.n_groups = array("q"), array("q"), array("q")
        self.links, self.ends = array("q"), array("q", [0])  # numbers of the pairs of each unit's links
        self.numbers: dict[int, int] = {}
        self.pairs = array("q")

    def units(self, text: str) -> list[str]:
        return units(text) if self.parted else [text]

    def _ends(self, ids: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Tokens up to each of the bytes where a unit ends; none if a token crosses one."""
        at = np.cumsum(size[ids])
        cuts = np.searchsorted(at, ends)
        if len(at) != cuts[-1] + 1 or (at[cuts] != ends).any():
            return None
        return cuts + 1

    def encoded(self, new: list[str]) -> tuple[list[str], tuple[np.ndarray, ...]]:
        """The units in an order, and both sides' tokens with each unit's end among them; its space comes first.  Units that end in white space, or are long, are encoded alone; the others many at once."""
        alone = [u for u in new if not u or u[-1].isspace() or len(u) >= LONG_UNIT or "▁" in u]
        apart = set(alone)
        many = [u for u in new if u not in apart]
        done, found = [], []
        for i in range(0, len(many), 512):
            some = many[i : i + 512]
            text = " ".join(some)
            a, b = np.array(self.a.encode_ordinary(" " + text)), np.array(self.b.encode(text))
            ends = np.cumsum([1 + len(u.encode()) for u in some])
            a_ends, b_ends = self._ends(a, self.sizes[0], ends), self._ends(b, self.sizes[1], ends)
            if a_ends is None or b_ends is None:
                alone += some
            else:
                done += some
                found.append((a, a_ends, b, b_ends))
        for u in alone:
            # a space alone would be an empty text's
            b = self.b.encode(u) if u else self.b.encode("a ")[len(self.b.encode("a")) :]
            a, b = np.array(self.a.encode_ordinary(" " + u), np.int64), np.array(b, np.int64)
            done.append(u)
            found.append((a, np.array([len(a)]), b, np.array([len(b)])))
        out = []
        for k in (0, 2):
            shift = np.cumsum([0, *(len(f[k]) for f in found[:-1])])
            out += [np.concatenate([f[k] for f in found]), np.concatenate([f[k + 1] + n for f, n in zip(found, shift.tolist(), strict=True)])]
        return done, tuple(out)

    def learn(self, new: list[str]) -> None:
        """Align the units and remember what comes of it."""
        if not new:
            return
        done, (a, a_ends, b, b_ends) = self.encoded(new)
        same, (unit, x, y), groups = self.transducer.align(a, a_ends, b, b_ends)
        n = len(done)
        if not same.all():  # others have no tokens
            keep = [np.repeat(same, np.diff(ends, prepend=0)) for ends in (a_ends, b_ends)]
            gone = [np.concatenate([[0], np.cumsum(~k)]) for k in keep]
            on = same[groups[0]]
            groups = groups[0][on], groups[1][on] - gone[0][groups[1][on]], groups[2][on] - gone[1][groups[2][on]]
            on = same[unit]
            unit, x, y = unit[on], x[on], y[on]
            a, b, a_ends, b_ends = a[keep[0]], b[keep[1]], a_ends - gone[0][a_ends], b_ends - gone[1][b_ends]
        # groups of both sides' ids in their order, as text: each id with the sign that follows it
        _, a_stop, b_stop = groups
        a_size, b_size = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        item = np.empty(len(a) + len(b), np.int64)
        sign = np.zeros(len(item), np.int64)
        item[np.arange(len(a)) + np.repeat(b_stop - b_size, a_size)] = a
        item[np.arange(len(b)) + np.repeat(a_stop, b_size)] = b
        sign[a_stop + b_stop - b_size - 1] = 1
        sign[a_stop + b_stop - 1] = 2
        item = 3 * item + sign
        size = self.text_size[item]
        raw = take_spans(self.text, self.text_start[item], size).tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], a_ends + b_ends])].tolist()
        self.index.update(zip(done, range(len(self.groups), len(self.groups) + n), strict=True))
        self.unlike.update((len(self.groups) + np.flatnonzero(~same)).tolist())
        self.groups += [raw[i:j] for i, j in itertools.pairwise(at)]
        for column, values in ((self.n_a, np.diff(a_ends, prepend=0)), (self.n_b, np.diff(b_ends, prepend=0)), (self.n_groups, np.bincount(groups[0], minlength=n))):
            column.frombytes(values.astype(np.int64).tobytes())
        keys, inverse = np.unique(x << SHIFT | y, return_inverse=True)
        numbers = []
        for key in keys.tolist():
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.pairs)
                self.pairs.append(key)
            numbers.append(number)
        self.ends.frombytes((len(self.links) + np.cumsum(np.bincount(unit, minlength=n))).astype(np.int64).tobytes())
        self.links.frombytes(np.array(numbers, np.int64)[inverse].tobytes())

    def texts(self, texts: list[str | None]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        """Counts and digest of each text; and text, pair number and occurrences of each text's distinct pairs."""
        parts = [self.units(t) if t else [] for t in texts]
        new = set().union(*parts) - self.index.keys()
        self.learn(list(new))
        own = [list(map(self.index.__getitem__, p)) for p in parts]
        digests = []
        for k, p in enumerate(own):
            if not p or not self.unlike.isdisjoint(p):
                own[k] = []
                digests.append("")
            else:
                digests.append(hashlib.sha256(b"".join(map(self.groups.__getitem__, p))[:-1]).hexdigest())
        for u in [u for u in new if len(u) >= LONG_UNIT]:
            self.groups[self.index.pop(u)] = b""  # not kept
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in own])
        unit = np.fromiter(chain.from_iterable(own), np.int64, len(doc))
        n_a, n_b, n_groups = (np.bincount(doc, np.array(n)[unit], len(texts)).astype(np.int64) if len(unit) else np.zeros(len(texts), np.int64) for n in (self.n_a, self.n_b, self.n_groups))
        ends = np.array(self.ends)
        size = (ends[1:] - ends[:-1])[unit]
        linked = take_spans(np.array(self.links), ends[unit], size)
        key, count = np.unique(np.repeat(doc, size) << SHIFT | linked, return_counts=True)
        columns = [pa.array(x) for x in (n_a, n_b, n_groups, np.bincount(doc, size, len(texts)).astype(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests)], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]), key >> SHIFT, key & ((1 << SHIFT) - 1), count


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(a_model: str, b_model: str) -> Aligner:
    if (a_model, b_model) not in _LOADED:
        _LOADED[a_model, b_model] = Aligner(a_model, b_model)
    return _LOADED[a_model, b_model]


BLOCK = "block long, pairs array<long>, holders array<long>, docs binary"


class Block:
    """Rows of some texts, with the pairs of each."""

    def __init__(self):
        self.rows, self.doc, self.pair, self.count, self.n, self.bytes = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array, aligner: Aligner) -> None:
        batch, doc, pair, count = aligner.texts(texts.to_pylist())
        self.rows.append(pa.RecordBatch.from_arrays([ids, *batch.columns], ["doc_id", *batch.schema.names]))
        self.doc.append(self.n + doc)
        self.pair.append(pair)
        self.count.append(count)
        self.n += len(ids)
        self.bytes += texts.nbytes

    def row(self, name: int, aligner: Aligner) -> pa.RecordBatch:
        """Its distinct pairs, how many of its documents hold each, and the documents' rows; these have their pairs as steps among the block's."""
        doc, pair, count = (np.concatenate(x) for x in (self.doc, self.pair, self.count))
        distinct, place, holders = np.unique(pair, return_inverse=True, return_counts=True)
        step = np.diff(place, prepend=0)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        step[first] = place[first]
        off = pa.array(np.searchsorted(doc, np.arange(self.n + 1)), pa.int32())
        docs = pa.Table.from_batches(self.rows).combine_chunks()
        docs = docs.append_column("steps", pa.ListArray.from_arrays(off, pa.array(step, pa.int32()))).append_column("times", pa.ListArray.from_arrays(off, pa.array(count, pa.int32())))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(docs)
        pairs = np.array(aligner.pairs, np.int64)[distinct]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (pairs, holders)]
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *lists, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "pairs", "holders", "docs"])


def _blocks(batches: Iterator[pa.RecordBatch], a_model: str, b_model: str) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId() << 32, 0
    block, own = Block(), aligner(a_model, b_model)
    for b in text_chunks(batches):
        for i in range(0, b.num_rows, BLOCK_DOCS // 4):
            part = b.slice(i, BLOCK_DOCS // 4)
            if block.n and (block.n + part.num_rows > BLOCK_DOCS or block.bytes > BLOCK_BYTES or len(own.groups) > UNITS):
                yield block.row(task | number, own)
                block, number = Block(), number + 1
                if len(own.groups) > UNITS:
                    own.forget()
            block.add(part.column("doc_id"), part.column("text"), own)
    if block.n:
        yield block.row(task | number, own)


ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each block's documents.  Counts of its pairs come first, in their order, then the block itself."""
    counts, best = [], []
    for b in batches:
        last = np.flatnonzero(np.asarray(b.column("docs").is_valid()))
        for i, j in zip([0, *(last + 1).tolist()], [*last.tolist(), b.num_rows], strict=True):
            counts.append(np.asarray(b.column("documents").slice(i, j - i)))
            best.append(np.asarray(b.column("best").slice(i, j - i)).astype(bool))
            if j == b.num_rows:
                break
            documents, greatest = np.concatenate(counts).astype(np.int64), np.concatenate(best)
            counts, best = [], []
            docs = pa.ipc.open_stream(b.column("docs")[j].as_buffer()).read_all().combine_chunks()
            steps, size = docs["steps"].combine_chunks().flatten().to_numpy().astype(np.int64), docs["steps"].combine_chunks().value_lengths().to_numpy()
            times = docs["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
            total = np.cumsum(steps)
            start = np.cumsum(size) - size
            before = np.where(start > 0, total[np.maximum(start, 1) - 1] if len(total) else 0, 0)
            place, doc = total - np.repeat(before, size), np.repeat(np.arange(docs.num_rows), size)
            sums = np.zeros((2, docs.num_rows), np.int64)
            np.add.at(sums[0], doc, times * greatest[place])
            np.add.at(sums[1], doc, times * documents[place])
            named = [docs[c].combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*named, pa.array(sums[0]), pa.array(sums[1]), docs["groups_sha256"].combine_chunks()], [c.split()[0] for c in ROW.split(", ")])


def alignment(docs: DataFrame, a_model: str = A_MODEL, b_model: str = B_MODEL) -> DataFrame:
    """How the tokens of a byte-level file (A) and of a SentencePiece file (B) lie on each row of ``docs(doc_id, text)``.

    Both encode a space and the text, without special tokens.  Returns
    ``doc_id``, ``n_a`` and ``n_b`` (tokens), ``n_groups`` (parts between places
    where tokens of both end), ``n_links`` (pairs of tokens that share a byte),
    ``n_best`` (links whose pair of ids is held by as many documents as any pair
    of its A id), ``count_sum`` (documents that hold a link's pair, over all
    links) and ``groups_sha256`` (of the groups' ids).

    Null and empty texts, and those whose bytes one of the two changes, have no
    tokens: zeros, and an empty digest.  Very long texts and words are aligned
    whole; rows that repeat an id or a text are documents of their own; null
    ids come back; an empty table gives no rows.  Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 10_000):
        blocks = cut(docs.mapInArrow(partial(_blocks, a_model=a_model, b_model=b_model), BLOCK))
        asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("pos", "x")).select("block", "pos", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders"))
        counts = cut(asked.groupBy("pair").agg(F.sum("holders").alias("documents")))
        a = F.shiftright("pair", SHIFT).alias("a")
        # at most a row for each of A's ids
        greatest = small(cut(counts.groupBy(a).agg(F.max("documents").alias("most"))))
        counts = counts.withColumn("a", a).join(greatest, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))
        answers = asked.select("block", "pos", "pair").join(counts, "pair").select("block", "pos", "documents", "best")
        both = answers.unionByName(blocks.select("block", F.lit(2**31 - 1).alias("pos"), "docs"), allowMissingColumns=True)
        return cut(both.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(_answered, ROW))
