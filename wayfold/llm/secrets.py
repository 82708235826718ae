"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Words are tagged as begin, inside or outside of a secret.  A word's features
are its shape, its leading letters, those of both neighbours, and the kind of
file it stands in.  The field is fitted to windows around the patterns'
matches, to windows elsewhere, and to excerpts with made-up secrets and things
that look like some, from a bounded sample of documents, and is decoded by Viterbi.  Stretches in which no path but "outside" can win are
found first, by running sums of upper bounds, and skipped; that is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, mix, span_hashes, text_chunks, words

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HINT = r"(?i)password|passwd|secret|token|api_?key"

TABLE, FEATURES = 1 << 14, 9
WINDOW = 20
PER_TEXT = 32  #: windows of a text around matches that the field is fitted to, evenly over the text
_DIGIT, _UPPER, _LOWER, _HIGH = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = _HIGH[128:] = True
_SIGN = ~(_DIGIT | _UPPER | _LOWER | _HIGH)
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_IS_HEX = np.zeros(256, bool)
_IS_HEX[48:58] = _IS_HEX[97:103] = True
_KIND_OF_BYTE = np.zeros(256, np.int8)
_KIND_OF_BYTE[_DIGIT], _KIND_OF_BYTE[_UPPER], _KIND_OF_BYTE[_LOWER], _KIND_OF_BYTE[_HIGH] = 1, 2, 3, 4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the fixed patterns' matches, by start, then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _may_match(texts: pa.Array, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts in which a fixed pattern may match."""
    may = np.asarray(pc.fill_null(pc.match_substring_regex(texts, _HINT), False).to_numpy(zero_copy_only=False), bool)
    may |= np.asarray(pc.fill_null(pc.match_substring(texts, "AKIA"), False).to_numpy(zero_copy_only=False), bool)
    if len(buf):
        ishex = _IS_HEX[buf]
        edge = np.zeros(len(buf) + 1, bool)  # a run ends where its text ends
        edge[off] = edge[0] = edge[-1] = True
        first = np.flatnonzero(ishex & (edge[:-1] | ~np.roll(ishex, 1)))
        last = np.flatnonzero(ishex & (edge[1:] | ~np.roll(ishex, -1)))
        may[np.searchsorted(off, first[last - first >= 23], "right") - 1] = True
    return may


def _level(x: np.ndarray, *at: float) -> np.ndarray:
    return np.searchsorted(np.array(at), x, "right")


def _files(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Kind of file of each text: its length, and its share of digits."""
    plain = np.diff(off)
    digits = np.diff(np.concatenate([[0], np.cumsum(_DIGIT[buf], dtype=np.int32)])[off])
    return _level(digits / np.maximum(1, plain), 0.002, 0.02, 0.1) * 4 + _level(plain, 200, 2000, 20000)


def _features(buf: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, file: np.ndarray | None = None) -> np.ndarray:
    """``FEATURES`` table places of each word; an excerpt is given the kind of ``file`` that it comes from."""
    level = _level
    upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
    turn = np.zeros(len(buf), bool)
    kind = _KIND_OF_BYTE[buf]
    turn[1:] = kind[1:] != kind[:-1]
    sums = [upto(x[buf]) for x in (_DIGIT, _UPPER, _LOWER, _HIGH, _VOWEL)]
    digit, upper, lower, high, vowel = (s[end] - s[start] for s in sums)
    t = upto(turn)
    turns = t[end] - t[np.minimum(start + 1, end)]
    size = end - start
    sign = size - digit - upper - lower - high
    share = lambda x: level(x / size, 0.001, 0.15, 0.4, 0.7, 0.95)
    length = level(size, 2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64)
    shape = ((length * 6 + share(digit)) * 6 + share(upper)) * 6 + share(lower)
    fine = (((length * 6 + level(turns, 1, 2, 3, 6, 10)) * 6 + share(vowel)) * 4 + level(sign, 1, 2, 4)) * 2 + (high > 0)
    # which kinds of signs a word has, whether it is long, mixed and hard to speak: what all made-up words share
    kinds = ((((digit > 0) * 2 + (upper > 0)) * 2 + (lower > 0)) * 2 + (high > 0)) * 3 + level(sign, 1, 4)
    broad = ((kinds * 4 + level(size, 12, 16, 24)) * 4 + level(turns / size, 0.12, 0.25, 0.45)) * 3 + level(vowel / size, 0.12, 0.3)
    # leading letters: up to the first byte that is none
    none = np.flatnonzero(np.append(~(_LOWER | _UPPER)[buf], True))
    stem_end = np.minimum(none[np.searchsorted(none, start)], end)
    skip = stem_end == start  # a quotation mark or other sign may come before them
    again = np.minimum(start + 1, end)
    stem_end = np.where(skip, np.minimum(none[np.searchsorted(none, again)], end), stem_end)
    stem = span_hashes(buf, np.where(skip, again, start), np.maximum(stem_end, np.where(skip, again, start)))
    file = _files(buf, off) if file is None else file
    before = lambda x: np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), x.dtype.type(0), np.roll(x, 1)) if len(x) else x
    after = lambda x: np.where(np.concatenate([doc[1:] != doc[:-1], [True]]), x.dtype.type(0), np.roll(x, -1)) if len(x) else x
    shape, fine = shape.astype(np.uint64), fine.astype(np.uint64)
    coarse = mix(length.astype(np.uint64) * np.uint64(8) + share(digit).astype(np.uint64))
    out = (shape, fine, stem, before(shape), after(shape), before(stem), mix(before(before(stem)) + before(fine)), file[doc].astype(np.uint64) * np.uint64(31) + coarse, broad.astype(np.uint64))
    return np.stack([(mix(x + np.uint64(1000003 * (k + 1))) % np.uint64(TABLE)).astype(np.int32) + k * TABLE for k, x in enumerate(out)], 1)


def _char_bytes(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Code points to bytes."""
    if text.isascii():
        return [(a, b) for _, a, b in spans]
    return [(len(text[:a].encode()), len(text[:b].encode())) for _, a, b in spans]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and tags of windows around each span, of another one of each text, and of two excerpts of it with something made up."""
    for b in text_chunks(batches):
        texts = b.column("text")
        buf, off = flat(texts)
        start, end, doc = words(buf, off)
        if not len(start):
            continue
        x = _features(buf, off, start, end, doc)
        tags = np.full(len(start), 2, np.int8)
        woff = np.searchsorted(doc, np.arange(len(off)))
        centres: list[int] = []
        for d in np.flatnonzero(_may_match(texts, buf, off)):
            text = texts[int(d)].as_py()
            spans, own = base_spans(text), []
            for lo, hi in _char_bytes(text, spans):
                i, j = np.searchsorted(end, off[d] + lo, "right"), np.searchsorted(start, off[d] + hi)
                tags[i:j] = np.where(tags[i:j] == 0, 0, 1)
                tags[i] = 0 if i == 0 or tags[i - 1] == 2 or doc[i - 1] != d else tags[i]
                own.append((i + j) // 2)
            centres += own if len(own) <= PER_TEXT else [own[k * len(own) // PER_TEXT] for k in range(PER_TEXT)]
        filled = np.flatnonzero(np.diff(woff))
        centres += (woff[filled] + (np.diff(woff)[filled] * 0.6)).astype(int).tolist()
        keep = []
        for c in centres:
            d = doc[c]
            lo = max(woff[d], min(c - WINDOW // 2, woff[d + 1] - WINDOW))
            hi = min(woff[d + 1], lo + WINDOW)
            keep.append((x[lo:hi].tobytes(), tags[lo:hi].tobytes()))
        keep += _planted(texts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.binary()), pa.array([k[1] for k in keep], pa.binary())], ["x", "tags"])


_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
_NAMES = ("password", "pwd", "auth", "key", "access_key", "client_secret", "bearer", "credential", "private_key")


def _made_up(seed: int) -> tuple[str, bool]:
    """A made-up secret, or something like one that is none (a number, a mail or web address, an identifier)."""
    rng = np.random.default_rng(seed)
    pick = lambda signs, n: "".join(signs[i] for i in rng.integers(0, len(signs), n))
    if rng.random() < 0.35:
        word, number = pick(_ALPHABETS[2][:26], rng.integers(3, 9)), pick("0123456789", rng.integers(1, 20))
        return (number, f"{word}.{number[:3]}@{word}.example.com", f"https://www.{word}.com/{word}/{number[:6]}.html", f"{word}_{word}", f"{word.title()}{word.title()}", f"{word}{number[:2]}", f"{number[:4]}-{number[4:6]}-{number[6:8]}")[rng.integers(0, 7)], False
    value = ("", "", "sk_", "ghp_", "tok-", "xox-")[rng.integers(0, 6)] + pick(_ALPHABETS[rng.integers(0, len(_ALPHABETS))], rng.integers(16, 56))
    quote = ("", "", '"', "'")[rng.integers(0, 4)]
    name = _NAMES[rng.integers(0, len(_NAMES))] if rng.random() < 0.3 else ""
    return (name + ("=", ": ", " = ", " ")[rng.integers(0, 4)] if name else "") + quote + value + quote, True


def _planted(texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """Features and tags of excerpts into which something made up was put."""
    for text in texts.to_pylist():
        some = (text or "").split()
        if len(some) < 4:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        file = _files(raw, np.array([0, len(raw)]))
        seed = int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
        for turn in range(2):
            at = (seed >> 7 * turn) % (len(some) - 2)
            part = some[at : at + WINDOW - 4]
            middle = len(part) * (seed >> 32 + 8 * turn & 255) // 256
            new, secret = _made_up(seed + turn)
            put = new.split()
            buf, off = flat(pa.array([" ".join(part[:middle] + put + part[middle:])]))
            start, end, doc = words(buf, off)
            if len(start) != len(part) + len(put):
                continue  # other white space divides a word of the excerpt
            tags = np.full(len(start), 2, np.int8)
            if secret:
                tags[middle : middle + len(put)] = 1
                tags[middle] = 0
            yield _features(buf, off, start, end, doc, file)[:WINDOW].tobytes(), tags[:WINDOW].tobytes()


def _drawn(docs: DataFrame, draw: int, sample: int) -> DataFrame:
    """Ids of at most ``sample`` documents with a pattern's word, and of as many others, among about ``draw`` documents of the smallest hash of doc_id.

    The hash goes first, so that only the texts of the draw are searched; what
    is ranked after it has no more than about ``draw`` rows, whatever the table's size.
    """
    share = min(1.0, draw / max(1, docs.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 24)
    few = docs.where(F.col("doc_id").isNotNull() & (place < int(share * (1 << 40))))
    hint = F.coalesce(F.col("text").rlike(r"AKIA|[0-9a-f]{24}|" + _HINT.replace("(?i)", "(?i:") + ")"), F.lit(False))
    ranked = few.select("doc_id", hint.alias("hint"), place.alias("place")).distinct()
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("hint").orderBy("place", "doc_id")))
    return ranked.where(f"r <= {sample}").select("doc_id").distinct()


def fit(docs: DataFrame, sample: int = 4000, windows: int = 8000, steps: int = 150, draw: int = 200_000, ridge: float = 1e-5) -> dict[str, np.ndarray]:
    """Field from ``sample`` documents in which a pattern's word occurs and as many others, among about ``draw`` of the smallest hash of doc_id, and at most ``windows`` of their windows (``PER_TEXT`` of one text)."""
    chosen = F.broadcast(_drawn(docs, draw, sample))  # 2 * sample ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text").mapInArrow(_windows, "x binary, tags binary")
    rows = rows.orderBy(F.xxhash64("x", "tags")).limit(windows).collect()
    weights, moves = np.zeros((FEATURES * TABLE, 3), np.float32), np.zeros((3, 3), np.float32)
    weights[:TABLE, 2] = 1  # outside, if nothing is learnt
    moves[2, 1] = -50  # inside never follows outside
    rows.sort(key=lambda r: (bytes(r[1]), bytes(r[0])))
    n = len(rows)
    if not any(b"\0" in bytes(r[1]) for r in rows):
        return {"weights": weights, "moves": moves}
    x = np.full((n, WINDOW, FEATURES), -1, np.int32)
    y, size = np.full((n, WINDOW), 2, np.int64), np.zeros(n, int)
    for i, r in enumerate(rows):
        size[i] = len(r[1])
        x[i, : size[i]] = np.frombuffer(r[0], np.int32).reshape(-1, FEATURES)
        y[i, : size[i]] = np.frombuffer(r[1], np.int8)
    used, place = np.unique(x, return_inverse=True)
    place = place.reshape(n * WINDOW, FEATURES)
    real = (np.arange(WINDOW) < size[:, None]).ravel()
    gold = np.zeros((n, WINDOW, 3), np.float32)
    np.put_along_axis(gold, y[:, :, None], 1, 2)
    gold_moves = np.zeros((3, 3))
    for t in range(1, WINDOW):
        on = t < size
        np.add.at(gold_moves, (y[on, t - 1], y[on, t]), 1)
    w = np.zeros((len(used), 3), np.float32)
    m, s, ma, sa = np.zeros_like(w), np.zeros_like(w), np.zeros((3, 3)), np.zeros((3, 3))
    allowed = np.ones((3, 3), bool)
    allowed[2, 1] = False
    rng = np.random.default_rng(31)
    for step in range(1, steps + 1):
        rate = 0.3 if step < steps // 2 else 0.1
        # a third of the features at a time, so that none leans on letters or neighbours that it has learnt by heart
        some = rng.choice(FEATURES, FEATURES // 3, replace=False)
        now = place[:, some]
        e = np.where(real[:, None], w[now].sum(1) * (FEATURES / len(some)), 0).reshape(n, WINDOW, 3)
        tr = np.exp(np.where(allowed, moves, -50))
        alpha, scale = np.zeros_like(e), np.zeros((n, WINDOW))
        ex = np.exp(e - e.max(2, keepdims=True))
        for t in range(WINDOW):
            a = ex[:, t] if t == 0 else (alpha[:, t - 1] @ tr) * ex[:, t]
            if t == 0:
                a = a * np.array([1, 1e-9, 1], np.float32)
            scale[:, t] = a.sum(1)
            alpha[:, t] = a / scale[:, t, None]
        beta, expected = np.ones((n, 3)), np.zeros((3, 3))
        post = np.zeros_like(e)
        for t in range(WINDOW - 1, -1, -1):
            p = alpha[:, t] * beta
            post[:, t] = p / p.sum(1, keepdims=True)
            if t:
                right = ex[:, t] * beta
                on = t < size
                pair = alpha[on, t - 1][:, :, None] * tr * right[on][:, None, :]
                expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                beta = right @ tr.T
                beta = np.where((t < size)[:, None], beta / beta.sum(1, keepdims=True), 1)
        g = ((post - gold).reshape(-1, 3) * real[:, None]) / n
        grad = np.stack([np.bincount(now.ravel(), np.repeat(g[:, k], len(some)), len(used)) for k in range(3)], 1).astype(np.float32) + ridge * w
        grad_moves = (expected - gold_moves) / n
        for theta, d, mm, ss in ((w, grad, m, s), (moves, grad_moves, ma, sa)):
            mm += 0.1 * (d - mm)
            ss += 0.01 * (d**2 - ss)
            theta -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-8)
        moves[2, 1] = -50
    weights[:] = 0
    weights[used[used >= 0]] = w[used >= 0]
    return {"weights": weights, "moves": moves}


def decode(scores: np.ndarray, moves: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Best tags of all words; a text begins and ends outside."""
    n = len(scores)
    tags = np.full(n, 2, np.int8)
    if not n:
        return tags
    rel = moves - moves[2, 2]
    most = float(rel.max())
    gain = scores[:, :2].max(1) - scores[:, 2] + max(0.0, most)
    gain = gain.astype(float)
    c = np.concatenate([[0.0], np.cumsum(gain)])
    left = c[1:] - np.minimum.accumulate(c)[:-1]
    right = np.maximum.accumulate(c[::-1])[::-1][1:] - c[:-1]
    open_ = np.flatnonzero(left + right - gain + max(0.0, most) > 0)
    if not len(open_):
        return tags
    split = np.flatnonzero((np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])) + 1
    for run in np.split(open_, split):
        s = scores[run].astype(float)
        best, back = s[0] + moves[2], []
        for t in range(1, len(run)):
            to = best[:, None] + moves
            back.append(to.argmax(0))
            best = to.max(0) + s[t]
        k = int((best + moves[:, 2]).argmax())
        path = [k]
        for b in reversed(back):
            path.append(k := int(b[k]))
        tags[run] = path[::-1]
    return tags


_TRIM = b"\"'`.,;:()[]{}<>!?"


def _scan(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray], redact: str | None) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    weights, moves = model["weights"], model["moves"]
    for b in text_chunks(batches):
        texts = b.column("text")
        buf, off = flat(texts)
        start, end, doc = words(buf, off)
        spans: list[list[tuple[str, int, int]]] = [[] for _ in range(b.num_rows)]
        for d in np.flatnonzero(_may_match(texts, buf, off)):
            spans[d] = base_spans(texts[int(d)].as_py())
        if len(start):
            x = _features(buf, off, start, end, doc)
            scores = weights[x[:, 0]]
            for k in range(1, FEATURES):
                scores = scores + weights[x[:, k]]
            tags = decode(scores, moves, doc)
            i = np.flatnonzero(tags != 2)
            begins = [k for k in i.tolist() if tags[k] == 0 or k == 0 or tags[k - 1] == 2 or doc[k - 1] != doc[k]]
            for k in begins:
                j, d = k + 1, int(doc[k])
                while j < len(tags) and tags[j] == 1 and doc[j] == d:
                    j += 1
                lo, hi = int(start[k]), int(end[j - 1])
                while lo < hi and buf[lo] in _TRIM:
                    lo += 1
                while lo < hi and buf[hi - 1] in _TRIM:
                    hi -= 1
                if lo == hi:
                    continue
                raw = buf[off[d] : hi].tobytes()
                a = len(raw[: lo - off[d]].decode("utf-8", "replace"))
                z = a + len(raw[lo - off[d] :].decode("utf-8", "replace"))
                if not any(p < z and a < q for _, p, q in spans[d]):
                    spans[d].append(("crf", a, z))
        for s in spans:
            s.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        columns = list(b.columns)
        if redact is not None:
            out = texts.to_pylist()
            for d, found in enumerate(spans):
                for _, a, z in reversed(_merged(found)):
                    out[d] = out[d][:a] + redact + out[d][z:]
            columns[b.schema.get_field_index("text")] = pa.array(out, pa.string())
        listed = pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in s] for s in spans], kind)
        yield pa.RecordBatch.from_arrays([*columns, listed], [*b.schema.names, "spans"])


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for k, a, z in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(z, out[-1][2]))
        else:
            out.append((k, a, z))
    return out


def secret_scan(docs: DataFrame, redact: str | None = None, sample: int = 4000) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` with ``spans``: array of (kind, start, end) in code points, by start, then kind.

    The fixed patterns' kinds are ``assign``, ``access`` and ``hex``; ``crf``
    spans are those which the field adds, and overlap none of the others.  With
    ``redact`` that string takes the place of each span, overlapping ones as
    one.  Null and empty texts have no span, very long ones are scanned whole;
    repeated rows give repeated rows, an empty table none.  A column ``spans``
    that is there before is replaced.
    """
    docs = docs.drop("spans").withColumn("text", F.col("text").cast("string"))
    model = fit(docs.select("doc_id", "text"), sample)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(partial(_scan, model=model, redact=redact), schema + ", spans array<struct<kind:string,start:int,end:int>>")


def digest(rows: DataFrame) -> DataFrame:
    """Counts, hash of the fixed patterns' spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
