"""Alignment, token counts and hard negatives against plain versions; odd rows and empty tables."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import alignment, hard_negatives, token_counts

SF = "/root/testdata/sf0.001"
ODD = [
    (None, "x"), (9001, None), (9002, ""), (9003, "zqxé" * 5000), (9004, "zqxv " * 3000), (9004, "zqxv " * 3000), (9005, "<|endoftext|> a<|endoftext|>"), (9006, " two  spaces\n\n x "), (9007, "a▁b c"),
    (9008, "日本語 𝄞 😀\ttab\n"), (9009, "   "), (9010, "　 x   y\x00 \x85 z"), (9011, "\n"), (9012, "x\n y"), (9013, "it's 'll x'sa ''s 're!'d ́ ½²٣"), (9014, "<|endof" + "w" * 700 + " text|>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents and odd rows, with further columns of clashing names."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame(ODD, d.schema))
    return d.selectExpr("doc_id", "text", "'x' AS block", "1 AS pos", "text AS piece", "0 AS k", "'y' AS documents", "2 AS n_tokens", "3 AS pair")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---------------------------------------------------------------- token counts


def test_counts_equal_the_libraries(docs, texts, libraries):
    tok, sp = libraries
    for model, count in (("byte_bpe_50k.json", lambda t: len(tok.encode(t, add_special_tokens=False).ids)), ("piece_bpe_32k.model", lambda t: len(sp.encode(t)))):
        want = [(i, len((t or "").encode()), n := count(t or ""), n > 512) for i, t in texts]
        same([tuple(r) for r in token_counts.token_counts(docs, model).collect()], want)
    assert token_counts.token_counts(docs.where("false")).count() == 0


def test_small_blocks_and_often_repeated_pieces(spark, libraries, monkeypatch):
    tok, _ = libraries
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["zqx", "wvq", "the", "qqz"], 900)) for _ in range(7)] + ["zqx " * 70_000]
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 4000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    blocks = list(token_counts._blocks(iter([batch.slice(i, 1) for i in range(len(texts))]), "byte_bpe_50k.json"))
    assert len(blocks) > 3
    counter, got = token_counts.counter("byte_bpe_50k.json"), collections.Counter()
    for block in blocks:
        hashes, pieces = block.pieces()
        assert pieces == sorted(set(pieces))
        for piece, raw, times in zip(pieces, *block.posts(hashes), strict=True):
            at = np.frombuffer(raw, "<u2")
            n = np.frombuffer(times, "u1") if times else np.ones(len(at), int)
            for d, k in zip(at.tolist(), n.tolist(), strict=True):
                got[block.ids[d]] += k * counter.count(piece)
        ids, null, _, known = np.frombuffer(block.base(), "<i8").reshape(4, -1)
        assert not null.any()
        for i, k in zip(ids.tolist(), known.tolist(), strict=True):
            got[i] += k
    assert dict(got) == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(d).collect()} == dict(got)


def test_pre_tokens_are_the_librarys(libraries):
    tok, _ = libraries
    rng = np.random.default_rng(2)
    parts = ["a", "b", " ", "1", "'", "!", "\n", "\t", "s", "t", "re", "ll", "  ", "'s", "'ve", "é", "日", " ", "　", "½", "²", "٣", "😀", "́", "\x00", "\x85", "​", "ǅ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + ["".join(map(chr, rng.integers(0x20, 0xD000, 20))) for _ in range(500)]
    counter = token_counts.counter("byte_bpe_50k.json")
    buf, off = token_counts.flat(pa.array(texts))
    raw, found = buf.tobytes(), [[] for _ in texts]
    for a, z, d in zip(*(x.tolist() for x in counter.cuts(buf, off)[:3]), strict=True):
        found[d].append("".join(counter.letter[b] for b in raw[a:z]))
    assert found == [[p for p, _ in tok.pre_tokenizer.pre_tokenize_str(t)] for t in texts]


def test_places():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    places = token_counts.Places(keys)
    assert (places.find(keys) == np.arange(len(keys))).all() and (places.find(keys + np.uint64(1)) == -1).all()
    assert token_counts.Places(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


# ---------------------------------------------------------------- alignment


def plain_alignment(text, tok, sp):
    """Tokens, groups, links and digest by the tokens' byte ranges; none where the bytes differ."""
    if not text:
        return None
    byte = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in byte)}
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    sides = [[bytes(byte[c] for c in tok.id_to_token(i)) for i in a], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return None
    ends = [np.cumsum([len(x) for x in s]) for s in sides]
    starts = [e - [len(x) for x in s] for e, s in zip(ends, sides, strict=True)]
    groups, low = [], 0
    for end in np.intersect1d(*ends):
        groups.append("|".join(",".join(str(ids[k]) for k in np.flatnonzero((s >= low) & (e <= end))) for ids, s, e in zip((a, b), starts, ends, strict=True)))
        low = end
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(np.searchsorted(ends[1], starts[0][i], "right"), np.searchsorted(starts[1], ends[0][i]))]
    return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_alignment_equals_byte_ranges(docs, texts, libraries, monkeypatch):
    tok, sp = libraries
    tok.encode_special_tokens = True
    found = [(i, plain_alignment(t, tok, sp)) for i, t in texts]
    tok.encode_special_tokens = False
    holders = collections.Counter(pair for _, f in found if f for pair in set(f[3]))
    most = collections.Counter()
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    want = [(i, *f[:3], len(f[3]), sum(holders[x] == most[x[0]] for x in f[3]), sum(holders[x] for x in f[3]), f[4]) if f else (i, 0, 0, 0, 0, 0, 0, "") for i, f in found]
    same([tuple(r) for r in alignment.alignment(docs).collect()], want)
    assert alignment.alignment(docs.where("false")).count() == 0


def test_transducer_tracks_the_residual():
    t = alignment.Transducer([b"ab", b"cd", b"x"], [b"a", b"bc", b"d", b"xx"])
    ab = t.step(0, 0)
    assert (t.lead[ab], t.residual[ab]) == (0, b"ab")
    b = t.step(ab, 0)
    assert (t.lead[b], t.residual[b]) == (0, b"b")
    c = t.step(b, 1)
    assert (t.lead[c], t.residual[c]) == (1, b"c")
    assert t.step(t.step(c, 1), 2) == 0 and t.step(b, 2) == -1
    # one unit that fits, one of other bytes, one whose second side ends too soon
    ends = np.array([2, 3, 4])
    same, links, groups = t.align(np.array([0, 1, 2, 0]), ends, np.array([0, 1, 2, 3, 0]), np.array([3, 4, 5]))
    assert same.tolist() == [True, False, False]
    first = links[0] == 0
    assert list(zip(links[1][first].tolist(), links[2][first].tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2)]
    assert [g.tolist() for g in groups] == [[0], [2], [3]]


def test_units_meet_at_sure_boundaries():
    for text in ("a b", " a", "a  b", "a \nb c ", "", "  ", "x\n y z"):
        parts = alignment.units(text)
        assert " " + text == "".join(" " + p for p in parts)
        assert all(p and not p[-1].isspace() for p in parts[:-1])


def test_blocks_ask_for_their_own_pairs(spark, monkeypatch):
    """Counts over many small blocks are those of one."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    one = alignment.alignment(d.coalesce(1)).collect()
    many = alignment.alignment(d.repartition(7)).collect()
    same([tuple(r) for r in one], [tuple(r) for r in many])


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows):
    """By all pairs, in whole numbers of any size."""
    kept = [(i, lab, tuple(math.floor(256 * x) for x in e)) for i, lab, e in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(256 * x) for x in e)]
    out = []
    for n, (i, lab, e) in enumerate(kept):
        if i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(e, f, strict=True)), j, other) for m, (j, other, f) in enumerate(kept) if m != n and len(f) == len(e)]
        for p, j, _ in sorted(s for s in scored if s[2] == lab)[:5]:
            fit = sorted(s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(i, j, k, m, -p, -s) for k, (s, m, _) in enumerate(fit, 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, row string, cell int, score int")


def test_negatives_by_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(scale=0.1, size=8).round(2).tolist()) for i in range(400)]
    rows += [(i, 1, [0.5] * 8) for i in range(1000, 1060)] + [(i, 2, [0.4] * 8) for i in range(1100, 1120)]  # ties
    rows += [(1, None, [1.0] * 8), (2, 1, None), (3, 1, [None] + [1.0] * 7), (50, 1, [math.nan] * 8), (100, 1, [math.inf] * 8), (150, 1, [1e307] * 8), (None, 1, [1.0] * 8)]
    rows += [(2000, 1, [0.0] * 8), (2050, 0, []), (2051, 0, []), (2052, 1, []), (3000, 0, [1.0, 2.0]), (3001, 0, [1.0, 1.0]), (3002, 1, [0.9, 1.1])]
    rows += [rows[50], rows[51], (7, 2, [0.3] * 8)]  # repeated rows and ids
    want = plain_negatives(rows)
    assert len(want) > 100
    same([tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect()], want)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    monkeypatch.setattr(hard_negatives, "ROWS", 90)
    same([tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect()], want)
    assert hard_negatives.hard_negatives(vectors(spark, rows).where("false")).count() == 0


def test_negatives_beyond_doubles(spark):
    """Products of more than 53 bits are still exact."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(i, int(rng.integers(0, 3)), (1e5 + rng.integers(0, 9, 4) + rng.random(4)).tolist()) for i in range(200, 260)]
    same([tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect()], plain_negatives(rows))
