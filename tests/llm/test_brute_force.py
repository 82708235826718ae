"""Operators against brute-force versions, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import ann, embedding_dedup, language_id, lm, minhash_dedup, packing, pieces, quality, secrets, sentencepiece_codec, toxicity
from wayfold.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


def tokens(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def shingles(text):
    w = tokens(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def closure(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_components(spark, texts, percent=75):
    rows = [(i, t) for i, t in texts.items()]
    got = {r.doc_id: r for r in minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = closure(sets, links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def test_minhash_on_documents(spark, docs):
    check_components(spark, docs)


def test_minhash_chain_and_short(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 9999, 120)]
    texts, now = {}, list(base)
    for k in range(12):  # each like the one before, the last unlike the first
        texts[k * 7] = " ".join(now)
        now = list(now)
        now[k * 9] = f"new{k}"
    texts |= {100: "one two", 101: "One TWO", 102: "", 103: " \n ", 104: "one two three", 105: "x" * 300_000}
    check_components(spark, texts)


def test_minhash_blocks_of_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LIMIT", 8)
    monkeypatch.setattr(minhash_dedup, "WHOLE", 16)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 9999, 60)]
    texts = {}
    for k in range(90):
        copy = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 4)):
            copy[j] = f"n{rng.integers(0, 9999)}"
        texts[k] = " ".join(copy)
    check_components(spark, texts)


def test_components_of_a_long_chain(spark):
    from wayfold.llm.common import components

    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    assert {r.v: r.c for r in components(e).collect()} == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_packing_is_gapless_whole_and_near_the_bound(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs.items()}
    rows = Q.op2_best_fit_packing(spark, SF).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32
    for i, own in ids.items():
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(own)
        assert len(parts) == max(1, math.ceil(len(own) / 2048)) and all(r.length == 2048 for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at
            at += r.length
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def test_packing_ids_with_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> hi", " <|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endof", "日本語 𝄞 😀\ttab\n", " " * 50, "", None]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_packing_rounds(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 100, 3000)
    df = spark.createDataFrame([(int(i), 0, int(n)) for i, n in enumerate(x)], "doc_id long, piece int, length long")
    rows = packing.best_fit_packing(df, capacity=100, per_part=100).collect()
    assert len(rows) == 3000
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 100
    assert len(used) <= 1.05 * packing.lower_bound(x, 100)


def test_best_fit_and_bound():
    assert len(set(packing.best_fit(np.array([6, 5, 4, 5]), 10).tolist())) == 2
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([], int), 10) == 0


def test_sequences_hold_the_ids(spark, docs):
    d = spark.createDataFrame(list(docs.items())[:20], "doc_id long, text string")
    placed = packing.best_fit_packing(packing.token_pieces(d))
    whole = {r.sequence_id: b"".join(map(bytes, r.parts)) for r in packing.sequences(d, placed).collect()}
    for r in placed.collect():
        assert zlib.crc32(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def test_sentencepiece_equals_the_library_and_round_trips(spark, docs):
    texts = dict(docs) | {9001: "", 9002: "  two  spaces ", 9003: "日本語 𝄞 😀\ttab\n", 9004: "y" * 5000, 9005: None, 9006: "".join(np.random.default_rng(8).choice(list("abcdeé日"), 3000)), 9007: "x " + "ab" * 2000 + "\0é𝄞" * 200}
    sp = pieces.vocabulary().processor
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == sp.encode(texts[r.doc_id] or "")
        assert r.text == (texts[r.doc_id] or "")


def made_vocabulary(pieces_and_scores):
    """A unigram vocabulary with these pieces."""
    from wayfold.llm.common import span_hashes

    texts = [b""] + [p.encode() for p in pieces_and_scores]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])[1:]
    start = np.append(0, end[:-1])
    h = span_hashes(buf, start, end, lower=False)
    order = np.argsort(h)
    table = np.full(1 << 20, -1, np.int32)
    slot = (h[order] >> np.uint64(44)).astype(np.int64)
    table[slot[::-1]] = np.arange(len(h))[::-1]

    class Unknown:
        def unk_id(self):
            return 0

    return pieces.Vocabulary(Unknown(), "unigram", texts, np.array([0.0, *pieces_and_scores.values()]), np.full(256, -1), max(map(len, texts)), h[order], (np.arange(len(h)) + 1)[order].astype(np.int32), table)


def segmentations(word, known):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in known:
            for rest in segmentations(word[k:], known):
                yield (word[:k], *rest)


def test_viterbi_and_lattice_against_all_segmentations():
    known = {"a": -2.0, "b": -2.5, "ab": -3.1, "ba": -3.0, "aba": -4.2, "é": -3.3, "bé": -4.0}
    vocab = made_vocabulary(known)
    for word in ("abab", "aabba", "ababé", "bbé"):
        best = max(segmentations(word, known), key=lambda s: sum(known[p] for p in s))
        ids, count = sentencepiece_codec.viterbi(np.frombuffer(word.encode(), np.uint8)[None, :], vocab)
        assert [vocab.texts[i].decode() for i in ids] == list(best) and count[0] == len(best)
        logp = np.array([-np.inf, *known.values()])
        total, expected = lm.lattice(np.frombuffer(word.encode(), np.uint8)[None, :], logp, vocab, np.array([3.0]))
        p = {s: math.exp(sum(known[x] for x in s)) for s in segmentations(word, known)}
        assert total[0] == pytest.approx(math.log(sum(p.values())))
        for k, piece in enumerate(known):
            assert expected[k + 1] == pytest.approx(3 * sum(v * s.count(piece) for s, v in p.items()) / sum(p.values()))


def test_lm_base_scores(spark, docs):
    from collections import Counter

    count = Counter()
    for i, t in docs.items():
        if crc(i, 5) != 1:
            count.update(tokens(t) + [b""])
    n, v = sum(count.values()), len(count)
    for r in Q.op7_lm_score(spark, SF).collect():
        own = tokens(docs[r.doc_id]) + [b""]
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(own), n, crc(r.doc_id, 5) == 1)
        assert r.n_known == sum(count[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_lm_probabilities_sum_to_one():
    vocab = made_vocabulary({"▁": -1.0, "a": -2.0, "▁a": -1.5})
    start = np.exp(lm.starting_weights(vocab))
    assert start.sum() == pytest.approx(1)
    # all words of one letter up to a length beyond which next to nothing is left, and the end
    end, new = math.log(0.07), 0.2
    with np.errstate(divide="ignore"):
        logp = np.log(start * (1 - 0.07))
    size = np.arange(1, 200)
    score = lm.word_scores(np.full(int(size.sum()), ord("a"), np.uint8), size, logp, vocab)
    bare = lm.word_scores(np.zeros(0, np.uint8), np.array([0]), logp, vocab)
    h = np.append(np.arange(1, 201, dtype=np.uint64), lm.END)
    counts = np.zeros(201)
    counts[[3, 7, 200]] = 5, 2, 3
    with np.errstate(divide="ignore"):
        arc = np.log((1 - new) * counts / counts.sum())
    _, both = lm.token_scores(h, np.concatenate([bare, score, [0.0]]), arc, end, new, lm.closing(logp, vocab))
    assert np.exp(both).sum() == pytest.approx(1, abs=1e-6)


def test_secret_patterns(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = dict(docs) | {7001: "é PassWord = 'abc123' x", 7002: "token: abc12", 7003: "AKIA" + "A" * 16 + " AKIA" + "B" * 15, 7004: "deadbeef" * 3 + " " + "0" * 23, 7005: None, 7006: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in secrets.digest(secrets.secret_scan(df, sample=50)).collect():
        t = texts[r.doc_id] or ""
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[2] == k for f in found) for k in ("assign", "access", "hex"))
        assert ",".join(s for s in (r.spans or "").split(",") if not s.startswith("crf")) == base


def test_crf_decoding_skips_exactly():
    rng = np.random.default_rng(4)
    moves = np.array([[-1.0, 0.5, 0.2], [-0.5, 0.7, 0.1], [0.3, -50.0, 0.9]])
    for _ in range(200):
        s = rng.normal(-1, 2, (7, 3))

        def total(path, s=s):
            full = (2, *path, 2)
            return sum(s[i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(full))

        best = max(itertools.product(range(3), repeat=7), key=total)
        got = secrets.decode(s, moves, np.zeros(7, int))
        assert total(tuple(got.tolist())) == pytest.approx(total(best))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é password=abcdef12 end"), (2, "clean")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.secret_scan(df, redact="[S]").collect()}
    assert out == {1: "é [S] end", 2: "clean"}


def unit_rows(rng, n, dim=16):
    x = rng.normal(size=(n, dim))
    near = x[: n // 4] + rng.normal(scale=0.05, size=(n // 4, dim))
    return np.concatenate([x, near, x[:5], 3 * x[:3]])


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "RUN", 40)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    x = unit_rows(np.random.default_rng(1), 240)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0])]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    on = u @ u.T >= 0.95
    want = closure(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(on), strict=True) if a < b])
    for i in range(len(x)):
        assert got[i].n_links == on[i].sum() - 1 and got[i].component_id == want[i]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))


def test_nearest_recall_and_exact_scores(spark):
    x = unit_rows(np.random.default_rng(2), 800)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000, None), (5100, [0.0] * 16)], "vec_id long, embedding array<double>")
    rows = ann.nearest(v, v.where("vec_id % 100 = 0"), per_shard=300).collect()
    hit = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((s, i) for i, s in enumerate(d.tolist()) if i != q)[:10]
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == d[r.vec_id] for r in own)
        hit += len({r.vec_id for r in own} & {i for _, i in want})
    assert hit >= 0.9 * 10 * len(range(0, len(x), 100))
    assert not {r.query_id for r in rows} & {5000, 5100}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in Q.op10_language_id(spark, sf).collect() if r.held_out]
    assert all(crc(r.doc_id, 3) == 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.98
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.op9_quality(spark, sf).collect() if r.doc_id in labels and r.held_out]
    assert np.mean([r.keep == bool(labels[r.doc_id].quality) for r in rows]) > 0.9
    rows = [r for r in Q.op5_toxicity(spark, sf).collect() if r.doc_id in labels and r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id].toxic for r in rows]) > 0.85


def test_codewords_part():
    for n in (1, 2, 4, 5, 9, 30):
        code = language_id.codewords(n)
        assert len(code) == n
        assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))


def test_factorization_machine_learns_pairs(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        a, b = (rng.random(2) < 0.5).astype(int).tolist()
        rows.append((i, " ".join(["alpha"] * a + ["beta"] * b + [f"filler{k}" for k in rng.integers(0, 20, 5)])))
        labels.append((i, int(a and b)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(d, y).collect()}
    assert np.mean([got[i] == t for i, t in labels]) > 0.95


def test_terms_that_matter_only_together_are_chosen():
    """Each of two terms is as common in toxic rows as in others; both or neither are toxic.  Thousands of other terms part the labels better by chance."""
    rng = np.random.default_rng(9)
    x = rng.random((4000, 700)) < 0.1
    x[:, 5], x[:, 650] = rng.random((2, 4000)) < 0.5
    y = (x[:, 5] == x[:, 650]).astype(float)
    assert toxicity.paired(x.astype(np.uint8), y).tolist() == [5, 650]
    assert toxicity.paired(x.astype(np.uint8), (rng.random(4000) < 0.5).astype(float)).tolist() == []


def test_a_pair_without_weight_of_its_own(spark):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for i in range(3000):
        a, b = (rng.random(2) < 0.5).astype(int).tolist()
        rows.append((i, " ".join(["alpha"] * a + ["beta"] * b + [f"filler{k}" for k in rng.integers(0, 3000, 30)])))
        labels.append((i, int(a == b)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity.toxicity(d, y).collect() if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.9


def test_posteriors_shrink(spark):
    e = spark.createDataFrame([("big", "p", 0.9)] * 200 + [("small", "p", 0.1)] + [("low", "q", 0.2)] * 200, "host string, path string, p double")
    groups, mean = quality.posteriors(e)
    got = {r.host: r.path_posterior for r in groups.collect()}
    assert got["big"] == pytest.approx(0.9, abs=0.02) and got["low"] == pytest.approx(0.2, abs=0.03)
    assert 0.1 < got["small"] < mean


def test_shingles_of_batches():
    texts = ["a b c d e f", "", None, "a b", "A B c d e F", "é  ü\tx\ny z"]
    v, off = minhash_dedup.shingle_sets(pa.array(texts))
    assert np.diff(off).tolist() == [len(shingles(t)) for t in texts]
    assert v[off[0] : off[1]].tolist() == v[off[4] : off[5]].tolist()
