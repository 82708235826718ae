"""Scores, posteriors, counts and links against plain versions of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from test_brute_force import LOWER, WORD, closure, crc, tokens

from wayfold.llm import ann, embedding_dedup, language_id, lm, minhash_dedup, pieces, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- 10


def test_language_counts_one_by_one():
    texts = ["Ein Satz, über  nichts.", "", "ab", "A\tB", None, "日本 x"]
    array = pa.array(texts)
    buf, off = language_id.flat(array)
    got = language_id.counts(buf, off)
    for row, text in zip(got, texts, strict=True):
        raw, want = (text or "").encode(), np.zeros(language_id.FEATURES)
        for order in language_id.ORDERS:
            for i in range(len(raw) - order + 1):
                h = sum(int(language_id._CODE[raw[i + k]]) * int(language_id._STEP[k]) for k in range(order)) % 2**64
                want[h >> 52] += 1
        assert row.tolist() == want.tolist()


def test_language_bits_and_decoding_one_by_one(spark, docs):
    train = [r for r in docs.collect() if r.text and r.lang]
    model = language_id.fit(docs)
    totals = {}
    for lang in {r.lang for r in train}:
        totals[lang] = language_id.counts(*language_id.flat(pa.array([r.text for r in train if r.lang == lang]))).sum(0)
    assert model["langs"] == sorted(totals)
    p = np.stack([(totals[k] + 0.5) / (totals[k].sum() + 0.5 * language_id.FEATURES) for k in model["langs"]])
    for j, bit in enumerate(model["code"].T):
        up, down = p[bit > 0].mean(0), p[bit < 0].mean(0)
        assert model["w"][:, j] == pytest.approx(np.log(up / down))
    x = language_id.counts(*language_id.flat(pa.array([r.text for r in train[:40]])))
    top, score, margin, loss = language_id.decode(x, model)
    for i, row in enumerate(x):
        losses = []
        for word in model["code"]:
            f = [min(3, max(-3, (sum(row * model["w"][:, j]) / max(1, row.sum()) - model["shift"][j]) / model["scale"][j])) for j in range(len(word))]
            losses.append(sum(w * max(0, 1 - a * b) ** 2 for w, a, b in zip(model["weight"], f, word, strict=True)))
        e = np.exp(-4 * (np.array(losses) - min(losses)))
        e /= e.sum()
        assert top[i] == int(np.argmin(losses)) and loss[i] == pytest.approx(min(losses), abs=1e-9)
        assert score[i] == pytest.approx(e.max()) and margin[i] == pytest.approx(e.max() - np.sort(e)[-2])


# ---------------------------------------------------------------- 9


def test_log_odds_are_sums_of_bins(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "CAST(quality AS INT) label")
    model = quality.fit(docs.selectExpr("CAST(doc_id AS LONG) doc_id", "text"), labels)
    texts = pa.array([r.text for r in docs.limit(30).collect()])
    x = quality.statistics(texts)
    got = quality.log_odds(texts, model)
    for row, z in zip(x, got, strict=True):
        want, at = model["w"][0], 1
        for v, edges in zip(row, model["edges"], strict=True):
            want += model["w"][at + sum(v >= e for e in edges)]
            at += len(edges) + 1
        assert z == pytest.approx(min(12, max(-12, want)))


def test_posteriors_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(f"h{h}", f"p{p}", float(np.clip(rng.normal(0.3 + 0.1 * h, 0.2), 0.01, 0.99))) for h in range(5) for p in range(3) for _ in range(4 + 9 * p)]
    groups, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    by = lambda key: {k: [r[2] for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = by(lambda r: r[0]), by(lambda r: r[:2])
    noise = lambda v: sum(p * (1 - p) for p in v) / len(v) ** 2
    m = np.mean([r[2] for r in rows])
    beta = lambda spread, n: min(max(m * (1 - m) / max(spread - n, 1e-9) - 1, 1.0), 1e4)
    s = beta(np.var([np.mean(v) for v in hosts.values()]), np.mean([noise(v) for v in hosts.values()]))
    post = {h: (sum(v) + s * m) / (len(v) + s) for h, v in hosts.items()}
    own = beta(np.mean([(np.mean(v) - np.mean(hosts[k[0]])) ** 2 for k, v in paths.items()]), np.mean([noise(v) for v in paths.values()]))
    assert mean == pytest.approx(m)
    for r in groups.collect():
        v = paths[r.host, r.path]
        assert r.host_posterior == pytest.approx(post[r.host])
        assert r.path_posterior == pytest.approx((sum(v) + own * post[r.host]) / (len(v) + own))


# ---------------------------------------------------------------- 5


def test_factorization_scores_are_sums_of_pairs():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(0, 40))) for _ in range(20)] + ["", None]
    bucket, _ = toxicity.terms(pa.array([f"w{k}" for k in range(60)]))
    model = {"index": np.full(toxicity.BUCKETS, -1, np.int16), "bias": -0.4, "w": rng.normal(size=30), "v": rng.normal(size=(30, 3))}
    model["index"][bucket[:30]] = np.arange(30)
    got = toxicity.scores(pa.array(texts), model)
    for text, s in zip(texts, got, strict=True):
        on = sorted({int(w[1:]) for w in (text or "").split() if int(w[1:]) < 30})
        z = -0.4 + sum(model["w"][i] for i in on) + sum(float(model["v"][i] @ model["v"][j]) for a, i in enumerate(on) for j in on[a + 1 :])
        assert s == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_takes_the_terms_that_part_labels(spark):
    rows = [(i, ("bad words here " if i % 4 == 0 else "fine words here ") + f"x{i % 7}") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, label int")
    model = toxicity.fit(d, y)
    at = lambda w: model["index"][toxicity.terms(pa.array([w]))[0][0]]
    assert at("bad") >= 0 and at("fine") >= 0 and at("absent") < 0
    assert toxicity.scores(pa.array(["bad words here x1", "fine words here x1"]), model).round().tolist() == [1, 0]


# ---------------------------------------------------------------- 7


def test_lm_scores_from_counts_and_lattices(spark):
    texts = {k: t for k, t in enumerate(["the cat sat", "The dog sat down", "a cat", "", None, "zebra the the", "sat on the mat", "down the hill went the dog"])}
    got = {r.doc_id: r for r in lm.lm_score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    vocab, count = pieces.vocabulary(), {}
    train = [i for i in texts if crc(i, 5) != 1]
    for i in train:
        for w in [*tokens(texts[i]), b""]:
            count[w] = count.get(w, 0) + 1
    start = lm.starting_weights(vocab)
    expected = np.zeros(len(start))
    lattice = lambda w, logp, c=None: lm.lattice(np.frombuffer(pieces.SPACE + w, np.uint8)[None, :], logp, vocab, None if c is None else np.array([c]))
    for w, c in count.items():
        if w:
            expected += lattice(w, start, c)[1]
    p = expected + np.exp(start) * max(1.0, 1e-3 * expected.sum())
    total = p.sum() + len(train) + 0.5
    with np.errstate(divide="ignore"):
        logp = np.log(p / total)
    end, tokens_ = (len(train) + 0.5) / total, sum(count.values())
    new = sum(c == 1 for c in count.values()) / tokens_
    close = math.exp(lm.closing(logp, vocab))
    for i, t in texts.items():
        score = sub = 0.0
        for w in [*WORD.findall((t or "").encode().translate(LOWER)), b""]:
            q = end if not w else math.exp(lattice(w, logp)[0][0])
            sub += math.log10(q)
            score += math.log10((1 - new) * count.get(w, 0) / tokens_ + new * (q if not w else q * close * (1 - end)))
        assert got[i].subword_score == pytest.approx(sub, rel=1e-9)
        assert got[i].score == pytest.approx(score, rel=1e-9)


# ---------------------------------------------------------------- 6


def test_field_finds_secrets_without_a_name(spark):
    """Of secrets that no fixed pattern matches, put into clean texts, the field finds some, and nothing else there."""
    rng = np.random.default_rng(77)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    clean = [r for r in known.where("length(text) BETWEEN 200 AND 4000").collect() if not secrets.base_spans(r.text)]
    made, put = [], {}
    for k, r in enumerate(clean[:200]):
        words, value = r.text.split(" "), "".join(letters[i] for i in rng.integers(0, 62, 30))
        words.insert(int(rng.integers(0, len(words))), value if k % 2 else ("2024-03-05", "user@example.com", "getUserName", "12345678901")[k // 2 % 4])
        text = " ".join(words)
        made.append((10**6 + r.doc_id, text))
        if k % 2:
            put[10**6 + r.doc_id] = (text.index(value), text.index(value) + len(value))
    got = {r.doc_id: r.spans for r in secrets.secret_scan(known.unionByName(spark.createDataFrame(made, "doc_id long, text string"))).where("doc_id >= 1000000").collect()}
    added = [(i, s.start, s.end) for i, v in got.items() for s in v if s.kind == "crf"]
    right = sum(i in put and a < put[i][1] and put[i][0] < z for i, a, z in added)
    assert right >= 0.2 * len(put) and right >= 0.9 * len(added)


# ---------------------------------------------------------------- 1, 4, 8: rows that repeat an id


def test_documents_of_one_id_are_documents_of_their_own(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, one), (1, two), (2, two + " more"), (3, one + " more")]
    for _ in range(2):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == [(1, 36, 1, True), (1, 36, 1, True), (2, 37, 1, False), (3, 37, 1, False)]


def test_vectors_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(v).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    near = ann.nearest(v, v.where("vec_id = 2"), k=2).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in near] == [(1, 0.01), (3, round(math.hypot(0.99, 0.99), 6))]


def test_dense_blocks_and_thresholds_near_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, 8))[rng.integers(0, 3, 400)] + rng.normal(scale=0.01, size=(400, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for least in (0.95, 1 - 1e-10):
        got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(v, least).collect()}
        on = u @ u.T >= least
        want = closure(range(400), [(a, b) for a, b in zip(*np.nonzero(on), strict=True) if a < b])
        assert all(got[i].component_id == want[i] for i in range(400))


def test_nearest_of_scattered_and_clustered_vectors(spark):
    """Cells by bound leave out nothing: whether vectors cluster or not, recall stays."""
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=(3000, 12)), rng.normal(scale=8, size=(20, 12))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 12))):
        v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        rows = ann.nearest(v, v.where("vec_id % 100 = 0"), per_shard=300).collect()
        hit = 0
        for q in range(0, 3000, 100):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            hit += len({r.vec_id for r in rows if r.query_id == q} & {i for i in np.lexsort((np.arange(3000), d)) if i != q and d[i] <= np.sort(d)[10]})
        assert hit >= 0.9 * 300

