"""Stages of the pipeline over the documents, against brute-force versions."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import closure, shingles

import corpus_pipeline as P
from wayfold.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_language_stage_drops_only_texts_without_language(spark, documents):
    kept = {r.doc_id for r in P.language_stage(spark, documents, SF).collect()}
    for r in documents.collect():
        if any(map(str.isalpha, r.text or "")):
            assert r.doc_id in kept
        else:
            assert r.doc_id not in kept


@pytest.mark.parametrize("languages", [2, 3, 4])
def test_language_stage_keeps_clean_texts_by_any_number_of_languages(spark, documents, languages):
    known = sorted(r.lang for r in documents.where("lang IS NOT NULL").select("lang").distinct().collect())[:languages]
    mine = documents.where(F.col("lang").isin(known))
    kept = {r.doc_id for r in P.language_stage(spark, mine, SF).collect()}
    assert {r.doc_id for r in mine.where("length(text) > 200").collect()} <= kept


def test_language_stage_drops_gibberish(spark):
    """Learnt from a thousand texts: what is like none of the languages goes, most of it."""
    learnt = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(3)
    odd = [(10**6 + k, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 400))) for k in range(30)]
    odd += [(2 * 10**6 + k, "".join(rng.choice(list("日本語テキスト漢字 "), 200))) for k in range(30)]
    kept = {r.doc_id for r in P.language_stage(spark, learnt.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True), SF).collect()}
    assert {r.doc_id for r in learnt.where("length(text) > 200").collect()} <= kept
    assert sum(i in kept for i, _ in odd) <= 30


def test_quality_stage_keeps_clean_documents(spark, documents):
    kept = {r.doc_id for r in P.quality_stage(spark, documents, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert np.mean([r.doc_id in kept for r in labels if r.quality == 1]) > 0.97
    assert np.mean([r.doc_id in kept for r in labels if r.quality == 0]) < 0.4


def test_dedup_stage_keeps_one_of_each_class(spark, documents):
    sets = {r.doc_id: shingles(r.text) for r in documents.collect()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {i for i, c in closure(sets, links).items() if i == c}
    assert {r.doc_id for r in P.dedup_stage(spark, documents, SF).collect()} == want


def test_secrets_stage_takes_out_all_patterns(spark, documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    for r in P.secrets_stage(spark, documents, SF).collect():
        assert not secrets.base_spans(r.text)
        if not secrets.base_spans(before[r.doc_id]) and P.REDACTED not in r.text:
            assert r.text == before[r.doc_id]
        assert r.n_chars == len(r.text)


def test_run_packs_what_the_stages_keep(spark, documents):
    docs = documents
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    want = {r.doc_id for r in docs.collect()}
    rows = P.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == want and all(0 < r.length <= 2048 for r in rows)
    assert re.fullmatch(r"\[SECRET\]", P.REDACTED)
