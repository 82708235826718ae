"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator and stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from wayfold.llm import ann, embedding_dedup, language_id, lm, minhash_dedup, packing, quality, secrets, sentencepiece_codec, toxicity

LONG = "long word " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n int, keep string, comp int, node int, held_out string"
ROWS = [
    (None, "text without id, of some words", "en", "s", 5, 1.0, "x", 1, "y", 1, 1, "z"),
    (1, None, "en", "s", None, None, None, None, None, None, None, None),
    (2, "", None, None, 0, 2.0, "x", 1, "y", 1, 1, "z"),
    (3, " \n\t ", "en", None, 4, 2.0, "x", 1, "y", 1, 1, "z"),
    (4, "the same words come here again and again", "en", "s", 9, 2.0, "x", 1, "y", 1, 1, "z"),
    (4, "the same words come here again and again", "en", "s", 9, 2.0, "x", 1, "y", 1, 1, "z"),
    (5, "the same words come here again and again", None, "s", 9, 2.0, "x", 1, "y", 1, 1, "z"),
    (6, LONG, "de", "t", 9, 2.0, "x", 1, "y", 1, 1, "z"),
    (7, "123 456 !!! 😀", "de", "t", 9, 2.0, "x", 1, "y", 1, 1, "z"),
    (8, "ein kurzer satz mit password=abcdef123 darin", "de", "t", 9, 2.0, "x", 1, "y", 1, 1, "z"),
    (9, "the same words come here again and again " + "x7" * 10_000, "en", "s", 9, 2.0, "x", 1, "y", 1, 1, "z"),
]
LABELS = [(4, 1, 0), (5, None, None), (6, 0, 1), (None, 1, 1), (8, 1, 0), (8, 1, 0)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    folder = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{folder}/labels.parquet")
    return docs, labels, folder


def operators(labels):
    return {
        "minhash": minhash_dedup.minhash_dedup,
        "packing": lambda d: packing.best_fit_packing(packing.token_pieces(d)),
        "sentencepiece": lambda d: sentencepiece_codec.decode(sentencepiece_codec.encode(d)),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "secrets": secrets.secret_scan,
        "lm": lm.lm_score,
        "quality": lambda d: quality.quality(d, labels),
        "language": language_id.language_id,
    }


NAMES = ["minhash", "packing", "sentencepiece", "toxicity", "secrets", "lm", "quality", "language"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(tables, name):
    docs, labels, _ = tables
    rows = operators(labels)[name](docs).collect()
    if name == "packing":
        assert sum(r.piece == 0 for r in rows) == len(ROWS)
    else:
        assert len(rows) == len(ROWS)
    assert sorted({str(r.doc_id) for r in rows}) == sorted({str(r[0]) for r in ROWS})


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, tables, name):
    docs, labels, _ = tables
    assert operators(labels)[name](docs.where("false")).count() == 0
    assert operators(labels.where("false"))[name](docs).count() >= len(ROWS)


def test_defined_results(tables):
    docs, labels, _ = tables
    by_id = {r.doc_id: r for r in minhash_dedup.minhash_dedup(docs).collect()}
    assert by_id[5].component_id == 4 and not by_id[5].kept and by_id[1].n_shingles == 0 and by_id[2].kept
    langs = {r.doc_id: r.lang_pred for r in language_id.language_id(docs).collect()}
    assert langs[1] == langs[2] == langs[7] == "und" and langs[6] != "und"
    scored = {r.doc_id: r for r in lm.lm_score(docs).collect()}
    assert scored[1].n_tokens == scored[2].n_tokens == 1 and scored[6].n_tokens == 80_001


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tables, name, stage):
    docs, _, folder = tables
    out = stage(spark, docs, folder)
    rows = out.collect()
    if name != "best_fit_packing":
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert stage(spark, docs.where("false"), folder).count() == 0
    ids = {r.doc_id for r in rows}
    if name == "language_id":
        assert ids >= {None, 4, 5, 6, 8} and not ids & {1, 2, 3, 7}
    if name == "minhash_dedup":
        assert 5 not in ids and {1, 2, 3, 4, 6, 7, 8} <= ids
    if name == "secret_scan":
        assert "abcdef123" not in next(r.text for r in rows if r.doc_id == 8)
        assert next(r.text for r in rows if r.doc_id == 4) == ROWS[4][1]


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, unit string, rank string"
    rows = [(None, [1.0, 0.0], 1, "u", "r"), (1, None, 1, "u", "r"), (2, [1.0, 0.0], None, "u", "r"), (2, [1.0, 0.0], 1, "u", "r"), (3, [0.0, 0.0], 1, "u", "r"), (4, [2.0, 0.0], 1, "u", "r"), (100, [1.0, 0.1], 1, "u", "r"), (200, [None, 1.0], 1, "u", "r")]
    v = spark.createDataFrame(rows, schema)
    got = embedding_dedup.embedding_dedup(v).collect()
    assert len(got) == len(rows) and {r.vec_id: r.component_id for r in got}[4] == 2
    assert embedding_dedup.embedding_dedup(v.where("false")).count() == 0
    found = ann.nearest(v, v.where("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(100, 2), (100, 4)]
    assert ann.nearest(v.where("false"), v).count() == 0
