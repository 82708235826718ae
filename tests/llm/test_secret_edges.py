"""Texts that meet in one chunk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wayfold.llm import secrets
from wayfold.llm.common import flat

KEY = "0123456789abcdef01234567"


def test_hex_runs_break_where_a_text_starts():
    texts = ["this is the code", KEY + " starts a text", "", None, KEY, KEY, "bad", KEY[:23], "f", "ends with " + KEY]
    for rows in (texts, texts[::-1], texts[1:], texts[:2]):
        array = pa.array(rows)
        got = secrets._may_match(array, *flat(array))
        assert got.tolist() == [bool(secrets.base_spans(t or "")) for t in rows]


def test_random_texts_match_one_by_one():
    rng = np.random.default_rng(5)
    rows = ["".join(rng.choice(list("0af z"), rng.integers(0, 60), p=[0.32, 0.32, 0.32, 0.02, 0.02])) for _ in range(2000)]
    array = pa.array(rows)
    assert secrets._may_match(array, *flat(array)).tolist() == [bool(secrets.base_spans(t)) for t in rows]


def test_scan_does_not_depend_on_the_row_before(spark):
    rows = spark.createDataFrame([(1, "this is the code"), (2, KEY + " starts a text")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "crf"] for r in secrets.secret_scan(rows, sample=5).collect()}
    assert got == {1: [], 2: [("hex", 0, 24)]}
