"""Queries over the driver's tables, one for each training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as _alignment
from . import ann as _ann
from . import embedding_dedup as _embedding
from . import hard_negatives as _negatives
from . import language_id as _language
from . import lm as _lm
from . import minhash_dedup as _minhash
from . import packing as _packing
from . import quality as _quality
from . import secrets as _secrets
from . import sentencepiece_codec as _pieces
from . import token_counts as _counts
from . import toxicity as _toxicity
from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.minhash_dedup(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.best_fit_packing(_packing.token_pieces(table(spark, sf_dir, "documents")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pieces.encode(table(spark, sf_dir, "documents"), with_text=True)
    return rows.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedding.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.digest(_secrets.secret_scan(table(spark, sf_dir, "documents")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.lm_score(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return _ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "keep", "host_posterior", "path_posterior")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignment.alignment(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts.token_counts(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return _negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_best_fit_packing, op3_sentencepiece, op4_embedding_dedup, op5_toxicity, op6_secret_scan, op7_lm_score, op8_nearest, op9_quality, op10_language_id, op11_alignment, op12_token_counts, op13_hard_negatives)}
#: DuckDB SQL of the queries that it can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.y, reach.c FROM reach JOIN e ON e.x = reach.v),
m AS (SELECT v, MIN(c) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_embedding_dedup": """
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS r FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.r > 0 AND b.r > 0 AND isfinite(a.r) AND isfinite(b.r) AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.95),
reach AS (SELECT vec_id AS v, vec_id AS c FROM u UNION SELECT l.y, reach.c FROM reach JOIN l ON l.x = reach.v),
m AS (SELECT v, MIN(c) AS c FROM reach GROUP BY 1), k AS (SELECT x, COUNT(*) AS k FROM l GROUP BY 1)
SELECT vec_id, COALESCE(k, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM u JOIN m ON m.v = vec_id LEFT JOIN k ON k.x = vec_id""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own <> s.label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3""",
}
