"""Corpus pipeline: stages over documents, each one an operator of ``wayfold.llm``.

A stage gets all rows that its predecessor kept, and the folder of the input
tables.  All stages but the last return the columns of documents, whatever
further columns there are and whatever their names.  Null and empty texts go in
the first stage, which finds no language in them; a later stage that gets some
keeps them (packing gives each one piece).  Very long texts are read whole.
Rows that repeat a doc_id stay or go together; of documents that tie for a
class, the one of the smallest doc_id stays.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import language_id as _language
from wayfold.llm import minhash_dedup as _minhash
from wayfold.llm import packing as _packing
from wayfold.llm import quality as _quality
from wayfold.llm import secrets as _secrets
from wayfold.llm.common import discard, stored

#: Below it a document goes: low, so that clean documents stay.
LEAST_QUALITY = 0.3
#: A document goes whose nearest codeword has this loss or more (1: its bits say nothing): text of no language learnt.
MOST_LOSS = 0.7
REDACTED = "[SECRET]"


def _with(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], keep: F.Column | None = None) -> DataFrame:
    """Rows of ``operator`` that ``keep`` holds for, with the columns of ``docs``; columns that could clash are set aside meanwhile."""
    known = {"doc_id", "text", "lang", "source"}
    names = {c: c if c.lower() in known else f"__{i}" for i, c in enumerate(docs.columns)}
    rows = operator(docs.withColumnsRenamed(names))
    if keep is not None:
        rows = rows.where(keep)
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those that no codeword is near to, by a loss that doesn't depend on how many languages were learnt."""
    del spark, sf_dir
    bad = (F.col("lang_pred") == "und") | (F.col("loss") >= MOST_LOSS)
    return _with(docs, _language.language_id, ~bad)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are of low quality by their own evidence and their site's go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _with(docs, lambda d: _quality.quality(d, labels, threshold=LEAST_QUALITY), F.col("keep"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest doc_id."""
    del spark, sf_dir
    gone = _minhash.minhash_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A fixed word takes the place of each secret."""
    del spark, sf_dir
    rows = _with(docs, lambda d: _secrets.secret_scan(d, redact=REDACTED))
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return rows


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequence and place."""
    del spark, sf_dir
    return _packing.best_fit_packing(_packing.token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("minhash_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]
#: No SQL expresses these stages; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is stored before the next one reads it, and goes when that has read it."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        before = path
        docs, path = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(spark, before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # it cuts the lineage after its one pass over the texts
    if path is not None:
        discard(spark, path)
    return out
