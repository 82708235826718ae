"""Results that follow their tracks: what changed is matched anew, in batches that can be replayed.

A store has two tables, both partitioned by batch: ``rows``, the results, and
``index``, which activities a batch has matched, from which upload and by which
version of the matcher.  A batch overwrites its own partitions alone, results
first, so that a replay gives the same tables; what was never indexed doesn't
count.  The current results are those of each activity's latest batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import made_folder

Match = Callable[[DataFrame], DataFrame]
INDEX = "activity_id long, uploaded long, version long, batch long"


def index(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(made_folder(spark, f"{store}/index"))


def latest(entries: DataFrame) -> DataFrame:
    """The entry of each activity's latest upload; of equal ones that of the latest version, and batch."""
    g = entries.groupBy("activity_id").agg(F.max(F.struct("uploaded", "version", "batch")).alias("x"))
    return g.select("activity_id", "x.uploaded", "x.version", "x.batch")


def current(spark: SparkSession, store: str, rows: str) -> DataFrame:
    """The current results, of the columns ``rows`` (activity_id among them)."""
    found = spark.read.schema(f"{rows}, batch long").parquet(made_folder(spark, f"{store}/rows"))
    return found.join(latest(index(spark, store)).select("activity_id", "batch"), ["activity_id", "batch"]).drop("batch")


def refresh(tracks: DataFrame, store: str, batch: int, version: int, match: Match) -> None:
    """Match the activities of ``tracks(activity_id, uploaded, ...)`` that the store doesn't have, or from an earlier upload or by an earlier version.

    Of several uploads of an activity the latest counts, and an earlier one
    than the store's is passed over.  ``batch`` names the partition.
    """
    spark = tracks.sparkSession
    newest = tracks.groupBy("activity_id").agg(F.max("uploaded").alias("uploaded"))
    have = latest(index(spark, store).where(F.col("batch") != batch)).select("activity_id", F.col("uploaded").alias("had"), F.col("version").alias("by"))
    old = F.col("had").isNull() | (F.col("uploaded") > F.col("had")) | ((F.col("uploaded") == F.col("had")) & (F.col("by") < version))
    todo = newest.join(have, "activity_id", "left").where(old).select("activity_id", "uploaded")
    write = lambda df, table: df.withColumn("batch", F.lit(batch).cast("long")).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{store}/{table}")
    write(match(tracks.join(todo, ["activity_id", "uploaded"], "left_semi").drop("uploaded")), "rows")
    write(todo.withColumn("version", F.lit(version).cast("long")), "index")


def follow(stream: DataFrame, store: str, version: int, match: Match, checkpoint: str) -> None:
    """Refresh the store by each batch of a stream of uploads, until all its input is read."""

    def one(df: DataFrame, batch: int) -> None:
        df.persist()
        refresh(df, store, batch, version, match)
        df.unpersist()

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rematch(tracks: DataFrame, store: str, version: int, match: Match) -> None:
    """Match all activities of ``tracks`` anew that a version before ``version`` has matched, or none; batches of streams are counted from zero, so this one is below."""
    refresh(tracks, store, -version, version, match)
