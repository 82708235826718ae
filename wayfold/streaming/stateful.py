"""Streams with state of their own, and joins of two streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.lineage import new_folder

STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB, beside the executors' memory."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def ordered_legs(events: DataFrame, late: str = "1 day", expire: int = 7 * 86400, by: str = "user_id", time: str = "ts") -> DataFrame:
    """``by``, ``event_id`` and ``dt``: seconds since the latest time seen of each key, in the order of event_id within a batch; events back in time count none.

    Rows later than ``late`` are left out; a key without events for ``expire``
    seconds, as the watermark has it, starts anew.  Start it within ``rocks``.
    The state of a key, one time and when it ends, comes and goes with the rows,
    so that a key of few events costs no calls of its own.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(p["event_id"].to_numpy(), p["t"].to_numpy()) for p in batches]
        ids, t = (np.concatenate(c) for c in zip(*parts, strict=True))  # one batch of one key
        order = np.argsort(ids, kind="stable")
        ids, t = ids[order], t[order]
        latest = np.maximum.accumulate(np.concatenate([[state.get[0] if state.exists else t[0]], t]))
        last = int(latest[-1])
        if (last + expire) * 1000 > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp((last + expire) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({by: np.full(len(ids), key[0]), "event_id": ids, "dt": np.maximum(t - latest[:-1], 0).astype(float)})

    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    e = e.select(by, "event_id", time, F.unix_timestamp(time).alias("t"))
    return e.groupBy(by).applyInPandasWithState(step, f"{by} long, event_id long, dt double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def with_samples(points: DataFrame, samples: DataFrame, within: str = "30 seconds", late: str = "10 minutes", by: str = "user_id", time: str = "ts") -> DataFrame:
    """Each of two streams' pairs of a point and a sample of its key at most ``within`` before or after it.

    Both sides have a watermark, and the interval bounds how long a row can
    still find a partner: Spark drops it from the state then.  Columns of the
    samples are prefixed by ``s_``.  On tables the same join is a batch join.
    """
    p = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    s = samples.withColumn(time, F.col(time).cast("timestamp"))
    s = s.select(*(F.col(c).alias(f"s_{c}") for c in s.columns)).withWatermark(f"s_{time}", late)
    span = F.expr(f"INTERVAL {within}")
    return p.join(s, (F.col(by) == F.col(f"s_{by}")) & F.col(f"s_{time}").between(F.col(time) - span, F.col(time) + span))


def files_each(rows: DataFrame, files: int, size: int = 1_000_000) -> int:
    """Files for each of ``files`` arrivals of a table, so that each has about ``size`` rows, or one if there are fewer."""
    return max(1, rows.count() // (files * size))


def arrivals(rows: DataFrame, order: str, files: int, path: str | None = None, each: int = 1) -> str:
    """``rows`` as a folder of ``files`` arrivals of ``each`` files, written one after the other in the order of a column: input for a stream that takes ``each`` files at a time.

    Rows are dealt in turn, so with many times ``each`` rows to an arrival none of its files is missing.
    """
    path = path or new_folder(rows.sparkSession)
    cuts = rows.approxQuantile(order, [k / files for k in range(1, files)], 0.01)
    part = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(files):
        some = rows.where(part == k)
        (some.coalesce(1) if each == 1 else some.repartition(each)).write.mode("append").parquet(path)
    return path


def settled(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream appends until all its input is read, as Parquet files in the shared folder, read from there."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
