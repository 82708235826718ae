"""Structured Streaming over events and points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files in a folder; the checkpoint remembers which were read, which is the high-water mark."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(path)


def thinned(points: DataFrame, kinds: list[str] | None = None, stride: int = 5, kind: str = "event_type", order: str = "event_id") -> DataFrame:
    """The filtered activity stream: every so many points of the given kinds."""
    if kinds:
        points = points.where(F.col(kind).isin(kinds))
    return points.where(F.col(order) % stride == 0)


def after_high_water(rows: DataFrame, seen: DataFrame, time: str = "ts") -> DataFrame:
    """Rows later than the latest that was seen; all, if none was."""
    high = seen.agg(F.max(time).alias("_high"))  # one row
    return rows.crossJoin(F.broadcast(high)).where(F.col("_high").isNull() | (F.col(time) > F.col("_high"))).drop("_high")


def sessions(events: DataFrame, gap: str, late: str, by: str = "user_id", time: str = "ts") -> DataFrame:
    """Sessions of each key by a gap in event time; what comes later than ``late`` is left out."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = e.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def empty_days(samples: DataFrame, today: str, trusted_after: int = 7) -> DataFrame:
    """Days of each person with the number of their samples that have a value, and whether to ask again: days without any, until they are old enough to be trusted."""
    g = samples.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("value").alias("n"))
    return g.withColumn("again", (F.col("n") == 0) & (F.datediff(F.to_date(F.lit(today)), "d") < trusted_after))


def late_samples(samples: DataFrame, late: str = "7 days", by: str = "user_id", time: str = "ts") -> DataFrame:
    """The stream form: counts of each person's days that late samples still change until the watermark passes them."""
    s = samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return s.groupBy(by, F.window(time, "1 day").alias("w")).agg(F.count("value").alias("n")).select(by, F.to_date("w.start").alias("d"), "n")


def hourly(events: DataFrame, late: str, time: str = "ts") -> DataFrame:
    """Counts and sums of each hour and type."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def ordered_legs(events: DataFrame, by: str = "user_id", time: str = "ts") -> DataFrame:
    """Seconds since the latest time seen of each key, batch by batch; events back in time count none.

    The state of a key is one time, kept in the state store.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("event_id")
            t = pdf["t"].to_numpy()
            seen = pd.Series(t).cummax().shift(1, fill_value=t[0] if last is None else last).to_numpy()
            if last is not None:
                seen = seen.clip(min=last)
            last = int(max(t.max(), t[0] if last is None else last))
            yield pd.DataFrame({by: key[0], "event_id": pdf["event_id"], "dt": (t - seen).clip(min=0).astype(float)})
        state.update((last,))

    e = events.select(by, "event_id", F.unix_timestamp(F.col(time).cast("timestamp")).alias("t"))
    return e.groupBy(by).applyInPandasWithState(step, f"{by} long, event_id long, dt double", "last long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What the stream gives until all its input is read, in a table of this session."""
    q: StreamingQuery = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def for_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each batch to ``write``, for tables that are changed in place."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
