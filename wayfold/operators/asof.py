"""As-of, nearest and interval joins.

Spark has none of its own.  Nearest and backward joins are a union with fills
over a window; interval joins meet on buckets of time, so that they are equi
joins with a filter and never compare all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(df: DataFrame, on: str) -> Column:
    """A time as a number whose differences count: days of dates, seconds of time stamps."""
    kind = dict(df.dtypes)[on]
    return F.unix_date(on) if kind == "date" else F.unix_micros(F.col(on).cast("timestamp")) / 1_000_000 if kind.startswith("timestamp") else F.col(on)


def asof_backward(left: DataFrame, right: DataFrame, on: str, value: str, by: list[str] | None = None, bucket: float = 32) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its ``on``; null if there is none.

    With keys, both sides meet in a window of each key.  Without, the right
    side's few change points become spans up to the next one, and rows of the
    left meet them on buckets of ``bucket`` days, seconds or units, so that no
    task sees them all.
    """
    cols = left.columns
    if by:
        mine = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
        theirs = right.select(*by, on, F.col(value).alias("_v"), F.lit(0).alias("_side"))
        both = mine.unionByName(theirs, allowMissingColumns=True)
        w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*cols, value)
    # one row for each change point, and one where the left side ends; their order is a window over them alone
    points = right.where(F.col(value).isNotNull()).groupBy(_number(right, on).alias("_lo")).agg(F.max(value).alias(value)).withColumn("_stop", F.lit(False))
    mine = left.withColumn("_at", _number(left, on)).withColumn("_k", F.floor(F.col("_at") / bucket))
    stop = mine.agg(F.max("_at").alias("_lo")).withColumn("_stop", F.lit(True)).where("_lo IS NOT NULL")
    w = Window.orderBy("_lo", "_stop")
    spans = points.unionByName(stop, allowMissingColumns=True).withColumns({"_next": F.lead("_lo").over(w), "_last": F.lead("_stop").over(w)})
    spans = spans.where("NOT _stop AND _next IS NOT NULL")
    spans = spans.select(F.explode(F.sequence(F.floor(F.col("_lo") / bucket), F.floor(F.col("_next") / bucket))).alias("_k2"), "_lo", "_next", "_last", F.col(value).alias("_v"))
    inside = (F.col("_k") == F.col("_k2")) & (F.col("_at") >= F.col("_lo")) & (F.col("_last") | (F.col("_at") < F.col("_next")))
    return mine.join(spans, inside, "left").select(*cols, F.col("_v").alias(value))


def asof_nearest(left: DataFrame, right: DataFrame, on: str, value: str, by: str) -> DataFrame:
    """``right``'s rows, each with the nearest row of ``left`` in ``on``: its ``value``; of two equally near the later one."""
    target = right.select(by, F.col(on).alias("_t"), *[c for c in right.columns if c not in (by, on)])
    rest = [c for c in target.columns if c not in (by, "_t")]
    mine = left.select(by, F.col(on).alias("_t"), F.struct(F.col(on).alias("t"), F.col(value).alias("v")).alias("_p"), F.lit(0).alias("_side"))
    both = mine.unionByName(target.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    back = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("_t", F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)
    b = both.withColumns({"_b": F.last("_p", ignorenulls=True).over(back), "_a": F.first("_p", ignorenulls=True).over(ahead)}).where("_side = 1")
    later = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a.t") - F.col("_t") <= F.col("_t") - F.col("_b.t")))
    return b.select(by, F.col("_t").alias(on), *rest, F.when(later, F.col("_a.v")).otherwise(F.col("_b.v")).alias(value))


def within(left: DataFrame, right: DataFrame, time: str, start: str, end: str, bucket: int, by: list[str] | None = None) -> DataFrame:
    """Rows of ``right`` whose ``time`` is in [start, end] of a row of ``left``, met on buckets of ``bucket`` units."""
    by = by or []
    spans = left.withColumn("_k", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return spans.join(right.withColumn("_k", F.floor(F.col(time) / bucket)), [*by, "_k"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_k")


def heart_zones(samples: DataFrame, first: str, last: str, rest: float, most: float) -> DataFrame:
    """Seconds in five zones of the heart-rate reserve, from pairs of consecutive samples within the activity at most 300 s apart.

    ``samples(activity_id, t, bpm, first, last)``; a bound belongs to the higher zone.
    """
    w = Window.partitionBy("activity_id").orderBy("t")
    s = samples.where((F.col("t") >= F.col(first)) & (F.col("t") <= F.col(last)) & F.col("bpm").isNotNull())
    s = s.withColumns({"dt": F.col("t") - F.lag("t").over(w), "mean": (F.col("bpm") + F.lag("bpm").over(w)) / 2}).where("dt > 0 AND dt <= 300")
    share = (F.col("mean") - rest) / (most - rest)
    zone = sum((F.when(share >= b, 1).otherwise(0) for b in (0.6, 0.7, 0.8, 0.9)), F.lit(0))
    return s.withColumn("zone", zone).groupBy("activity_id").agg(*(F.coalesce(F.sum(F.when(F.col("zone") == k, F.col("dt"))), F.lit(0)).alias(f"z{k + 1}") for k in range(5)))


def coverage(spans: DataFrame, samples: DataFrame, slack: int, start: str = "first", end: str = "last") -> DataFrame:
    """Spans whose samples begin by ``slack`` after the start and end no more than ``slack`` before the end."""
    reach = samples.groupBy("activity_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ok = (F.col("lo") <= F.col(start) + slack) & (F.col("hi") >= F.col(end) - slack)
    return spans.join(reach, "activity_id", "left").withColumn("covered", F.coalesce(ok, F.lit(False))).drop("lo", "hi")


def percentile_by_place(values: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the value at place floor(n q) of the sorted positive ones, from counts of each value, not from a global sort of rows."""
    counts = values.where(F.col(value) > 0).groupBy(value).agg(F.count("*").alias("n"))
    run = counts.withColumns({"upto": F.sum("n").over(Window.orderBy(value)), "total": F.sum("n").over(Window.partitionBy())})
    place = F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(q)))
    return run.where(F.col("upto") > place).agg(F.min(value).alias(value))


def weather_overlap(spans: DataFrame, hours: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each span of seconds the hours (of the same place, with ``by``) that overlap it: least and greatest temperature, rain, snow, greatest wind, and the commonest code, the earliest of equals.

    A span that doesn't end after its start lasts an hour.
    """
    by = by or []
    s = spans.withColumn("end_s", F.when(F.col("end_s") <= F.col("start_s"), F.col("start_s") + 3600).otherwise(F.col("end_s")))
    s = s.withColumn("_k", F.explode(F.sequence(F.floor(F.col("start_s") / 3600), F.floor((F.col("end_s") - 1) / 3600))))
    j = s.join(hours.withColumn("_k", F.floor(F.col("t") / 3600)), [*by, "_k"]).where((F.col("t") + 3600 > F.col("start_s")) & (F.col("t") < F.col("end_s")))
    # by code first, whose counts are few; then over the codes
    g = j.groupBy("activity_id", "code").agg(F.count("*").alias("n"), F.min("t").alias("seen"), F.min("temp").alias("lo"), F.max("temp").alias("hi"), F.sum("rain").alias("rain"), F.sum("snow").alias("snow"), F.max("wind").alias("wind"))
    return g.groupBy("activity_id").agg(F.min("lo").alias("temp_min"), F.max("hi").alias("temp_max"), F.sum("rain").alias("rain"), F.sum("snow").alias("snow"), F.max("wind").alias("wind"), F.max_by("code", F.struct("n", -F.col("seen"))).alias("code"))


def near_in_time(a: DataFrame, b: DataFrame, seconds: int) -> DataFrame:
    """Pairs of ids of two sources whose times are within ``seconds``, met on that bucket and its neighbours."""
    left = a.select(F.col("id").alias("id_a"), F.col("t").alias("t_a")).withColumn("_k", F.explode(F.array(*(F.floor(F.col("t_a") / seconds) + k for k in (-1, 0, 1)))))
    right = b.select(F.col("id").alias("id_b"), F.col("t").alias("t_b"), F.floor(F.col("t") / seconds).alias("_k"))
    return left.join(right, "_k").where(F.abs(F.col("t_a") - F.col("t_b")) <= seconds).select("id_a", "id_b")


def preferred(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(id)`` of the less preferred source that have no twin in ``pairs(id_a, id_b)``."""
    return rows.join(pairs.select(F.col("id_b").alias("id")).distinct(), "id", "left_anti")


def latest_value(rows: DataFrame, value: str, order: str) -> DataFrame:
    """One row: the newest value that isn't null."""
    return rows.agg(F.expr(f"max_by({value}, {order}) FILTER (WHERE {value} IS NOT NULL)").alias(value))


def effective(override: Column, observed: Column, default: float) -> Column:
    return F.coalesce(override, observed, F.lit(default))
