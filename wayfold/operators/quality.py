"""Data quality: issues of activities, spikes and odd starting hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .tracks import rows, track


#: The issues' codes and severities, in the order of the rules.
SEVERITIES = {"tiny_distance": "low", "tiny_duration": "low", "max_speed": "high", "climb_rate": "med", "teleport": "high", "speed_spike": "med", "jitter": "med"}
RANKS = {"high": 3, "med": 2, "low": 1}


def smoothed_km(points: DataFrame, half: int = 2) -> DataFrame:
    """Length in km of each track's path over positions averaged over 2 * half + 1 points."""
    p = points.select("activity_id", "seq", *(F.avg(c).over(rows(-half, half)).alias(c) for c in ("lat", "lon")))
    back = lambda c: F.lag(c).over(track())
    p = p.withColumn("leg", haversine(back("lat"), back("lon"), F.col("lat"), F.col("lon")))
    return p.groupBy("activity_id").agg(F.sum("leg").alias("smooth_m")).select("activity_id", (F.col("smooth_m") / 1000).alias("smooth_km"))


def issues(points: DataFrame, repaired: Column | None = None) -> DataFrame:
    """Issues of each activity, from points with speeds and spikes: an array of (code, severity), in the order of the rules; spikes of activities that were ``repaired`` are none."""
    s = points.groupBy("activity_id").agg(
        F.max("dist_km").alias("km"), (F.max("t_s") - F.min("t_s")).alias("dur"), F.max("speed").alias("top"), F.sum(F.greatest("ele_delta", F.lit(0.0))).alias("gain"), F.count("*").alias("n"),
        F.count_if("spike").alias("spikes"), F.max(F.when(F.col("spike"), F.col("raw_kmh"))).alias("peak"), F.count_if((F.col("dist") > 1000) & (F.col("dt") < 300)).alias("jumps"),
    )
    s = s.join(smoothed_km(points), "activity_id")
    holds = {
        "tiny_distance": F.col("km") < 0.2,
        "tiny_duration": (F.col("dur") > 0) & (F.col("dur") < 60),
        "max_speed": F.col("top") > 150,
        "climb_rate": (F.col("km") > 0.5) & (F.col("gain") / F.nullif("km", F.lit(0.0)) > 200),
        "teleport": F.col("jumps") > 0,
        "speed_spike": flagged(F.col("spikes"), F.col("peak")) & ~(F.lit(False) if repaired is None else repaired),
        "jitter": (F.col("n") >= 30) & (F.col("km") > 1) & (F.col("km") / F.nullif("smooth_km", F.lit(0.0)) > 1.3),
    }
    found = F.array(*(F.when(holds[code], F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for code, level in SEVERITIES.items()))
    return s.select("activity_id", F.filter(found, lambda i: i.isNotNull()).alias("issues"))


def report(found: DataFrame, approved: DataFrame, dates: DataFrame) -> DataFrame:
    """Issues other than spikes and approved ones, of activities that have any left: newest first, then the worst severity, then the most."""
    ok = approved.groupBy("activity_id").agg(F.collect_set("code").alias("ok"))
    left = F.filter("issues", lambda i: (i["code"] != "speed_spike") & ~F.coalesce(F.array_contains("ok", i["code"]), F.lit(False)))
    r = found.join(ok, "activity_id", "left").withColumn("issues", left).where(F.size("issues") > 0).drop("ok").join(dates, "activity_id")
    rank = F.transform("issues", lambda i: F.coalesce(*(F.when(i["severity"] == k, v) for k, v in RANKS.items())))
    return r.withColumns({"worst": F.array_max(rank), "n": F.size("issues")}).orderBy(F.desc("d"), F.desc("worst"), F.desc("n"), "activity_id")


def flagged(spikes: Column, peak: Column) -> Column:
    return (spikes >= 3) | ((spikes >= 1) & (peak >= 80))


def spike_flagged(points: DataFrame) -> DataFrame:
    """Activities with three spikes or one of 80 km/h."""
    g = points.where("spike").groupBy("activity_id").agg(F.count("*").alias("spikes"), F.max("raw_kmh").alias("peak"))
    return g.where(flagged(F.col("spikes"), F.col("peak")))


def spike_list(points: DataFrame, skipped: DataFrame) -> DataFrame:
    """Spike-flagged activities, but for ``skipped`` ones (left out of statistics, repaired or approved): the highest peak first, then the most spikes."""
    return spike_flagged(points).join(skipped, "activity_id", "left_anti").orderBy(F.desc("peak"), F.desc("spikes"), "activity_id")


def odd_starts(starts: DataFrame, zone: Column) -> DataFrame:
    """Activities that start from 21 to 6 o'clock by the local clock."""
    s = starts.withColumn("hour", F.hour(F.from_utc_timestamp(F.col("start").cast("timestamp"), zone)))
    return s.where(F.col("hour").isin(21, 22, 23, 0, 1, 2, 3, 4, 5, 6))
