"""The driver's tables as tracks and activities, in DataFrames and in SQL for the oracle.

Tracks are integer running sums over each user's events, scaled at the end,
so that any engine gets the same bits.  Activities are orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tracks as T

AS_OF = "2001-08-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_points(spark: SparkSession, sf_dir: str, jumpy: bool = False) -> DataFrame:
    """Points of all tracks; ``jumpy`` ones have single points thrown off by some 330 m."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.select(
        F.col("user_id").alias("activity_id"), "event_id", "event_type", "ts", (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.when(i % 23 == 0, 240 + i % 60).otherwise(5 + i % 9).alias("step_s"), ((i * 7919) % 11 - 5).alias("dn"), ((i * 6101) % 13 - 4).alias("de"), F.when(i % 23 == 0, F.lit(240).cast("long")).otherwise((i * 104729) % 41 - 22).alias("dz"),
    )
    run = lambda c: F.sum(c).over(T.so_far())
    ele = F.when(i % 17 != 3, 1000.0 + run("dz").cast("double") / 2)
    return steps.select("activity_id", "seq", "event_id", "event_type", "ts", run("step_s").cast("long").alias("t_s"), (50.0 + run("dn").cast("double") / 10000 + (F.when(i % 89 == 7, 0.003).otherwise(0.0) if jumpy else F.lit(0.0))).alias("lat"), (-116.0 + run("de").cast("double") / 10000).alias("lon"), ele.alias("ele"))


def legs(spark: SparkSession, sf_dir: str, jumpy: bool = False) -> DataFrame:
    return T.gap_flags(T.cumulative_km(T.legs(track_points(spark, sf_dir, jumpy))))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("gain"))
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("activity_id"), F.to_date("o_orderdate").alias("d"), F.col("c_mktsegment").alias("type"), F.col("c_nationkey").cast("long").alias("place"), F.col("o_orderstatus").alias("direction"), (F.col("o_totalprice") / 10000).alias("km"), (F.col("o_totalprice") / 150000).alias("hours"), (F.col("o_orderstatus") == "P").alias("assisted"), F.coalesce("n", F.lit(0)).alias("n"), "gain", F.col("o_totalprice").alias("duration"))


def hav(a: str, b: str, c: str, d: str, difference: bool = False) -> str:
    """The haversine as SQL; null if a coordinate is, which least() alone would leave out."""
    dlat, dlon = (f"radians({c}-{a})", f"radians({d}-{b})") if difference else (f"(radians({c})-radians({a}))", f"(radians({d})-radians({b}))")
    return f"(12742000.0*(1+0*({a}+{b}+{c}+{d}))*asin(sqrt(least(1.0, pow(sin({dlat}/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin({dlon}/2),2)))))"


TRK = """trk AS (
SELECT activity_id, seq, event_id, event_type, ts, CAST(SUM(step_s) OVER w AS BIGINT) AS t_s,
  CAST(50 AS DOUBLE) + CAST(SUM(dn) OVER w AS DOUBLE) / 10000 AS lat, CAST(-116 AS DOUBLE) + CAST(SUM(de) OVER w AS DOUBLE) / 10000 AS lon,
  CASE WHEN event_id % 17 = 3 THEN NULL ELSE CAST(1000 AS DOUBLE) + CAST(SUM(dz) OVER w AS DOUBLE) / 2 END AS ele
FROM (SELECT user_id AS activity_id, event_id, event_type, ts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  CASE WHEN event_id % 23 = 0 THEN 240 + event_id % 60 ELSE 5 + event_id % 9 END AS step_s, (event_id * 7919) % 11 - 5 AS dn, (event_id * 6101) % 13 - 4 AS de,
  CASE WHEN event_id % 23 = 0 THEN 240 ELSE (event_id * 104729) % 41 - 22 END AS dz FROM events)
WINDOW w AS (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""

LEGS = f"""{TRK}, leg0 AS (
SELECT *, COALESCE(t_s - LAG(t_s) OVER w, 0) AS dt, COALESCE({hav("LAG(lat) OVER w", "LAG(lon) OVER w", "lat", "lon")}, 0.0) AS dist,
  COALESCE(ele - LAG(ele) OVER w, 0.0) AS ele_delta FROM trk WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
leg1 AS (SELECT *, CASE WHEN dt > 0 AND dist > 0 AND dist / dt * 3.6 <= 150 THEN dist / dt * 3.6 END AS speed, dt >= 200 AND ele_delta >= 100 AS assisted FROM leg0),
legs AS (SELECT *, SUM(dist) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) / 1000 AS dist_km FROM leg1)"""

_LAT = "CAST(SUM(dn) OVER w AS DOUBLE) / 10000 AS lat"
JLEGS = LEGS.replace(_LAT, _LAT.replace(" AS lat", " + CASE WHEN event_id % 89 = 7 THEN CAST(0.003 AS DOUBLE) ELSE 0 END AS lat"))

ACT = """act AS (
SELECT o_orderkey AS activity_id, CAST(o_orderdate AS DATE) AS d, c_mktsegment AS type, CAST(c_nationkey AS BIGINT) AS place, o_orderstatus AS direction,
  o_totalprice / 10000 AS km, o_totalprice / 150000 AS hours, o_orderstatus = 'P' AS assisted, COALESCE(n, 0) AS n, gain, o_totalprice AS duration
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, SUM(l_quantity) AS gain FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
