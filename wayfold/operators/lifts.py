"""Detection with known lifts, and refinement of detected spans; all by joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .kernels import COMPOSED, candidate_segments, rides_between
from .network import close_pairs


def _lines(lifts: DataFrame) -> DataFrame:
    """The first of lifts with the same ends: the others have its rides and are as far from any point."""
    return lifts.groupBy("alat", "alon", "blat", "blon").agg(F.min("lift").alias("lift"))


def _near(points: DataFrame, lifts: DataFrame, metres: float) -> DataFrame:
    """``points`` within ``metres`` of an end of a lift: ``lifts(lift, alat, alon, blat, blon)``.

    Points are dealt by their track, in a number of partitions that adaptive
    execution keeps (one more than usual, or Spark leaves the exchange out after
    another by track), for a few small rows become many; what follows by track
    needs no further shuffle where the ends are broadcast.
    """
    end = lambda k: lifts.select("lift", F.lit(k).alias("stop"), F.col(f"{k}lat").alias("lata"), F.col(f"{k}lon").alias("lona"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = points.withColumnsRenamed({"lat": "latb", "lon": "lonb"}).repartition(parts + 1, "activity_id")
    return close_pairs(end("a").unionByName(end("b")), p, metres).drop("lata", "lona", "latb", "lonb")


def station_rides(legs: DataFrame, lifts: DataFrame, metres: float = 100.0, least_s: int = 60, most_s: int = 1800, gain: float = 50.0, every: bool = True) -> DataFrame:
    """Rides from one station of a lift to the other, in either direction: from the first point near the one after the last ride to the first near the other within the time, if the climb between is ``gain``; it is the sum of ``ele_delta``, to which points without elevation add nothing.

    Lifts with the same ends have the same rides, which are found once; of these but the first lift's unless ``every``.
    """
    up = F.sum("ele_delta").over(Window.partitionBy("activity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    p = legs.select("activity_id", "seq", "t_s", "lat", "lon", up.alias("up"))
    rides = rides_between(_near(p, _lines(lifts), metres).select("activity_id", F.col("lift").cast("long"), "seq", "t_s", "up", "stop"), least_s, most_s, gain)
    if not every:
        return rides
    alike = lifts.select(F.col("lift").cast("long"), F.min("lift").over(Window.partitionBy("alat", "alon", "blat", "blon")).cast("long").alias("_first"))
    return rides.withColumnRenamed("lift", "_first").join(alike, "_first").select("activity_id", "lift", "start", "end")


def snapped_spans(points: DataFrame, spans: DataFrame, lifts: DataFrame, samples: int = 60, metres: float = 250.0) -> DataFrame:
    """Of each span the lift and the points near its two ends, from ``samples`` before the span's to less than that after, of least summed distance; the first of equals.

    Where lifts are many, most spans have one whose ends are near.  A search
    within a part of ``metres`` settles those of a sum of at most that: any
    lift with an end farther away has a greater one.
    """
    points, rest = points.select("activity_id", "seq", "lat", "lon"), spans.select("activity_id", "start", "end")
    out = []
    for reach in (metres / 4, metres / 2):
        out.append(cut(_snapped(points, rest, lifts, samples, reach).where(F.col("_d") <= reach)))
        rest = cut(rest.join(out[-1], ["activity_id", "start", "end"], "left_anti"))
    out.append(_snapped(points, rest, lifts, samples, metres))
    return reduce(DataFrame.unionByName, out).drop("_d")


def _snapped(points: DataFrame, spans: DataFrame, lifts: DataFrame, samples: int, metres: float) -> DataFrame:
    at = points.join(spans, "activity_id")
    at = at.where(f"(seq >= start - {samples} AND seq < start + {samples}) OR (seq >= `end` - {samples} AND seq < `end` + {samples})")
    near = _near(at, _lines(lifts), metres)
    # the nearest point of either end's, by the way a lift is taken; a span and a lift keep two candidates
    by = ["activity_id", "start", "end", "lift"]
    best = lambda end, stop: F.min(F.when((F.col("stop") == stop) & (F.col("seq") >= F.col(end) - samples) & (F.col("seq") < F.col(end) + samples), F.struct("d", "seq")))
    g = near.groupBy(*by).agg(*(best(e, k).alias(f"{e}_{k}") for e in ("start", "end") for k in "ab"))
    ways = F.array(*(F.struct(F.lit(k).alias("stop0"), F.col(f"start_{k}").alias("s"), F.col(f"end_{o}").alias("e")) for k, o in ("ab", "ba")))
    both = g.select(*by, F.explode(ways).alias("x")).select(*by, "x.stop0", F.col("x.s.seq").alias("from"), F.col("x.e.seq").alias("to"), (F.col("x.s.d") + F.col("x.e.d")).alias("_d")).where("`to` > `from`")
    w = Window.partitionBy("activity_id", "start", "end").orderBy("_d", "lift", "stop0")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select("activity_id", "start", "end", "lift", "from", "to", "_d")


def station_flags(legs: DataFrame, lifts: DataFrame, **how) -> DataFrame:
    """Points on ``station_rides``."""
    rides = station_rides(legs, lifts, **how, every=False)
    return _points_of(rides.select("activity_id", F.col("start").alias("from"), F.col("end").alias("to")))


def _points_of(spans: DataFrame, *by: str) -> DataFrame:
    return spans.select(*by, "activity_id", F.explode(F.sequence("from", "to")).alias("seq")).distinct()


def detected(legs: DataFrame, lifts: DataFrame, names: list[str]) -> DataFrame:
    """Assisted points (algorithm, activity_id, seq) by each of ``names``: ``osm``, or a detector of ``COMPOSED``.

    Segments of the detector's flags that climb enough are snapped to a lift where one matches, else trimmed.
    """
    composed = [n for n in names if n in COMPOSED]
    out = []
    if "osm" in names or any("osm" in COMPOSED[n][0] for n in composed):
        osm = cut(station_flags(legs, lifts))  # keys alone, read twice
        flagged = legs.join(osm.withColumn("osm", F.lit(True)), ["activity_id", "seq"], "left").withColumn("osm", F.coalesce("osm", F.lit(False)))
    else:
        flagged = legs.withColumn("osm", F.lit(False))
    if "osm" in names:
        out.append(osm.select(F.lit("osm").alias("algorithm"), "activity_id", "seq"))
    if composed:
        segments = cut(candidate_segments(flagged, composed))  # read twice, and small beside the legs
        snapped = snapped_spans(legs, segments.select("activity_id", "start", "end").distinct(), lifts).select("activity_id", "start", "end", F.col("from").alias("_from"), F.col("to").alias("_to"))
        ends = segments.join(snapped, ["activity_id", "start", "end"], "left").withColumns({"from": F.coalesce("_from", "from"), "to": F.coalesce("_to", "to")})
        out.append(_points_of(ends, "algorithm"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def trimmed_to_cable_speed(points: DataFrame, spans: DataFrame, kmh: float = 6.0, most: int = 45) -> DataFrame:
    """Spans from the first point of cable speed among their first ``most`` or quarter of points to the last one among as many at their end; an end without one stays."""
    reach = F.least(F.lit(most), F.floor((F.col("end") - F.col("start")) / 4))
    j = spans.withColumn("reach", reach).join(points.where(F.col("speed") >= kmh).select("activity_id", "seq"), "activity_id", "left")
    head, tail = F.expr("seq >= start AND seq < start + reach"), F.expr("seq > `end` - reach AND seq <= `end`")
    g = j.groupBy("activity_id", "start", "end").agg(F.min(F.when(head, F.col("seq"))).alias("first"), F.max(F.when(tail, F.col("seq"))).alias("last"))
    return g.select("activity_id", "start", "end", F.coalesce("first", "start").alias("from"), F.coalesce("last", "end").alias("to"))


def trimmed_to_slowest(points: DataFrame, spans: DataFrame, samples: int = 30) -> DataFrame:
    """Spans between the slowest points within ``samples`` of either end; the first of equals."""
    j = spans.join(points.select("activity_id", "seq", F.coalesce("speed", F.lit(0.0)).alias("speed")), "activity_id")
    near = lambda c: F.min_by(F.when(c, F.col("seq")), F.when(c, F.struct("speed", "seq")))
    first, last = F.col("seq").between(F.col("start"), F.least(F.col("start") + samples, F.col("end"))), F.col("seq").between(F.greatest(F.col("end") - samples, F.col("start")), F.col("end"))
    g = j.where("seq BETWEEN start AND `end`").groupBy("activity_id", "start", "end").agg(near(first).alias("from"), near(last).alias("to"))
    return g.select("activity_id", "start", "end", "from", "to")
