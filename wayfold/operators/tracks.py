"""Operators over points of tracks: legs, smoothing, segments, activity statistics and edits.

Points have ``activity_id, seq, lat, lon, ele, t_s``; the operators partition
by activity and order by ``seq``, so that a track is never split and no track
sees another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geo import haversine, local_x, local_y, sinuosity
from ..functions.stats import median_avg, median_upper

def track() -> WindowSpec:
    """Points of an activity in their order."""
    return Window.partitionBy("activity_id").orderBy("seq")


def whole() -> WindowSpec:
    return Window.partitionBy("activity_id")


def rows(a: int, b: int) -> WindowSpec:
    return track().rowsBetween(a, b)


def so_far() -> WindowSpec:
    return track().rowsBetween(Window.unboundedPreceding, 0)


def ahead() -> WindowSpec:
    return track().rowsBetween(0, Window.unboundedFollowing)


#: Speeds above this are no speeds, in km/h.
MOST_SPEED = 150.0


def legs(points: DataFrame, guard: bool = True) -> DataFrame:
    """Seconds, metres, km/h and metres of ascent from the point before; zeros at the first.

    With ``guard`` a leg back in time counts neither time nor distance.
    """
    before = lambda c: F.lag(c).over(track())
    dt = F.coalesce(F.col("t_s") - before("t_s"), F.lit(0))
    dist = F.coalesce(haversine(before("lat"), before("lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    out = points.withColumns({"dt": dt, "dist": dist, "ele_delta": F.coalesce(F.col("ele") - before("ele"), F.lit(0.0))})
    if guard:
        out = out.withColumns({"dt": F.greatest(F.col("dt"), F.lit(0)), "dist": F.when(F.col("dt") < 0, 0.0).otherwise(F.col("dist"))})
    speed = F.when((F.col("dt") > 0) & (F.col("dist") > 0), F.col("dist") / F.nullif(F.col("dt"), F.lit(0)) * 3.6)
    return out.withColumn("speed", F.when(speed <= MOST_SPEED, speed))


def cumulative_km(points: DataFrame) -> DataFrame:
    """Kilometres from the start of the track."""
    return points.withColumn("dist_km", F.sum("dist").over(so_far()) / 1000)


def bounding_boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("activity_id").agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


def track_sinuosity(points: DataFrame) -> DataFrame:
    """Length of the path over that of the straight line, for each track."""
    ends = points.groupBy("activity_id").agg(F.sum("dist").alias("path_m"), *(F.min_by(c, "seq").alias(f"{c}0") for c in ("lat", "lon")), *(F.max_by(c, "seq").alias(f"{c}1") for c in ("lat", "lon")))
    straight = haversine(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    return ends.select("activity_id", "path_m", straight.alias("straight_m"), sinuosity(F.col("path_m"), straight).alias("sinuosity"))


def range_sums(points: DataFrame, spans: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` over (start, end] of each of ``spans(activity_id, start, end)``, as a difference of running sums."""
    running = points.select("activity_id", "seq", F.sum(value).over(so_far()).alias("run"))
    low = running.select("activity_id", F.col("seq").alias("start"), F.col("run").alias("low"))
    high = running.select("activity_id", F.col("seq").alias("end"), F.col("run").alias("high"))
    return spans.join(low, ["activity_id", "start"]).join(high, ["activity_id", "end"]).select("activity_id", "start", "end", (F.col("high") - F.col("low")).alias("total"))


def localised(points: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Metres east and north of an origin."""
    return points.withColumns({"x": local_x(F.col("lon"), F.lit(lat0), F.lit(lon0)), "y": local_y(F.col("lat"), F.lit(lat0))})


def local_times(points: DataFrame, zone: Column, fake_utc: Column, stamp: str = "ts") -> DataFrame:
    """Wall-clock and instant: producers of fake UTC have wall-clock times already, others are converted."""
    instant = F.when(fake_utc, F.to_utc_timestamp(F.col(stamp), zone)).otherwise(F.col(stamp))
    return points.withColumns({"instant": instant, "local": F.from_utc_timestamp(instant, zone)})


# ---------------------------------------------------------------- smoothing


def smooth_speed(points: DataFrame, k: int = 5) -> DataFrame:
    """Centred median of the speeds, nulls left out; where all are null, the speed as it is."""
    around = F.collect_list("speed").over(rows(-(k // 2), k // 2))
    return points.withColumn("speed_sm", F.coalesce(median_avg(around), F.col("speed")))


def smooth_elevation(points: DataFrame, half: int = 10, out: str = "ele_sm") -> DataFrame:
    """Centred mean of elevation over 2 * half + 1 points, nulls left out."""
    return points.withColumn(out, F.avg("ele").over(rows(-half, half)))


def smooth_upper_median(points: DataFrame, value: str, window: int = 9) -> DataFrame:
    """Centred upper median; tracks of fewer than three points stay."""
    around = F.collect_list(value).over(rows(-(window // 2), window // 2))
    return points.withColumn(f"{value}_sm", F.when(F.count("*").over(whole()) < 3, F.col(value)).otherwise(median_upper(around)))


def smooth_positions(points: DataFrame, window: int, start_km: float | None = None, end_km: float | None = None) -> DataFrame:
    """Moving average of positions, optionally within a range of km; neighbours come from the whole track.

    The window is held to 1..15; tracks shorter than it stay.
    """
    half = max(1, min(15, window)) // 2
    inside = F.lit(True)
    if start_km is not None:
        inside &= F.col("dist_km") >= start_km
    if end_km is not None:
        inside &= F.col("dist_km") <= end_km
    inside &= F.count("*").over(whole()) >= window
    return points.withColumns({f"{c}_sm": F.when(inside, F.avg(c).over(rows(-half, half))).otherwise(F.col(c)) for c in ("lat", "lon")})


def gain_loss(points: DataFrame, half: int = 3) -> DataFrame:
    """Ascent and descent of each track over a smoothed elevation; points without elevation are left out first."""
    sm = smooth_elevation(points.where("ele IS NOT NULL"), half)
    delta = sm.withColumn("d", F.col("ele_sm") - F.lag("ele_sm").over(track()))
    return delta.groupBy("activity_id").agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("gain_m"), F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0.0)).alias("loss_m"))


def gain_by_hysteresis(points: DataFrame, threshold: float) -> DataFrame:
    """Ascent counted only once it exceeds a threshold from the last accepted elevation, by a fold over the track."""
    series = points.where("ele IS NOT NULL").groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ele"))).alias("s"))
    zero = F.struct(F.col("s")[0]["ele"].alias("at"), F.lit(0.0).alias("gain"))
    step = lambda a, p: F.struct(F.when(F.abs(p["ele"] - a["at"]) >= threshold, p["ele"]).otherwise(a["at"]).alias("at"), (a["gain"] + F.when(p["ele"] - a["at"] >= threshold, p["ele"] - a["at"]).otherwise(0.0)).alias("gain"))
    return series.select("activity_id", F.aggregate("s", zero, step)["gain"].alias("gain_m"))


def gain_strategies(points: DataFrame, windows: tuple[int, ...] = (10, 15, 20)) -> DataFrame:
    """Ascent of each track from its elevations as they are, and from means over each of ``windows``; see ``gain_by_hysteresis`` for the others, which may follow a mean."""
    e = points.where("ele IS NOT NULL").select("activity_id", "seq", "ele", *(F.avg("ele").over(rows(-(k // 2), k // 2)).alias(f"_m{k}") for k in windows))
    up = lambda c: F.greatest(F.col(c) - F.lag(c).over(track()), F.lit(0.0))
    e = e.select("activity_id", up("ele").alias("raw"), *(up(f"_m{k}").alias(f"ma_{k}") for k in windows))
    return e.groupBy("activity_id").agg(*(F.sum(c).alias(c) for c in e.columns[1:]))


def spikes(points: DataFrame) -> DataFrame:
    """Legs that are far faster than their neighbours, with their speed as ``raw_kmh``: above four times the upper median of the ten legs on either side, and above 40 km/h.

    Speeds here are distance over time as they come, whatever the bound on
    speeds elsewhere.  Legs that touch an assisted point are left out, of the
    neighbours too, and so are tracks of fewer than 21 points.
    """
    clear = ~F.col("assisted") & ~F.coalesce(F.lag("assisted").over(track()), F.lit(False)) & (F.col("dt") > 0)
    raw = F.when(clear, F.col("dist") / F.nullif(F.col("dt"), F.lit(0)) * 3.6)
    fast = F.when(F.col("raw_kmh") > 0, F.col("raw_kmh"))
    around = F.concat(F.collect_list(fast).over(rows(-10, -1)), F.collect_list(fast).over(rows(1, 10)))
    limit = F.greatest(4 * median_upper(around), F.lit(40.0))
    spike = (F.count("*").over(whole()) >= 21) & (F.size(around) > 0) & (F.col("raw_kmh") > limit)
    return points.withColumn("raw_kmh", raw).withColumn("spike", F.coalesce(spike, F.lit(False)))


# ---------------------------------------------------------------- segments and statistics


def gap_flags(points: DataFrame, seconds: int = 200, climb: float = 100.0) -> DataFrame:
    """Assisted where a long gap in time goes up much."""
    return points.withColumn("assisted", (F.col("dt") >= seconds) & (F.col("ele_delta") >= climb))


def segments(points: DataFrame) -> DataFrame:
    """Runs of equal flags; neighbours share the point between them; the first point's flag doesn't count, a track starts riding."""
    flag = F.when(F.col("seq") == 0, False).otherwise(F.col("assisted"))
    p = points.withColumn("flag", flag)
    p = p.withColumn("run", F.sum(F.when(F.col("flag") != F.lag("flag").over(track()), 1).otherwise(0)).over(so_far()))
    out = p.groupBy("activity_id", "run").agg(F.first("flag").alias("flag"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    return out.select("activity_id", F.col("run").cast("long").alias("seg_no"), F.when(F.col("flag"), "assisted").otherwise("riding").alias("type"), F.greatest(F.when(F.col("run") > 0, F.col("lo") - 1).otherwise(F.col("lo")), F.lit(0)).cast("long").alias("start_seq"), F.col("hi").cast("long").alias("end_seq"))


def lift_counts(points: DataFrame) -> DataFrame:
    """Number of assisted runs."""
    rise = F.col("assisted") & ~F.coalesce(F.lag("assisted").over(track()), F.lit(False)) & (F.col("seq") > 0)
    return points.withColumn("rise", rise).groupBy("activity_id").agg(F.count_if("rise").alias("lift_count"))


def riding_sums(points: DataFrame, ele: str = "ele_sm") -> DataFrame:
    """Distance, ascent, descent and seconds of riding, and ascent of assisted legs, over a smoothed elevation."""
    p = points.withColumn("d", F.coalesce(F.col(ele) - F.lag(ele).over(track()), F.lit(0.0)))
    on = ~F.col("assisted")
    pick = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    return p.groupBy("activity_id").agg(
        (pick(on, F.col("dist")) / 1000).alias("distance_km"), pick(on & (F.col("d") > 0), F.col("d")).alias("elev_gain_m"), pick(on & (F.col("d") < 0), -F.col("d")).alias("elev_loss_m"), pick(~on & (F.col("d") > 0), F.col("d")).alias("assisted_gain_m"), F.coalesce(F.sum(F.when(on, F.col("dt"))), F.lit(0)).cast("long").alias("riding_s")
    )


def activity_stats(points: DataFrame) -> DataFrame:
    """Duration (null if zero), average speed while riding, maxima and peak (null if zero)."""
    base = riding_sums(smooth_elevation(points))
    more = points.groupBy("activity_id").agg((F.max("t_s") - F.min("t_s")).alias("d"), F.max("speed_sm").alias("max_speed_kmh"), F.max(F.when(~F.col("assisted"), F.col("speed_sm"))).alias("max_speed_kmh_riding"), F.max("ele").alias("peak"))
    out = base.join(more, "activity_id")
    return out.select(*base.columns, F.nullif("d", F.lit(0)).cast("long").alias("duration_sec"), (F.col("distance_km") / F.nullif(F.col("riding_s") / 3600, F.lit(0.0))).alias("avg_speed_kmh"), "max_speed_kmh", "max_speed_kmh_riding", F.nullif("peak", F.lit(0.0)).alias("peak_ele_m"))


def segment_sums(points: DataFrame, segs: DataFrame, closed: bool = False) -> DataFrame:
    """Of each segment: distance and ascent over (start, end], or with ``closed`` over [start, end], greatest speed over [start, end]."""
    p = points.select("activity_id", "seq", "dist", "ele_delta", "speed")
    s = segs.withColumn("seq", F.explode(F.sequence("start_seq", "end_seq")))
    both = s.join(p, ["activity_id", "seq"])
    inner = F.lit(True) if closed else F.col("seq") > F.col("start_seq")
    return both.groupBy("activity_id", "seg_no", "type").agg(F.sum(F.when(inner, F.col("dist")).otherwise(0.0)).alias("dist_m"), F.sum(F.when(inner & (F.col("ele_delta") > 0), F.col("ele_delta")).otherwise(0.0)).alias("gain_m"), F.max("speed").alias("max_speed"))


def sparklines(points: DataFrame, n: int = 40) -> DataFrame:
    """About ``n`` elevations of each track, those of points at an even stride that have one; null if they are fewer than two."""
    p = points.withColumn("place", F.row_number().over(track()) - 1).withColumn("total", F.count("*").over(whole()))
    p = p.where(f"place % greatest(1, total div {n}) = 0")
    line = F.array_sort(F.collect_list(F.when(F.col("ele").isNotNull(), F.struct("seq", "ele"))))
    out = p.groupBy("activity_id").agg(F.transform(line, lambda s: s["ele"]).alias("spark"))
    return out.withColumn("spark", F.when(F.size("spark") >= 2, F.col("spark")))


def thumbnails(points: DataFrame, n: int = 20) -> DataFrame:
    """``n`` evenly placed points of each track and its last; shorter tracks as they are."""
    p = points.withColumn("total", F.count("*").over(whole()))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("total") / n))
    keep = (F.col("total") <= n) | F.array_contains(places, F.col("seq").cast("bigint")) | (F.col("seq") == F.col("total") - 1)
    return p.where(keep).select("activity_id", "seq", "lat", "lon")


def decimated(points: DataFrame, most: int) -> DataFrame:
    """Every k-th point so that about ``most`` remain, and the last."""
    p = points.withColumn("total", F.count("*").over(whole()))
    stride = F.greatest(F.lit(1), F.floor(F.col("total") / most))
    return p.where((F.col("seq") % stride == 0) | (F.col("seq") == F.col("total") - 1)).select("activity_id", "seq", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


# ---------------------------------------------------------------- edits


def shifted(points: DataFrame, hours: int, stamp: str = "ts") -> DataFrame:
    """Times moved by whole hours, within -23..23, and the date of each track's start derived anew."""
    hours = max(-23, min(23, hours))
    moved = points.withColumn(stamp, F.col(stamp) + F.make_dt_interval(hours=F.lit(hours)))
    return moved.withColumn("date", F.to_date(F.min(stamp).over(whole())))


def trimmed(points: DataFrame, start_km: float, end_km: float) -> DataFrame:
    """Points from the first at or beyond ``start_km`` to the last at or before ``end_km``, with seq and km from zero.

    An inverted range, or one that keeps fewer than two points, changes nothing.
    """
    lo = F.min(F.when(F.col("dist_km") >= start_km, F.col("seq"))).over(whole())
    hi = F.max(F.when(F.col("dist_km") <= end_km, F.col("seq"))).over(whole())
    p = points.withColumns({"lo": lo, "hi": hi}).withColumn("all", F.coalesce(F.col("hi") <= F.col("lo"), F.lit(True)))
    p = p.where("all OR seq BETWEEN lo AND hi")
    base = F.min("dist_km").over(whole())
    return p.withColumns({"dist_km": F.when(F.col("all"), F.col("dist_km")).otherwise(F.col("dist_km") - base), "seq": F.when(F.col("all"), F.col("seq")).otherwise(F.col("seq") - F.col("lo"))}).drop("lo", "hi", "all")


def rederived(points: DataFrame, leg_km: Column, places: int = 2) -> DataFrame:
    """``points`` with km so far from ``leg_km`` (to 4 decimals), and speeds from them, smoothed; a first point without speed has the second's."""
    p = points.withColumn("_leg", leg_km).withColumn("dist_km", F.round(F.sum("_leg").over(so_far()), 4))
    step = F.col("dist_km") - F.lag("dist_km").over(track())
    p = p.withColumn("speed", F.when(F.col("dt") > 0, step / (F.nullif(F.col("dt"), F.lit(0)) / 3600)))
    p = smooth_speed(p).withColumn("speed", F.round("speed_sm", places))
    first = F.coalesce("speed", F.lead("speed").over(track()))
    return p.withColumn("speed", F.when(F.col("seq") == F.min("seq").over(whole()), first).otherwise(F.col("speed"))).drop("_leg", "speed_sm")


def repaired(points: DataFrame, places: int = 2) -> DataFrame:
    """Tracks without their spikes: a spike's leg has the upper median length of the clean legs among the ten on either side, its point stands where the last clean one before (or else the first after) does; km and speeds are derived anew.

    Tracks without a spike, and of fewer than three points, stay as they are.
    """
    leg = F.col("dist") / 1000
    clean_leg = F.when(~F.col("spike") & (F.col("seq") > 0), leg)
    around = F.concat(F.collect_list(clean_leg).over(rows(-10, -1)), F.collect_list(clean_leg).over(rows(1, 10)))
    any_spike = F.bool_or("spike").over(whole()) & (F.count("*").over(whole()) >= 3)
    p = points.withColumns({"_fix": any_spike, "_leg_km": F.when(F.col("spike"), F.coalesce(median_upper(around), F.lit(0.0))).otherwise(leg), "_km": F.col("dist_km"), "_speed": F.col("speed")})
    clean = lambda c: F.when(~F.col("spike"), F.col(c))
    p = p.withColumns({c: F.coalesce(F.last(clean(c), ignorenulls=True).over(so_far()), F.first(clean(c), ignorenulls=True).over(ahead()), F.col(c)) for c in ("lat", "lon")})
    p = rederived(p, F.col("_leg_km"), places)
    return p.withColumns({"dist_km": F.when(F.col("_fix"), F.col("dist_km")).otherwise(F.col("_km")), "speed": F.when(F.col("_fix"), F.coalesce("speed", "_speed")).otherwise(F.col("_speed"))}).drop("_fix", "_leg_km", "_km", "_speed")


def smoothed_track(points: DataFrame, window: int, places: int = 2) -> DataFrame:
    """Tracks with smoothed positions, and km and speeds derived anew from them; ``points`` has km and seconds."""
    p = smooth_positions(points, window).drop("lat", "lon").withColumnsRenamed({"lat_sm": "lat", "lon_sm": "lon"})
    back = lambda c: F.lag(c).over(track())
    leg = F.coalesce(haversine(back("lat"), back("lon"), F.col("lat"), F.col("lon")), F.lit(0.0)) / 1000
    return rederived(p, leg, places)


def edited(points: DataFrame, hours: int = 0, start_km: float | None = None, end_km: float | None = None, repair: bool = False, window: int = 0, shift: bool = True, trim: bool = True, repairs: bool = True, smoothing: bool = True) -> DataFrame:
    """The edits of a track in their fixed order: shift, trim, repair, smooth; ``shift``, ``trim``, ``repairs`` and ``smoothing`` bypass one each where false."""
    if shift and hours:
        points = shifted(points, hours)
    if trim and start_km is not None and end_km is not None:
        points = trimmed(points, start_km, end_km)
    if repairs and repair:
        points = repaired(spikes(points))
    if smoothing and window:
        points = smoothed_track(points, window)
    return points


def clipped(segments_: DataFrame, cuts: DataFrame) -> DataFrame:
    """Segments within ``cuts(activity_id, lo, hi)``, counted from ``lo``; those of which no leg is left go."""
    s = segments_.join(cuts, "activity_id")
    start, end = F.greatest("start_seq", "lo") - F.col("lo"), F.least("end_seq", "hi") - F.col("lo")
    return s.withColumns({"start_seq": start, "end_seq": end}).where("end_seq > start_seq").drop("lo", "hi")


def overridden(computed: DataFrame, overrides: DataFrame) -> DataFrame:
    """Segments of ``overrides`` where an activity has any, else the computed ones."""
    mine = computed.join(overrides.select("activity_id").distinct(), "activity_id", "left_anti")
    return mine.unionByName(overrides.select(*computed.columns))


def unwrapped(points: DataFrame, angle: str) -> DataFrame:
    """Running sum of the differences of an angle, each held to (-pi, pi]."""
    d = F.col(angle) - F.lag(angle).over(track())
    turn = d - 2 * F.pi() * F.ceil((d - F.pi()) / (2 * F.pi()))
    return points.withColumn(f"{angle}_unwrapped", F.first(angle).over(so_far()) + F.sum(F.coalesce(turn, F.lit(0.0))).over(so_far()))


def filled(points: DataFrame, value: str) -> DataFrame:
    """Nulls filled from the last value before, or else the first after."""
    return points.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(so_far()), F.first(value, ignorenulls=True).over(ahead())))
