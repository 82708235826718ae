"""Queries of the engine's operators over the driver's tables, each beside its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, stats
from ..functions.order import numbered
from ..functions.lineage import cut
from ..operators import asof, lifts, network, reports, routes, similarity, spatial
from ..operators import tracks as T
from .bindings import ACT, AS_OF, JLEGS, LEGS, TRK, activities, hav, legs, read, track_points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROWS = "PARTITION BY activity_id ORDER BY seq ROWS BETWEEN"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rnd(c, places: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# ---------------------------------------------------------------- legs


@query("leg_01", f"WITH {LEGS} SELECT activity_id, seq, round(dist, 4) AS dist FROM legs")
def leg_01(spark, d):
    return legs(spark, d).select("activity_id", "seq", rnd("dist", 4).alias("dist"))


@query("leg_02", f"WITH {TRK} SELECT activity_id, seq, round(COALESCE({hav('LAG(lat) OVER w', 'LAG(lon) OVER w', 'lat', 'lon', True)}, 0.0), 4) AS dist FROM trk WINDOW w AS (PARTITION BY activity_id ORDER BY seq)")
def leg_02(spark, d):
    b = lambda c: F.lag(c).over(T.track())
    return track_points(spark, d).select("activity_id", "seq", rnd(F.coalesce(geo.haversine_of_differences(b("lat"), b("lon"), F.col("lat"), F.col("lon")), F.lit(0.0)), 4).alias("dist"))


@query("leg_03", f"WITH {LEGS} SELECT activity_id, CAST(SUM(dt) AS BIGINT) AS seconds, CAST(MAX(dt) AS BIGINT) AS longest, COUNT(*) AS n FROM legs GROUP BY 1")
def leg_03(spark, d):
    return legs(spark, d).groupBy("activity_id").agg(F.sum("dt").alias("seconds"), F.max("dt").alias("longest"), F.count("*").alias("n"))


@query("leg_04", f"WITH {LEGS} SELECT activity_id, seq, round(speed, 4) AS speed FROM legs")
def leg_04(spark, d):
    return legs(spark, d).select("activity_id", "seq", rnd("speed", 4).alias("speed"))


@query("leg_05", f"WITH {LEGS} SELECT activity_id, seq, ele_delta FROM legs")
def leg_05(spark, d):
    return legs(spark, d).select("activity_id", "seq", "ele_delta")


@query("leg_06", f"WITH {LEGS} SELECT activity_id, seq, round(dist_km, 6) AS dist_km FROM legs")
def leg_06(spark, d):
    return legs(spark, d).select("activity_id", "seq", rnd("dist_km").alias("dist_km"))


@query("leg_07", f"WITH {TRK}, sm AS (SELECT *, AVG(ele) OVER ({ROWS} 10 PRECEDING AND 10 FOLLOWING) AS ele_sm FROM trk) SELECT activity_id, seq, COALESCE(t_s - LAG(t_s) OVER w, 0) AS dt, round(COALESCE(ele_sm - LAG(ele_sm) OVER w, 0.0), 6) AS ele_delta_sm FROM sm WINDOW w AS (PARTITION BY activity_id ORDER BY seq)")
def leg_07(spark, d):
    p = T.legs(T.smooth_elevation(track_points(spark, d)), guard=False)
    return p.select("activity_id", "seq", F.col("dt").cast("long").alias("dt"), rnd(F.coalesce(F.col("ele_sm") - F.lag("ele_sm").over(T.track()), F.lit(0.0))).alias("ele_delta_sm"))


@query("leg_08", f"WITH {LEGS}, e AS (SELECT activity_id, SUM(dist) AS path_m, {hav('arg_min(lat, seq)', 'arg_min(lon, seq)', 'arg_max(lat, seq)', 'arg_max(lon, seq)')} AS straight_m FROM legs GROUP BY 1) SELECT activity_id, round(path_m, 4) AS path_m, round(CASE WHEN straight_m <= 1 THEN 1.0 ELSE path_m / straight_m END, 4) AS sinuosity FROM e")
def leg_08(spark, d):
    return T.track_sinuosity(legs(spark, d)).select("activity_id", rnd("path_m", 4).alias("path_m"), rnd("sinuosity", 4).alias("sinuosity"))


@query("leg_09", f"WITH {LEGS} SELECT activity_id, CAST(SUM(dt) AS BIGINT) AS total FROM legs WHERE seq > 5 AND seq <= 25 GROUP BY 1")
def leg_09(spark, d):
    p = legs(spark, d)
    spans = p.where("seq = 0").select("activity_id", F.lit(5).cast("long").alias("start"), F.lit(25).cast("long").alias("end"))
    return T.range_sums(p, spans, "dt").select("activity_id", "total")


@query("leg_10", f"WITH {TRK} SELECT activity_id, MIN(lat) AS min_lat, MIN(lon) AS min_lon, MAX(lat) AS max_lat, MAX(lon) AS max_lon FROM trk GROUP BY 1")
def leg_10(spark, d):
    return T.bounding_boxes(track_points(spark, d))


@query("leg_11", f"WITH {TRK} SELECT activity_id, seq, round(radians(lon - -116.0) * 6371000.0 * cos(radians(50.0)), 4) AS x, round(radians(lat - 50.0) * 6371000.0, 4) AS y FROM trk")
def leg_11(spark, d):
    return T.localised(track_points(spark, d), 50.0, -116.0).select("activity_id", "seq", rnd("x", 4).alias("x"), rnd("y", 4).alias("y"))


@query("leg_12", f"WITH {TRK} SELECT activity_id, seq, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 7 HOUR ELSE ts END AS instant FROM trk")
def leg_12(spark, d):
    p = T.local_times(track_points(spark, d), F.lit("Etc/GMT+7"), F.col("event_id") % 2 == 0)
    return p.select("activity_id", "seq", F.col("instant").cast("timestamp_ntz").alias("instant"))


@query("leg_13", f"WITH {TRK}, xy AS (SELECT activity_id, seq, radians(lon - -116.0) * 6371000.0 * cos(radians(50.0)) AS x, radians(lat - 50.0) * 6371000.0 AS y FROM trk), t AS (SELECT *, greatest(0.0, least(1.0, (x * 300.0 + y * 400.0) / 250000.0)) AS t FROM xy) SELECT activity_id, seq, round(sqrt(pow(x - t * 300.0, 2) + pow(y - t * 400.0, 2)), 4) AS dist FROM t")
def leg_13(spark, d):
    p, c = T.localised(track_points(spark, d), 50.0, -116.0), F.lit
    return p.select("activity_id", "seq", rnd(geo.segment_distance(F.col("x"), F.col("y"), c(0.0), c(0.0), c(300.0), c(400.0)), 4).alias("dist"))


@query("leg_14", f"WITH {LEGS} SELECT activity_id, round(SUM(dist), 3) AS metres, round(SUM(dist) / 1000, 6) AS km FROM legs GROUP BY 1")
def leg_14(spark, d):
    return legs(spark, d).groupBy("activity_id").agg(F.round(F.sum("dist"), 3).alias("metres"), F.round(F.sum("dist") / 1000, 6).alias("km"))


# ---------------------------------------------------------------- smoothing


@query("sm_01", f"WITH {LEGS} SELECT activity_id, seq, round(COALESCE(median(speed) OVER ({ROWS} 2 PRECEDING AND 2 FOLLOWING), speed), 4) AS speed_sm FROM legs")
def sm_01(spark, d):
    return T.smooth_speed(legs(spark, d)).select("activity_id", "seq", rnd("speed_sm", 4).alias("speed_sm"))


@query("sm_02", f"WITH {TRK} SELECT activity_id, seq, round(AVG(ele) OVER ({ROWS} 10 PRECEDING AND 10 FOLLOWING), 6) AS ele_sm FROM trk")
def sm_02(spark, d):
    return T.smooth_elevation(track_points(spark, d)).select("activity_id", "seq", rnd("ele_sm").alias("ele_sm"))


@query("sm_03", f"WITH {TRK}, w AS (SELECT activity_id, seq, list_sort(list_filter(list(lat) OVER ({ROWS} 4 PRECEDING AND 4 FOLLOWING), lambda x: x IS NOT NULL)) AS l, lat, COUNT(*) OVER (PARTITION BY activity_id) AS n FROM trk) SELECT activity_id, seq, CASE WHEN n < 3 THEN lat ELSE l[len(l) // 2 + 1] END AS lat_sm FROM w")
def sm_03(spark, d):
    return T.smooth_upper_median(track_points(spark, d), "lat").select("activity_id", "seq", "lat_sm")


@query("sm_04", f"WITH {LEGS}, c AS (SELECT *, COUNT(*) OVER (PARTITION BY activity_id) AS n, AVG(lat) OVER w AS la, AVG(lon) OVER w AS lo FROM legs WINDOW w AS ({ROWS} 2 PRECEDING AND 2 FOLLOWING)) SELECT activity_id, seq, round(CASE WHEN n >= 5 AND dist_km >= 0.5 AND dist_km <= 2 THEN la ELSE lat END, 7) AS lat_sm, round(CASE WHEN n >= 5 AND dist_km >= 0.5 AND dist_km <= 2 THEN lo ELSE lon END, 7) AS lon_sm FROM c")
def sm_04(spark, d):
    return T.smooth_positions(legs(spark, d), 5, 0.5, 2.0).select("activity_id", "seq", rnd("lat_sm", 7).alias("lat_sm"), rnd("lon_sm", 7).alias("lon_sm"))


@query("sm_05", f"WITH {TRK}, s AS (SELECT activity_id, seq, AVG(ele) OVER ({ROWS} 3 PRECEDING AND 3 FOLLOWING) AS e FROM trk WHERE ele IS NOT NULL), x AS (SELECT activity_id, e - LAG(e) OVER (PARTITION BY activity_id ORDER BY seq) AS d FROM s) SELECT activity_id, round(COALESCE(SUM(CASE WHEN d > 0 THEN d END), 0.0), 5) AS gain_m, round(COALESCE(SUM(CASE WHEN d < 0 THEN -d END), 0.0), 5) AS loss_m FROM x GROUP BY 1")
def sm_05(spark, d):
    return T.gain_loss(track_points(spark, d)).select("activity_id", rnd("gain_m", 5).alias("gain_m"), rnd("loss_m", 5).alias("loss_m"))


@query("sm_06", f"""WITH RECURSIVE {TRK}, e AS (SELECT activity_id, ele, ROW_NUMBER() OVER (PARTITION BY activity_id ORDER BY seq) AS k FROM trk WHERE ele IS NOT NULL),
r AS (SELECT activity_id, k, ele AS at, CAST(0 AS DOUBLE) AS gain FROM e WHERE k = 1
 UNION ALL SELECT e.activity_id, e.k, CASE WHEN abs(e.ele - r.at) >= 3 THEN e.ele ELSE r.at END, r.gain + CASE WHEN e.ele - r.at >= 3 THEN e.ele - r.at ELSE 0 END FROM r JOIN e ON e.activity_id = r.activity_id AND e.k = r.k + 1)
SELECT activity_id, round(MAX(gain), 4) AS gain_m FROM r GROUP BY 1""")
def sm_06(spark, d):
    return T.gain_by_hysteresis(track_points(spark, d), 3.0).select("activity_id", rnd("gain_m", 4).alias("gain_m"))


_SPIKES = f"""raws AS (SELECT *, COUNT(*) OVER (PARTITION BY activity_id) AS n, CASE WHEN NOT assisted AND NOT COALESCE(LAG(assisted) OVER (PARTITION BY activity_id ORDER BY seq), false) AND dt > 0 THEN dist / dt * 3.6 END AS raw_kmh FROM legs),
around AS (SELECT *, list_sort(list_filter(list_concat(list(raw_kmh) OVER ({ROWS} 10 PRECEDING AND 1 PRECEDING), list(raw_kmh) OVER ({ROWS} 1 FOLLOWING AND 10 FOLLOWING)), lambda x: x > 0)) AS l FROM raws),
spiked AS (SELECT *, COALESCE(n >= 21 AND len(l) > 0 AND raw_kmh > greatest(40.0, 4 * l[len(l) // 2 + 1]), false) AS spike FROM around)"""


@query("sm_07", f"WITH {JLEGS}, {_SPIKES} SELECT activity_id, seq, spike FROM spiked")
def sm_07(spark, d):
    return T.spikes(legs(spark, d, True)).select("activity_id", "seq", "spike")


# ---------------------------------------------------------------- segments and statistics

_SEG = """fl AS (SELECT *, CASE WHEN seq = 0 THEN false ELSE assisted END AS flag FROM legs),
ch AS (SELECT *, CASE WHEN flag <> LAG(flag) OVER (PARTITION BY activity_id ORDER BY seq) THEN 1 ELSE 0 END AS c FROM fl),
rn AS (SELECT *, SUM(c) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM ch),
seg AS (SELECT activity_id, CAST(run AS BIGINT) AS seg_no, CASE WHEN any_value(flag) THEN 'assisted' ELSE 'riding' END AS type, greatest(0, MIN(seq) - CASE WHEN run > 0 THEN 1 ELSE 0 END) AS start_seq, MAX(seq) AS end_seq FROM rn GROUP BY activity_id, run)"""


@query("det_01", f"WITH {LEGS} SELECT activity_id, seq FROM legs WHERE assisted")
def det_01(spark, d):
    return legs(spark, d).where("assisted").select("activity_id", "seq")


@query("seg_01", f"WITH {LEGS}, {_SEG} SELECT activity_id, seg_no, type, CAST(start_seq AS BIGINT) AS start_seq, CAST(end_seq AS BIGINT) AS end_seq FROM seg")
def seg_01(spark, d):
    return T.segments(legs(spark, d))


@query("seg_02", f"WITH {LEGS}, {_SEG} SELECT activity_id, COUNT(*) FILTER (WHERE type = 'assisted') AS lift_count FROM seg GROUP BY 1")
def seg_02(spark, d):
    return T.lift_counts(legs(spark, d))


_AGG = f"""sm AS (SELECT *, AVG(ele) OVER ({ROWS} 10 PRECEDING AND 10 FOLLOWING) AS ele_sm FROM legs),
dl AS (SELECT *, COALESCE(ele_sm - LAG(ele_sm) OVER (PARTITION BY activity_id ORDER BY seq), 0.0) AS dz, COALESCE(median(speed) OVER ({ROWS} 2 PRECEDING AND 2 FOLLOWING), speed) AS speed_sm FROM sm),
st AS (SELECT activity_id, COALESCE(SUM(CASE WHEN NOT assisted THEN dist END), 0.0) / 1000 AS distance_km, COALESCE(SUM(CASE WHEN NOT assisted AND dz > 0 THEN dz END), 0.0) AS elev_gain_m,
 COALESCE(SUM(CASE WHEN NOT assisted AND dz < 0 THEN -dz END), 0.0) AS elev_loss_m, COALESCE(SUM(CASE WHEN assisted AND dz > 0 THEN dz END), 0.0) AS assisted_gain_m, CAST(COALESCE(SUM(CASE WHEN NOT assisted THEN dt END), 0) AS BIGINT) AS riding_s,
 CAST(nullif(MAX(t_s) - MIN(t_s), 0) AS BIGINT) AS duration_sec, MAX(speed_sm) AS max_speed_kmh, MAX(CASE WHEN NOT assisted THEN speed_sm END) AS max_speed_kmh_riding, nullif(MAX(ele), 0) AS peak_ele_m FROM dl GROUP BY 1)"""


@query("agg_01", f"WITH {LEGS}, {_AGG} SELECT activity_id, round(distance_km, 5) AS distance_km, round(elev_gain_m, 4) AS elev_gain_m, round(elev_loss_m, 4) AS elev_loss_m, round(assisted_gain_m, 4) AS assisted_gain_m, riding_s FROM st")
def agg_01(spark, d):
    s = T.riding_sums(T.smooth_elevation(legs(spark, d)))
    return s.select("activity_id", rnd("distance_km", 5).alias("distance_km"), *(rnd(c, 4).alias(c) for c in ("elev_gain_m", "elev_loss_m", "assisted_gain_m")), "riding_s")


@query("agg_04", f"WITH {LEGS}, {_SEG} SELECT s.activity_id, s.seg_no, s.type, round(SUM(CASE WHEN seq > start_seq THEN dist ELSE 0 END), 3) AS dist_m, round(SUM(CASE WHEN seq > start_seq AND ele_delta > 0 THEN ele_delta ELSE 0 END), 3) AS gain_m, round(MAX(speed), 4) AS max_speed FROM seg s JOIN legs l ON l.activity_id = s.activity_id AND seq BETWEEN start_seq AND end_seq GROUP BY 1, 2, 3")
def agg_04(spark, d):
    p = legs(spark, d)
    return T.segment_sums(p, T.segments(p)).select("activity_id", "seg_no", "type", rnd("dist_m", 3).alias("dist_m"), rnd("gain_m", 3).alias("gain_m"), rnd("max_speed", 4).alias("max_speed"))


@query("agg_05", f"WITH {LEGS}, {_AGG} SELECT activity_id, duration_sec, round(distance_km / nullif(riding_s / 3600.0, 0), 4) AS avg_speed_kmh, round(max_speed_kmh, 4) AS max_speed_kmh, round(max_speed_kmh_riding, 4) AS max_speed_kmh_riding, peak_ele_m FROM st")
def agg_05(spark, d):
    s = T.activity_stats(T.smooth_speed(legs(spark, d)))
    return s.select("activity_id", "duration_sec", *(rnd(c, 4).alias(c) for c in ("avg_speed_kmh", "max_speed_kmh", "max_speed_kmh_riding")), "peak_ele_m")


@query("agg_06", f"WITH {ACT}, x AS (SELECT *, COALESCE(gain, 0.0) * 12 AS up, n * 900.0 AS down, km * 2 AS dist FROM act) SELECT activity_id, CASE WHEN dist > 0 THEN greatest(1, CAST(round_even(CASE WHEN type = 'MACHINERY' THEN pow(dist, 0.83) / 3.2 * (1 + greatest(0, down / dist - 90) / 90) ELSE pow(dist + up / 55, 0.83) / 3.2 * (1 + greatest(0, up / dist - 30) / 60) END, 0) AS INTEGER)) END AS score FROM x")
def agg_06(spark, d):
    km, gain, loss = F.col("km") * 2, F.coalesce("gain", F.lit(0.0)) * 12, F.col("n") * 900.0
    return activities(spark, d).select("activity_id", reports.difficulty(km, gain, loss, F.col("type") == "MACHINERY").alias("score"))


_SPARK = "spk AS (SELECT activity_id, COUNT(ele) AS n, SUM(ele) AS total, arg_max(ele, seq) AS last_ele FROM (SELECT activity_id, seq, ele, ROW_NUMBER() OVER (PARTITION BY activity_id ORDER BY seq) - 1 AS k, COUNT(*) OVER (PARTITION BY activity_id) AS n FROM trk) WHERE k % greatest(1, n // 40) = 0 GROUP BY 1)"


@query("agg_07", f"WITH {TRK}, {_SPARK} SELECT activity_id, CASE WHEN n >= 2 THEN n END AS n, CASE WHEN n >= 2 THEN total END AS total, CASE WHEN n >= 2 THEN last_ele END AS last_ele FROM spk")
def agg_07(spark, d):
    s = T.sparklines(track_points(spark, d))
    shown = F.col("spark").isNotNull()
    return s.select("activity_id", F.when(shown, F.size("spark").cast("long")).alias("n"), F.aggregate("spark", F.lit(0.0), lambda a, x: a + x).alias("total"), F.try_element_at("spark", F.lit(-1)).alias("last_ele"))


@query("agg_08", f"WITH {TRK}, p AS (SELECT *, COUNT(*) OVER (PARTITION BY activity_id) AS n FROM trk) SELECT activity_id, seq, lat, lon FROM p WHERE n <= 20 OR seq = n - 1 OR seq IN (SELECT CAST(floor(i * n / 20.0) AS BIGINT) FROM range(20) r(i))")
def agg_08(spark, d):
    return T.thumbnails(track_points(spark, d), 20)


@query("agg_09", f"WITH {TRK}, p AS (SELECT *, COUNT(*) OVER (PARTITION BY activity_id) AS n FROM trk) SELECT activity_id, seq, round(lat, 5) AS lat, round(lon, 5) AS lon FROM p WHERE seq % greatest(1, n // 30) = 0 OR seq = n - 1")
def agg_09(spark, d):
    return T.decimated(track_points(spark, d), 30)


@query("agg_10", f"WITH {LEGS}, {_AGG}, {_SEG} SELECT st.activity_id, round(distance_km, 4) AS distance_km, duration_sec, peak_ele_m, lifts, round(lat0, 4) AS lat0 FROM st JOIN (SELECT activity_id, COUNT(*) FILTER (WHERE type = 'assisted') AS lifts FROM seg GROUP BY 1) USING (activity_id) JOIN (SELECT activity_id, lat AS lat0 FROM trk WHERE seq = 0) USING (activity_id)")
def agg_10(spark, d):
    p = legs(spark, d)
    start = p.where("seq = 0").select("activity_id", rnd("lat", 4).alias("lat0"))
    s = T.activity_stats(T.smooth_speed(p)).select("activity_id", rnd("distance_km", 4).alias("distance_km"), "duration_sec", "peak_ele_m")
    return s.join(T.lift_counts(p).withColumnRenamed("lift_count", "lifts"), "activity_id").join(start, "activity_id")


# ---------------------------------------------------------------- edits


@query("edt_01", f"WITH {TRK} SELECT activity_id, seq, ts + INTERVAL 20 HOUR AS ts, CAST(MIN(ts + INTERVAL 20 HOUR) OVER (PARTITION BY activity_id) AS DATE) AS date FROM trk")
def edt_01(spark, d):
    return T.shifted(track_points(spark, d), 20).select("activity_id", "seq", "ts", "date")


_TRIM = """b AS (SELECT activity_id, MIN(seq) FILTER (WHERE dist_km >= 0.5) AS lo, MAX(seq) FILTER (WHERE dist_km <= 2.0) AS hi FROM legs GROUP BY 1),
cutp AS (SELECT l.*, lo, hi, COALESCE(hi <= lo, true) AS whole FROM legs l JOIN b USING (activity_id) WHERE COALESCE(hi <= lo, true) OR seq BETWEEN lo AND hi)"""


@query("edt_02", f"WITH {LEGS}, {_TRIM} SELECT activity_id, CASE WHEN whole THEN seq ELSE seq - lo END AS seq, round(CASE WHEN whole THEN dist_km ELSE dist_km - MIN(dist_km) OVER (PARTITION BY activity_id) END, 6) AS dist_km FROM cutp")
def edt_02(spark, d):
    return T.trimmed(legs(spark, d), 0.5, 2.0).select("activity_id", "seq", rnd("dist_km").alias("dist_km"))


_REDERIVED = f"""rd1 AS (SELECT *, round(SUM(leg2) OVER ({ROWS} UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS km2 FROM rd0),
rd2 AS (SELECT *, CASE WHEN dt > 0 THEN (km2 - LAG(km2) OVER (PARTITION BY activity_id ORDER BY seq)) / (dt / 3600.0) END AS sp FROM rd1),
rd3 AS (SELECT *, round(COALESCE(median(sp) OVER ({ROWS} 2 PRECEDING AND 2 FOLLOWING), sp), 4) AS sp2 FROM rd2),
rd4 AS (SELECT *, CASE WHEN seq = 0 THEN COALESCE(sp2, LEAD(sp2) OVER (PARTITION BY activity_id ORDER BY seq)) ELSE sp2 END AS sp3 FROM rd3)"""
_REPAIR = f"""rp AS (SELECT *, bool_or(spike) OVER (PARTITION BY activity_id) AND n >= 3 AS fix, CASE WHEN NOT spike AND seq > 0 THEN dist / 1000 END AS clean FROM spiked),
rq AS (SELECT *, list_sort(list_filter(list_concat(list(clean) OVER ({ROWS} 10 PRECEDING AND 1 PRECEDING), list(clean) OVER ({ROWS} 1 FOLLOWING AND 10 FOLLOWING)), lambda x: x IS NOT NULL)) AS nb,
 COALESCE(last_value(CASE WHEN NOT spike THEN lat END IGNORE NULLS) OVER b, first_value(CASE WHEN NOT spike THEN lat END IGNORE NULLS) OVER f, lat) AS lat2, COALESCE(last_value(CASE WHEN NOT spike THEN lon END IGNORE NULLS) OVER b, first_value(CASE WHEN NOT spike THEN lon END IGNORE NULLS) OVER f, lon) AS lon2
 FROM rp WINDOW b AS ({ROWS} UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({ROWS} CURRENT ROW AND UNBOUNDED FOLLOWING)),
rd0 AS (SELECT *, CASE WHEN spike THEN COALESCE(nb[len(nb) // 2 + 1], 0) ELSE dist / 1000 END AS leg2 FROM rq), {_REDERIVED},
fixed AS (SELECT activity_id, seq, spike, lat2, lon2, dist_km AS km0, speed AS speed0, CASE WHEN fix THEN km2 ELSE dist_km END AS km1, CASE WHEN fix THEN COALESCE(sp3, speed) ELSE speed END AS speed1 FROM rd4)"""


@query("edt_03", f"WITH {JLEGS}, {_SPIKES}, {_REPAIR} SELECT activity_id, seq, round(lat2, 7) AS lat, round(lon2, 7) AS lon, round(km1, 6) AS dist_km, round(speed1, 4) AS speed FROM fixed")
def edt_03(spark, d):
    p = T.repaired(T.spikes(legs(spark, d, True)), 4)
    return p.select("activity_id", "seq", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), rnd("dist_km").alias("dist_km"), rnd("speed", 4).alias("speed"))


def _smoothed_sql(half):
    return f"""sm0 AS (SELECT *, COUNT(*) OVER (PARTITION BY activity_id) AS n, AVG(lat) OVER w AS la, AVG(lon) OVER w AS lo FROM legs WINDOW w AS ({ROWS} {half} PRECEDING AND {half} FOLLOWING)),
sm1 AS (SELECT * REPLACE (CASE WHEN n >= {2 * half + 1} THEN la ELSE lat END AS lat, CASE WHEN n >= {2 * half + 1} THEN lo ELSE lon END AS lon) FROM sm0),
rd0 AS (SELECT *, COALESCE({hav("LAG(lat) OVER w", "LAG(lon) OVER w", "lat", "lon")}, 0.0) / 1000 AS leg2 FROM sm1 WINDOW w AS (PARTITION BY activity_id ORDER BY seq)), {_REDERIVED}"""


@query("edt_04", f"WITH {LEGS}, {_smoothed_sql(3)} SELECT activity_id, seq, round(lat, 7) AS lat, round(lon, 7) AS lon, km2 AS dist_km, sp3 AS speed FROM rd4")
def edt_04(spark, d):
    p = T.smoothed_track(legs(spark, d), 7, 4)
    return p.select("activity_id", "seq", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), "dist_km", "speed")


@query("edt_06", f"WITH {LEGS}, {_smoothed_sql(2)} SELECT activity_id, MAX(km2) AS km, round(MIN(lat), 7) AS min_lat, round(MAX(lat), 7) AS max_lat FROM rd4 GROUP BY 1")
def edt_06(spark, d):
    """All four edits asked for, three of them bypassed: smoothing alone is left."""
    p = T.edited(legs(spark, d), hours=5, start_km=0.5, end_km=1.0, repair=True, window=5, shift=False, trim=False, repairs=False)
    return p.groupBy("activity_id").agg(F.max("dist_km").alias("km"), F.round(F.min("lat"), 7).alias("min_lat"), F.round(F.max("lat"), 7).alias("max_lat"))


@query("edt_02_segments", f"WITH {LEGS}, {_SEG}, c AS (SELECT activity_id, MIN(seq) FILTER (WHERE dist_km >= 0.5) AS lo, MAX(seq) FILTER (WHERE dist_km <= 2.0) AS hi FROM legs GROUP BY 1) SELECT s.activity_id, seg_no, type, CAST(greatest(start_seq, lo) - lo AS BIGINT) AS start_seq, CAST(least(end_seq, hi) - lo AS BIGINT) AS end_seq FROM seg s JOIN c ON c.activity_id = s.activity_id WHERE lo < hi AND least(end_seq, hi) > greatest(start_seq, lo)")
def edt_02_segments(spark, d):
    p = legs(spark, d)
    cuts = p.groupBy("activity_id").agg(F.min(F.when(F.col("dist_km") >= 0.5, F.col("seq"))).alias("lo"), F.max(F.when(F.col("dist_km") <= 2.0, F.col("seq"))).alias("hi")).where("lo < hi")
    return T.clipped(T.segments(p), cuts)


@query("edt_07", f"WITH {LEGS}, {_SEG} SELECT activity_id, seg_no, type FROM seg WHERE activity_id % 7 <> 0 UNION ALL SELECT DISTINCT activity_id, CAST(0 AS BIGINT), 'riding' FROM trk WHERE activity_id % 7 = 0")
def edt_07(spark, d):
    p = legs(spark, d)
    mine = p.where("activity_id % 7 = 0").select("activity_id", F.lit(0).cast("long").alias("seg_no"), F.lit("riding").alias("type")).distinct()
    return T.overridden(T.segments(p).select("activity_id", "seg_no", "type"), mine)


@query("win_09", f"WITH {TRK} SELECT activity_id, seq, COALESCE(last_value(ele IGNORE NULLS) OVER ({ROWS} UNBOUNDED PRECEDING AND CURRENT ROW), first_value(ele IGNORE NULLS) OVER ({ROWS} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ele FROM trk")
def win_09(spark, d):
    return T.filled(track_points(spark, d), "ele").select("activity_id", "seq", "ele")


@query("win_10", f"WITH {TRK}, a AS (SELECT activity_id, seq, atan2(lat - 50.0, lon - -116.0) AS a FROM trk), dd AS (SELECT *, a - LAG(a) OVER (PARTITION BY activity_id ORDER BY seq) AS d FROM a) SELECT activity_id, seq, round(first_value(a) OVER w + SUM(COALESCE(d - 2 * pi() * ceil((d - pi()) / (2 * pi())), 0.0)) OVER w, 6) AS angle FROM dd WINDOW w AS ({ROWS} UNBOUNDED PRECEDING AND CURRENT ROW)")
def win_10(spark, d):
    p = track_points(spark, d).withColumn("a", F.atan2(F.col("lat") - 50.0, F.col("lon") - -116.0))
    return T.unwrapped(p, "a").select("activity_id", "seq", rnd("a_unwrapped").alias("angle"))


# ---------------------------------------------------------------- reports

_WINDOW = """SELECT type, COUNT(*) FILTER (WHERE nw) AS n, COUNT(DISTINCT CASE WHEN nw THEN d END) AS days, round(COALESCE(SUM(CASE WHEN nw THEN km END), 0), 6) AS km, round(COALESCE(SUM(CASE WHEN nw THEN gain END), 0), 6) AS gain, round(COALESCE(SUM(CASE WHEN nw THEN hours END), 0), 6) AS hours,
 round(MAX(CASE WHEN nw THEN km END), 6) AS max_km, MAX(CASE WHEN nw THEN d END) AS last_day, COUNT(*) FILTER (WHERE pr) AS prior_n, round(COALESCE(SUM(CASE WHEN pr THEN km END), 0), 6) AS prior_km
FROM (SELECT *, d BETWEEN DATE '2001-05-04' AND DATE '2001-08-01' AS nw, d BETWEEN DATE '2001-02-03' AND DATE '2001-05-03' AS pr FROM act) WHERE nw OR pr"""


def _rollup(spark, d):
    r = reports.window_rollup(activities(spark, d), AS_OF, 90)
    return r.withColumns({c: F.round(c, 6) for c in ("km", "gain", "hours", "prior_km")}).withColumn("max_km", rnd("max_km"))


@query("sum_01", f"WITH {ACT} {_WINDOW} GROUP BY type")
def sum_01(spark, d):
    return _rollup(spark, d).where("type IS NOT NULL").select("type", "n", "days", "km", "gain", "hours", "max_km", "last_day", "prior_n", "prior_km")


@query("sum_02", f"WITH {ACT} SELECT type, prior_n, prior_km FROM ({_WINDOW} GROUP BY type)")
def sum_02(spark, d):
    return _rollup(spark, d).where("type IS NOT NULL").select("type", "prior_n", "prior_km")


@query("sum_03", f"WITH {ACT} {_WINDOW} GROUP BY GROUPING SETS ((type), ())")
def sum_03(spark, d):
    return _rollup(spark, d)


@query("sum_04", f"WITH {ACT}, t AS (SELECT type, date_trunc('month', MIN(d)) AS first FROM act GROUP BY 1), m AS (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month), s AS (SELECT type, CAST(date_trunc('month', d) AS DATE) AS month, COUNT(*) AS n, SUM(km) AS km FROM act GROUP BY 1, 2) SELECT t.type, m.month, CASE WHEN m.month >= first AND m.month <= DATE '2001-08-01' THEN COALESCE(n, 0) END AS n, round(CASE WHEN m.month >= first AND m.month <= DATE '2001-08-01' THEN COALESCE(km, 0.0) END, 6) AS km FROM t CROSS JOIN m LEFT JOIN s ON s.type = t.type AND s.month = m.month")
def sum_04(spark, d):
    return reports.history(activities(spark, d), AS_OF, 8).select("type", "month", "n", rnd("km", 6).alias("km"))


@query("sum_05", f"WITH {ACT}, r AS (SELECT type, MAX(d) AS last_day FROM act GROUP BY 1) SELECT d, type FROM (SELECT d, a.type, ROW_NUMBER() OVER (PARTITION BY d ORDER BY last_day DESC, a.type DESC) AS k FROM (SELECT DISTINCT d, type FROM act) a JOIN r ON a.type = r.type) WHERE k = 1")
def sum_05(spark, d):
    return reports.dominant_types(activities(spark, d))


@query("sum_06", f"WITH {ACT} SELECT type, MAX(d) AS last_day, ROW_NUMBER() OVER (ORDER BY MAX(d) DESC, type DESC) AS place FROM act GROUP BY 1")
def sum_06(spark, d):
    return reports.type_order(activities(spark, d))


@query("sum_07", f"WITH {ACT}, g AS (SELECT type, SUM(CASE WHEN month(d) <= 8 AND year(d) = 2001 THEN km ELSE 0 END) AS km, SUM(CASE WHEN month(d) <= 8 AND year(d) = 2000 THEN km ELSE 0 END) AS km_before FROM act GROUP BY 1) SELECT type, round(km, 6) AS km, round(km_before, 6) AS km_before, round(100 * (km - km_before) / nullif(km_before, 0), 6) AS growth FROM g")
def sum_07(spark, d):
    return reports.year_over_year(activities(spark, d), AS_OF).select("type", *(rnd(c, 6).alias(c) for c in ("km", "km_before", "growth")))


_STREAK = """runs AS (SELECT type, COUNT(*) AS n, MAX(d) AS last_day FROM (SELECT type, d, d - CAST(ROW_NUMBER() OVER (PARTITION BY type ORDER BY d) AS INTEGER) AS g FROM (SELECT DISTINCT type, d FROM act)) GROUP BY type, g)"""


@query("win_01", f"WITH {ACT}, {_STREAK} SELECT type, MAX(n) AS longest, COALESCE(MAX(CASE WHEN last_day BETWEEN DATE '2001-07-31' AND DATE '2001-08-01' THEN n END), 0) AS current FROM runs GROUP BY 1")
def win_01(spark, d):
    return reports.streaks(activities(spark, d), AS_OF)


@query("top_03", f"WITH {ACT}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY type ORDER BY d DESC, activity_id) AS k FROM act), m AS (SELECT activity_id, d, type, CAST(round(hours * 60) AS BIGINT) AS mins FROM r WHERE k <= 5 ORDER BY d DESC, activity_id LIMIT 25) SELECT activity_id, d, type, CAST(mins // 60 AS VARCHAR) || ':' || lpad(CAST(mins % 60 AS VARCHAR), 2, '0') AS duration FROM m")
def top_03(spark, d):
    return reports.recent(activities(spark, d))


@query("top_04", f"WITH {ACT} SELECT activity_id, d, type FROM act WHERE d >= DATE '2001-07-01'")
def top_04(spark, d):
    return reports.log_query(activities(spark, d), since="2001-07-01").orderBy(F.desc("d"), "activity_id").select("activity_id", "d", "type")


@query("flt_05", f"WITH {ACT} SELECT activity_id, d, type FROM act")
def flt_05(spark, d):
    return activities(spark, d).select("activity_id", "d", "type")


@query("cnt_01", f"WITH {ACT} SELECT type, COUNT(*) AS n FROM act GROUP BY 1")
def cnt_01(spark, d):
    return activities(spark, d).groupBy("type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- training

_WEEK = """wk AS (SELECT CAST(unnest(generate_series(DATE '2001-07-30' - 7 * 25, DATE '2001-07-30', INTERVAL 7 DAY)) AS DATE) AS week),
ws AS (SELECT CAST(date_trunc('week', d) AS DATE) AS week, COUNT(*) AS rides, SUM(hours) AS hours, SUM(COALESCE(gain, 0)) AS gain, SUM(km) AS km FROM act GROUP BY 1),
weeks AS (SELECT wk.week, COALESCE(rides, 0) AS rides, COALESCE(hours, 0.0) AS hours, COALESCE(gain, 0.0) AS gain, COALESCE(km, 0.0) AS km FROM wk LEFT JOIN ws ON wk.week = ws.week)"""


@query("fit_01", f"WITH {ACT}, {_WEEK} SELECT week, rides, round(hours, 6) AS hours, round(gain, 6) AS gain, round(km, 6) AS km FROM weeks")
def fit_01(spark, d):
    return reports.weekly(activities(spark, d), AS_OF, 26).select("week", "rides", *(rnd(c, 6).alias(c) for c in ("hours", "gain", "km")))


@query("fit_15", f"WITH {ACT}, {_WEEK} SELECT week, round(AVG(km) OVER (ORDER BY week ROWS 3 PRECEDING), 9) AS km_4, round(AVG(km) OVER (ORDER BY week ROWS 7 PRECEDING), 9) AS km_8 FROM weeks")
def fit_15(spark, d):
    return reports.rolling_weeks(reports.weekly(activities(spark, d), AS_OF, 26), "km").select("week", rnd("km_4", 9).alias("km_4"), rnd("km_8", 9).alias("km_8"))


@query("fit_04", f"WITH {ACT} SELECT type, COUNT(DISTINCT d) AS days, round(SUM(hours), 6) AS hours, COALESCE(SUM(gain), 0) AS gain, COUNT(*) AS n FROM act WHERE d >= DATE '2001-05-04' GROUP BY 1")
def fit_04(spark, d):
    a = reports.log_query(activities(spark, d), since="2001-05-04")
    return a.groupBy("type").agg(F.count_distinct("d").alias("days"), F.round(F.sum("hours"), 6).alias("hours"), F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"), F.count("*").alias("n")).orderBy(F.desc("hours"))


def _rides(spark, d):
    a, i = activities(spark, d), F.col("activity_id")
    zones = F.array(*((i * (k + 3) % (61 * (k + 1))).cast("double") * F.when(i % 4 == 0, 0.0).otherwise(10.0) for k in range(5)))
    a = a.withColumn("zones", zones)
    return a.withColumns({"hr_load": reports.zone_load(F.col("zones")), "surrogate": reports.surrogate_load(F.col("hours") * 3600, F.coalesce("gain", F.lit(0.0)), F.col("km"), F.lit(8.5)), "kcal": reports.calories(F.col("zones"), F.lit(6.0), F.lit(75.0), F.col("hours"))})


_RIDES = """zz AS (SELECT *, CASE WHEN activity_id % 4 = 0 THEN 0.0 ELSE 10.0 END AS f FROM act),
z AS (SELECT *, activity_id * 3 % 61 * f AS z1, activity_id * 4 % 122 * f AS z2, activity_id * 5 % 183 * f AS z3, activity_id * 6 % 244 * f AS z4, activity_id * 7 % 305 * f AS z5 FROM zz),
rides AS (SELECT *, z2 / 60 + 2 * z3 / 60 + 3 * z4 / 60 + 5 * z5 / 60 AS hr_load, hours * 60 * (1 + greatest(0.0, COALESCE(COALESCE(gain, 0) / nullif(km, 0), 0.0) - 30) / 120) AS surrogate,
 75.0 * CASE WHEN z1 + z2 + z3 + z4 + z5 > 0 THEN (3 * z1 + 5 * z2 + 8 * z3 + 11 * z4 + 14 * z5) / 3600 ELSE 6.0 * hours END AS kcal FROM z)"""
_K = "(SELECT COALESCE(median(CASE WHEN hr_load > 0 AND surrogate > 0 THEN hr_load / surrogate END), 1.0) AS k FROM rides)"


@query("fit_05", f"WITH {ACT}, {_RIDES} SELECT activity_id, round(hr_load, 4) AS load FROM rides")
def fit_05(spark, d):
    return _rides(spark, d).select("activity_id", rnd("hr_load", 4).alias("load"))


@query("fit_06", f"WITH {ACT}, {_RIDES} SELECT activity_id, round(surrogate, 4) AS load FROM rides")
def fit_06(spark, d):
    return _rides(spark, d).select("activity_id", rnd("surrogate", 4).alias("load"))


@query("fit_07", f"WITH {ACT}, {_RIDES} SELECT round(k, 6) AS k FROM {_K}")
def fit_07(spark, d):
    return reports.calibration(_rides(spark, d)).select(rnd("k").alias("k"))


@query("fit_08", f"WITH {ACT}, {_RIDES} SELECT activity_id, round(CASE WHEN hr_load > 0 THEN hr_load ELSE k * surrogate END, 4) AS load FROM rides, {_K}")
def fit_08(spark, d):
    return reports.ride_loads(_rides(spark, d)).select("activity_id", rnd("load", 4).alias("load"))


@query("fit_10", f"WITH {ACT}, {_RIDES} SELECT activity_id, round((z1 + z2) / nullif(z1 + z2 + z3 + z4 + z5, 0), 6) AS low, round(z3 / nullif(z1 + z2 + z3 + z4 + z5, 0), 6) AS middle, round((z4 + z5) / nullif(z1 + z2 + z3 + z4 + z5, 0), 6) AS high FROM rides")
def fit_10(spark, d):
    z = F.col("zones")
    return _rides(spark, d).select("activity_id", *reports.polarization(z[0] + z[1], z[2], z[3] + z[4])).select("activity_id", *(rnd(c).alias(c) for c in ("low", "middle", "high")))


_DAYS = """first AS (SELECT MIN(d) AS f FROM act), days AS (SELECT s.d, date_diff('day', f, s.d) AS t, COALESCE(v, 0.0) AS v FROM (SELECT CAST(unnest(generate_series(f, DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS d FROM first) s CROSS JOIN first LEFT JOIN (SELECT d, SUM(km) AS v FROM act GROUP BY 1) q ON q.d = s.d)"""


def _days(spark, d):
    return reports.daily(activities(spark, d), "km", AS_OF)


@query("fit_09", f"WITH {ACT}, {_DAYS} SELECT d, CAST(t AS INTEGER) AS t, round(v, 6) AS v FROM days")
def fit_09(spark, d):
    return _days(spark, d).select("d", "t", rnd("v", 6).alias("v"))


@query("fit_11", f"WITH {ACT}, {_DAYS} SELECT d, round(CASE WHEN t >= 27 THEN AVG(v) OVER w / nullif(stddev_pop(v) OVER w, 0) END, 5) AS monotony FROM days WINDOW w AS (ORDER BY t ROWS 27 PRECEDING)")
def fit_11(spark, d):
    return reports.monotony(_days(spark, d)).select("d", rnd("monotony", 5).alias("monotony"))


_FF = "ff AS (SELECT d, t, exp(-t / 42.0) * SUM((1 - exp(-1 / 42.0)) * v * exp(t / 42.0)) OVER w AS fitness, exp(-t / 7.0) * SUM((1 - exp(-1 / 7.0)) * v * exp(t / 7.0)) OVER w AS fatigue FROM days WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING))"


@query("win_02", f"WITH {ACT}, {_DAYS}, {_FF} SELECT d, round(fitness, 4) AS fitness FROM ff")
def win_02(spark, d):
    return reports.ewma(_days(spark, d), 42.0, "fitness").select("d", rnd("fitness", 4).alias("fitness"))


@query("win_03", f"WITH {ACT}, {_DAYS}, {_FF} SELECT d, round(fitness, 4) AS fitness, round(fatigue, 4) AS fatigue, round(COALESCE(LAG(fitness - fatigue) OVER (ORDER BY t), 0.0), 4) AS form FROM ff")
def win_03(spark, d):
    return reports.fitness(_days(spark, d)).select("d", *(rnd(c, 4).alias(c) for c in ("fitness", "fatigue", "form")))


_ACWR = "ac AS (SELECT d, t, CASE WHEN t >= 27 AND AVG(v) OVER c > 0 THEN AVG(v) OVER a / AVG(v) OVER c END AS acwr FROM days WINDOW a AS (ORDER BY t ROWS 6 PRECEDING), c AS (ORDER BY t ROWS 27 PRECEDING))"


@query("win_04", f"WITH {ACT}, {_DAYS}, {_ACWR} SELECT d, round(acwr, 5) AS acwr FROM ac")
def win_04(spark, d):
    return reports.acute_chronic(_days(spark, d)).select("d", rnd("acwr", 5).alias("acwr"))


_VERDICT_DAYS = "vd AS (SELECT d, t, acwr, CASE WHEN t % 5 > 0 THEN (t % 7 - 3) / 100.0 END AS rhr_change, CASE WHEN t % 3 > 0 THEN (t % 11 - 5) / 100.0 END AS easy_change, CASE WHEN t % 4 > 0 THEN (t % 13 - 6) / 50.0 END AS fit_change, CASE WHEN t % 6 > 0 THEN t % 80 END AS reserve, CASE WHEN t % 8 > 0 THEN 48 + t % 12 END AS rhr, 53 AS baseline, CASE WHEN t % 9 > 0 THEN (t % 10) END AS sleep_h, CASE WHEN t % 10 > 0 THEN t % 9 - 4 END AS form, CASE WHEN t % 7 > 0 THEN t % 40 / 100.0 END AS hard FROM ac)"


@query("dq_06", f"""WITH {ACT}, {_DAYS}, {_ACWR}, {_VERDICT_DAYS}, votes AS (SELECT *, CASE WHEN rhr_change < -0.02 THEN 1 WHEN rhr_change > 0.02 THEN -1 ELSE 0 END + CASE WHEN easy_change < -0.02 THEN 1 WHEN easy_change > 0.02 THEN -1 ELSE 0 END + CASE WHEN fit_change > 0.05 THEN 1 WHEN fit_change < -0.05 THEN -1 ELSE 0 END AS score,
 CASE WHEN reserve >= 60 THEN 1 ELSE 0 END + CASE WHEN rhr <= baseline - 1 THEN 1 ELSE 0 END + CASE WHEN sleep_h >= 7.5 THEN 1 ELSE 0 END + CASE WHEN form > 1 THEN 1 ELSE 0 END AS fresh, CASE WHEN reserve < 25 THEN 1 ELSE 0 END + CASE WHEN rhr >= baseline + 5 THEN 1 ELSE 0 END + CASE WHEN sleep_h < 6 THEN 1 ELSE 0 END + CASE WHEN form < -1 THEN 1 ELSE 0 END AS tired FROM vd)
SELECT d, CASE WHEN rhr_change IS NULL AND easy_change IS NULL AND fit_change IS NULL THEN 'unknown' WHEN score >= 1 THEN 'rising' WHEN score <= -1 THEN 'falling' ELSE 'steady' END AS fitness, CASE WHEN reserve IS NULL AND rhr IS NULL AND sleep_h IS NULL AND form IS NULL THEN 'unknown' WHEN tired >= 2 AND tired > fresh THEN 'easy' WHEN fresh >= 2 AND fresh > tired THEN 'go_hard' ELSE 'steady' END AS readiness,
 CASE WHEN acwr IS NULL THEN 'unknown' WHEN acwr > 1.5 THEN 'ramping_hard' WHEN acwr >= 0.8 THEN 'safe' ELSE 'detraining' END AS load_risk, CASE WHEN hard IS NULL THEN 'unknown' WHEN hard > 0.25 THEN 'too_hard' WHEN hard < 0.08 THEN 'too_easy' ELSE 'balanced' END AS mix FROM votes""")
def dq_06(spark, d):
    t = F.col("t")
    on = lambda k, v: F.when(t % k > 0, v)
    return reports.acute_chronic(_days(spark, d)).select(
        "d", reports.fitness_verdict(on(5, (t % 7 - 3) / 100), on(3, (t % 11 - 5) / 100), on(4, (t % 13 - 6) / 50)).alias("fitness"),
        reports.readiness_verdict(on(6, t % 80), on(8, 48 + t % 12), F.lit(53), on(9, t % 10), on(10, t % 9 - 4)).alias("readiness"), reports.load_verdict(F.col("acwr")).alias("load_risk"), reports.mix_verdict(on(7, t % 40 / 100)).alias("mix"),
    )


@query("win_05", f"WITH {ACT}, {_DAYS}, r AS (SELECT t, CASE WHEN t % 3 > 0 THEN v END AS v FROM days), s AS (SELECT list(v ORDER BY t) AS a FROM r WHERE v IS NOT NULL), g AS (SELECT list_avg(a[-28:]) AS last_n, list_avg(CASE WHEN len(a) > 28 THEN a[greatest(1, len(a) - 55) : len(a) - 28] ELSE a[1:1] END) AS before_n, len(a) AS n FROM s) SELECT round(last_n, 5) AS last_n, round(before_n, 5) AS before_n, round(CASE WHEN n >= 2 THEN (last_n - before_n) / nullif(abs(before_n), 0) END, 6) AS change FROM g")
def win_05(spark, d):
    days = _days(spark, d).withColumn("v", F.when(F.col("t") % 3 > 0, F.col("v")))
    return reports.trend(days, 28).select(rnd("last_n", 5).alias("last_n"), rnd("before_n", 5).alias("before_n"), rnd("change").alias("change"))


@query("fit_12", f"WITH {ACT}, {_DAYS}, {_FF} SELECT CAST(date_trunc('week', d) AS DATE) AS week, round(arg_max(fitness, d), 4) AS fitness FROM ff GROUP BY 1")
def fit_12(spark, d):
    return reports.week_ends(reports.ewma(_days(spark, d), 42.0, "fitness"), "fitness").select("week", rnd("fitness", 4).alias("fitness"))


# ---------------------------------------------------------------- joins

_SENSOR = "sensor AS (SELECT activity_id, t_s + 3 + event_id % 5 AS t, CAST(90 + event_id % 97 AS DOUBLE) AS bpm FROM trk WHERE event_type <> 'error')"


def _sensor(spark, d):
    return track_points(spark, d).where("event_type != 'error'").select("activity_id", (F.col("t_s") + 3 + F.col("event_id") % 5).alias("t"), (90 + F.col("event_id") % 97).cast("double").alias("bpm"))


_SPAN = "span AS (SELECT activity_id, MIN(t_s) + 100 AS first, MAX(t_s) - 100 AS last FROM trk GROUP BY 1)"


def _span(spark, d):
    return track_points(spark, d).groupBy("activity_id").agg((F.min("t_s") + 100).alias("first"), (F.max("t_s") - 100).alias("last"))


@query("jn_01", f"WITH {TRK}, {_SENSOR}, {_SPAN} SELECT s.activity_id, COUNT(*) AS n, SUM(bpm) AS total FROM span s JOIN sensor x ON x.activity_id = s.activity_id AND x.t BETWEEN s.first AND s.last GROUP BY 1")
def jn_01(spark, d):
    j = asof.within(_span(spark, d), _sensor(spark, d), "t", "first", "last", 600, ["activity_id"])
    return j.groupBy("activity_id").agg(F.count("*").alias("n"), F.sum("bpm").alias("total"))


@query("jn_02", f"WITH {LEGS}, {_SENSOR}, p AS (SELECT activity_id, t_s AS t, round(dist_km, 6) AS km FROM legs), b AS (SELECT x.activity_id, x.t, x.bpm, p.t AS tb, p.km AS kb FROM sensor x ASOF LEFT JOIN p ON p.activity_id = x.activity_id AND p.t <= x.t), a AS (SELECT x.activity_id, x.t, p.t AS ta, p.km AS ka FROM sensor x ASOF LEFT JOIN p ON p.activity_id = x.activity_id AND p.t >= x.t) SELECT b.activity_id, b.t, b.bpm, CASE WHEN ta IS NOT NULL AND (tb IS NULL OR ta - b.t <= b.t - tb) THEN ka ELSE kb END AS km FROM b JOIN a ON a.activity_id = b.activity_id AND a.t = b.t")
def jn_02(spark, d):
    p = legs(spark, d).select("activity_id", F.col("t_s").alias("t"), rnd("dist_km").alias("km"))
    return asof.asof_nearest(p, _sensor(spark, d), "t", "km", "activity_id")


@query("jn_03", f"WITH {TRK}, {_SENSOR}, {_SPAN} SELECT s.activity_id, round(AVG(bpm)) AS hr_avg, MAX(bpm) AS hr_max FROM span s JOIN sensor x ON x.activity_id = s.activity_id AND x.t BETWEEN s.first AND s.last GROUP BY 1")
def jn_03(spark, d):
    j = asof.within(_span(spark, d), _sensor(spark, d), "t", "first", "last", 600, ["activity_id"])
    return j.groupBy("activity_id").agg(F.round(F.avg("bpm")).alias("hr_avg"), F.max("bpm").alias("hr_max"))


@query("jn_04", f"WITH {TRK}, {_SENSOR}, {_SPAN}, i AS (SELECT x.activity_id, x.t - LAG(x.t) OVER w AS dt, (bpm + LAG(bpm) OVER w) / 2 AS m FROM sensor x JOIN span s ON s.activity_id = x.activity_id AND x.t BETWEEN first AND last WINDOW w AS (PARTITION BY x.activity_id ORDER BY x.t)), z AS (SELECT *, (m - 60) / 130.0 AS f FROM i WHERE dt > 0 AND dt <= 300) SELECT activity_id, CAST(COALESCE(SUM(dt) FILTER (WHERE f < 0.6), 0) AS BIGINT) AS z1, CAST(COALESCE(SUM(dt) FILTER (WHERE f >= 0.6 AND f < 0.7), 0) AS BIGINT) AS z2, CAST(COALESCE(SUM(dt) FILTER (WHERE f >= 0.7 AND f < 0.8), 0) AS BIGINT) AS z3, CAST(COALESCE(SUM(dt) FILTER (WHERE f >= 0.8 AND f < 0.9), 0) AS BIGINT) AS z4, CAST(COALESCE(SUM(dt) FILTER (WHERE f >= 0.9), 0) AS BIGINT) AS z5 FROM z GROUP BY 1")
def jn_04(spark, d):
    return asof.heart_zones(_sensor(spark, d).join(_span(spark, d), "activity_id"), "first", "last", 60.0, 190.0)


@query("jn_05", f"WITH {TRK}, {_SENSOR}, {_SPAN} SELECT s.activity_id, COALESCE(lo <= first - 80 AND hi >= last + 80, false) AS covered FROM span s LEFT JOIN (SELECT activity_id, MIN(t) AS lo, MAX(t) AS hi FROM sensor GROUP BY 1) r ON r.activity_id = s.activity_id")
def jn_05(spark, d):
    return asof.coverage(_span(spark, d), _sensor(spark, d), -80).select("activity_id", "covered")


@query("jn_07", f"WITH {TRK}, {_SENSOR}, r AS (SELECT bpm, ROW_NUMBER() OVER (ORDER BY bpm) - 1 AS k, COUNT(*) OVER () AS n FROM sensor WHERE bpm > 0) SELECT bpm FROM r WHERE k = least(n - 1, CAST(floor(n * CAST(0.995 AS DOUBLE)) AS BIGINT))")
def jn_07(spark, d):
    return asof.percentile_by_place(_sensor(spark, d), "bpm", 0.995)


@query("jn_09", f"WITH {ACT}, w AS (SELECT CAST(date_trunc('month', d) AS DATE) + 14 AS d, round(70 + SUM(n) % 20, 2) AS kg FROM act WHERE month(d) % 3 = 0 GROUP BY 1) SELECT a.activity_id, a.d, CAST(COALESCE(kg, 75) AS DOUBLE) AS kg FROM act a ASOF LEFT JOIN w ON w.d <= a.d")
def jn_09(spark, d):
    a = activities(spark, d)
    w = a.where(F.month("d") % 3 == 0).groupBy(F.date_add(F.trunc("d", "month"), 14).alias("d")).agg((70 + F.sum("n") % 20).cast("double").alias("kg"))
    return asof.asof_backward(a.select("activity_id", "d"), w, "d", "kg").withColumn("kg", F.coalesce("kg", F.lit(75.0)))


@query("jn_11", f"WITH {TRK} SELECT arg_max(ele, event_id) FILTER (WHERE ele IS NOT NULL) AS ele FROM trk")
def jn_11(spark, d):
    return asof.latest_value(track_points(spark, d), "ele", "event_id")


@query("jn_12", "SELECT a.event_id AS id_a, b.event_id AS id_b FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'signup' AND abs(date_diff('second', a.ts, b.ts)) <= 600")
def jn_12(spark, d):
    e = read(spark, d, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    side = lambda k: e.where(F.col("event_type") == k).select(F.col("event_id").alias("id"), "t")
    return asof.near_in_time(side("purchase"), side("signup"), 600)


@query("jn_13", "SELECT n_name, r_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def jn_13(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


# ---------------------------------------------------------------- spatial

_RINGS = "ring AS (SELECT CAST(k AS BIGINT) AS region_id, CAST(49.995 AS DOUBLE) + CAST(0.002 AS DOUBLE) * k AS la, CAST(-115.998 AS DOUBLE) + CAST(0.003 AS DOUBLE) * k AS lo FROM range(6) r(k)), edge AS (SELECT region_id, la AS alat, lo AS alon, la + CAST(0.004 AS DOUBLE) AS blat, lo + CAST(0.001 AS DOUBLE) AS blon FROM ring UNION ALL SELECT region_id, la + CAST(0.004 AS DOUBLE), lo + CAST(0.001 AS DOUBLE), la + CAST(0.001 AS DOUBLE), lo + CAST(0.006 AS DOUBLE) FROM ring UNION ALL SELECT region_id, la + CAST(0.001 AS DOUBLE), lo + CAST(0.006 AS DOUBLE), la, lo FROM ring)"


def _regions(spark):
    r = spark.range(6).select(F.col("id").alias("region_id"), (49.995 + 0.002 * F.col("id")).alias("la"), (-115.998 + 0.003 * F.col("id")).alias("lo"))
    at = lambda a, b: F.struct((F.col("la") + a).alias("lat"), (F.col("lo") + b).alias("lon"))
    return r.select("region_id", F.array(at(0.0, 0.0), at(0.004, 0.001), at(0.001, 0.006)).alias("ring"))


_INSIDE = f"{_RINGS}, inside AS (SELECT activity_id, seq, region_id FROM trk, edge WHERE (alat > lat) <> (blat > lat) AND lon < (blon - alon) * (lat - alat) / (blat - alat) + alon GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1)"


@query("spa_01", f"WITH {TRK}, {_INSIDE} SELECT activity_id, seq, region_id FROM inside")
def spa_01(spark, d):
    return spatial.points_in_regions(track_points(spark, d), spatial.ring_edges(_regions(spark)))


@query("spa_02", f"WITH {TRK}, {_INSIDE} SELECT i.activity_id, region_id, COUNT(*) AS inside FROM inside i JOIN (SELECT activity_id, COUNT(*) AS total FROM trk GROUP BY 1) t ON t.activity_id = i.activity_id GROUP BY 1, 2, total HAVING COUNT(*) >= greatest(1, floor(total * CAST(0.15 AS DOUBLE)))")
def spa_02(spark, d):
    return spatial.region_tags(track_points(spark, d), spatial.ring_edges(_regions(spark)))


@query("spa_03", f"WITH {TRK} SELECT activity_id, round(AVG(lat), 10) AS lat, round(AVG(lon), 10) AS lon FROM trk GROUP BY 1")
def spa_03(spark, d):
    return spatial.centroids(track_points(spark, d)).select("activity_id", rnd("lat", 10).alias("lat"), rnd("lon", 10).alias("lon"))


_M = "(CAST(3.141592653589793 AS DOUBLE) * CAST(6371000.0 AS DOUBLE) / 180)"


@query("spa_05", f"WITH {TRK} SELECT DISTINCT activity_id, CAST(round_even(lat * {_M} / 120, 0) AS BIGINT) AS cn, CAST(round_even(lon * {_M} * cos(radians(lat)) / 120, 0) AS BIGINT) AS ce FROM trk")
def spa_05(spark, d):
    return spatial.grid_cells(track_points(spark, d), 120.0).select("activity_id", "cn", "ce").distinct()


_CELLS = f"cells AS (SELECT DISTINCT activity_id, CAST(floor(lat * {_M} / 60) AS BIGINT) AS cn, CAST(floor(lon * {_M} * cos(radians(CAST(50.7 AS DOUBLE))) / 60) AS BIGINT) AS ce FROM trk WHERE seq % 3 = 0)"


def _cells(spark, d):
    return spatial.cell_sets(track_points(spark, d), 60.0, 50.7, 3)


@query("spa_06", f"WITH {TRK}, {_CELLS} SELECT activity_id, cn, ce FROM cells")
def spa_06(spark, d):
    return _cells(spark, d)


_BOX = "box AS (SELECT activity_id, MIN(lat) AS a, MIN(lon) AS b, MAX(lat) AS c, MAX(lon) AS d FROM trk GROUP BY 1)"


@query("spa_08", f"WITH {TRK}, {_BOX}, p AS (SELECT x.activity_id AS a_id, y.activity_id AS b_id, greatest(0, least(x.c, y.c) - greatest(x.a, y.a)) * greatest(0, least(x.d, y.d) - greatest(x.b, y.b)) AS i, (x.c - x.a) * (x.d - x.b) + (y.c - y.a) * (y.d - y.b) AS s FROM box x JOIN box y ON y.activity_id = x.activity_id + 1) SELECT a_id AS a, b_id AS b, round(i / (s - i), 6) AS iou FROM p")
def spa_08(spark, d):
    b = T.bounding_boxes(track_points(spark, d))
    cols = ["min_lat", "min_lon", "max_lat", "max_lon"]
    x = b.toDF("a", *(f"{c}_a" for c in cols))
    y = b.toDF("b", *(f"{c}_b" for c in cols)).withColumn("a", F.col("b") - 1)
    return x.join(y, "a").select("a", "b", rnd(spatial.box_overlap([F.col(f"{c}_a") for c in cols], [F.col(f"{c}_b") for c in cols])).alias("iou"))


# ---------------------------------------------------------------- line matching

_WAYS = "way AS (SELECT s_suppkey AS way_pos, 'W' || CAST(s_suppkey % 12 AS VARCHAR) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'road' ELSE 'trail' END AS kind, CAST(0 AS BIGINT) AS i, CAST(49.993 AS DOUBLE) + CAST(0.0001 AS DOUBLE) * (s_suppkey * 37 % 140) AS alat, CAST(-116.001 AS DOUBLE) + CAST(0.0001 AS DOUBLE) * (s_suppkey * 53 % 270) AS alon, CAST(49.993 AS DOUBLE) + CAST(0.0001 AS DOUBLE) * (s_suppkey * 71 % 140) AS blat, CAST(-116.001 AS DOUBLE) + CAST(0.0001 AS DOUBLE) * (s_suppkey * 89 % 270) AS blon FROM supplier)"


def _ways(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier")
    at = lambda base, m, n: (base + 0.0001 * (k * m % n))
    return s.select(k.alias("way_pos"), F.concat(F.lit("W"), (k % 12).cast("string")).alias("name"), F.when(k % 3 == 0, "road").otherwise("trail").alias("kind"), F.lit(0).cast("long").alias("i"), at(49.993, 37, 140).alias("alat"), at(-116.001, 53, 270).alias("alon"), at(49.993, 71, 140).alias("blat"), at(-116.001, 89, 270).alias("blon"))


_SNAP = f"""xy AS (SELECT l.activity_id, l.seq, way_pos, w.name, (alon - lon) * cos(radians(lat)) * {_M} AS ax, (alat - lat) * {_M} AS ay, (blon - lon) * cos(radians(lat)) * {_M} AS bx, (blat - lat) * {_M} AS byy FROM legs l, way w WHERE NOT l.assisted),
tt AS (SELECT *, CASE WHEN pow(bx - ax, 2) + pow(byy - ay, 2) > 0 THEN greatest(0.0, least(1.0, (-ax * (bx - ax) - ay * (byy - ay)) / (pow(bx - ax, 2) + pow(byy - ay, 2)))) ELSE 0.0 END AS t FROM xy),
dd AS (SELECT *, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (byy - ay), 2)) AS d FROM tt),
best AS (SELECT activity_id, seq, name, d, way_pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY activity_id, seq ORDER BY d, way_pos) AS r FROM dd WHERE d < 25) WHERE r = 1),
snapped AS (SELECT l.*, b.name, b.d, b.way_pos FROM legs l LEFT JOIN best b ON b.activity_id = l.activity_id AND b.seq = l.seq)"""


def _snapped(spark, d):
    return spatial.snap(legs(spark, d), _ways(spark, d), 25.0)


@query("tm_01", f"WITH {LEGS}, {_WAYS}, {_SNAP} SELECT activity_id, seq, name, round(d, 4) AS d FROM snapped")
def tm_01(spark, d):
    return _snapped(spark, d).select("activity_id", "seq", "name", rnd("d", 4).alias("d"))


_RUNS = """sn AS (SELECT *, CASE WHEN name IS NOT DISTINCT FROM LAG(name) OVER w AND seq > 0 THEN 0 ELSE 1 END AS nw FROM snapped WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
sr AS (SELECT *, SUM(nw) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM sn),
tmrun AS (SELECT activity_id, name, MIN(seq) AS "start", MAX(seq) + 1 AS "end", COUNT(*) AS n, MAX(dist_km) - MIN(dist_km) AS ridden_km FROM sr WHERE name IS NOT NULL GROUP BY activity_id, run, name HAVING COUNT(*) >= 2)"""


@query("tm_02", f'WITH {LEGS}, {_WAYS}, {_SNAP}, {_RUNS} SELECT activity_id, name, "start", "end", n, round(ridden_km, 5) AS ridden_km FROM tmrun')
def tm_02(spark, d):
    return spatial.runs(_snapped(spark, d), 2).withColumn("ridden_km", rnd("ridden_km", 5))


_LENGTHS = f"lens AS (SELECT name, SUM(m) AS length_m, arg_min(kind, r) AS kind FROM (SELECT name, kind, {hav('alat', 'alon', 'blat', 'blon', True)} AS m, ROW_NUMBER() OVER (PARTITION BY name ORDER BY {hav('alat', 'alon', 'blat', 'blon', True)} DESC, way_pos) AS r FROM way) GROUP BY 1)"


def _lengths(spark, d):
    c = F.col
    return spatial.way_lengths(_ways(spark, d), geo.haversine_of_differences(c("alat"), c("alon"), c("blat"), c("blon")))


@query("tm_04", f"WITH {_WAYS}, {_LENGTHS} SELECT name, round(length_m, 3) AS length_m, kind FROM lens")
def tm_04(spark, d):
    return _lengths(spark, d).withColumn("length_m", rnd("length_m", 3))


@query("tm_04_kinds", f"WITH {LEGS}, {_WAYS}, {_SNAP}, k AS (SELECT activity_id, s.name, w.kind, COUNT(*) AS n, MIN(seq) AS seen FROM snapped s JOIN way w ON w.way_pos = s.way_pos GROUP BY 1, 2, 3) SELECT activity_id, name, arg_max(kind, (n, -seen)) AS kind FROM k GROUP BY 1, 2")
def tm_04_kinds(spark, d):
    return spatial.majority_kinds(_snapped(spark, d), _ways(spark, d))


_BOTH = """e AS (SELECT r.*, a.ele AS e0, b.ele AS e1, a.t_s AS t0, b.t_s AS t1, b.lon >= a.lon AS along FROM tmrun r JOIN trk a ON a.activity_id = r.activity_id AND a.seq = r."start" JOIN trk b ON b.activity_id = r.activity_id AND b.seq = r."end" - 1),
dirs AS (SELECT *, CASE WHEN n < 2 THEN 'mixed' WHEN name <> 'W3' AND COALESCE(e1, 0) - COALESCE(e0, 0) >= 10 THEN 'up' WHEN name <> 'W3' AND COALESCE(e1, 0) - COALESCE(e0, 0) <= -10 THEN 'down' WHEN along THEN 'forward' ELSE 'reverse' END AS direction FROM e)"""


def _directed(spark, d):
    """Runs with their direction; W3 stands for a loop."""
    p = track_points(spark, d).select("activity_id", "seq", "ele", "lon", "t_s")
    r = spatial.runs(_snapped(spark, d), 2).join(p.toDF("activity_id", "start", "e0", "lon0", "t0"), ["activity_id", "start"])
    r = r.join(p.select("activity_id", (F.col("seq") + 1).alias("end"), F.col("ele").alias("e1"), F.col("lon").alias("lon1"), F.col("t_s").alias("t1")), ["activity_id", "end"])
    way = spatial.direction(F.col("e0"), F.col("e1"), F.col("n"), F.col("lon1") >= F.col("lon0"), F.col("name") == "W3")
    return r.select("activity_id", "name", "start", "end", "n", "ridden_km", way.alias("direction"), (F.col("t1") - F.col("t0")).alias("duration"))


@query("tm_12", f'WITH {LEGS}, {_WAYS}, {_SNAP}, {_RUNS}, {_BOTH} SELECT activity_id, "start", direction FROM dirs')
def tm_12(spark, d):
    return _directed(spark, d).select("activity_id", "start", "direction")


_TOUCH = f"""f AS (SELECT name, arg_min(alat, way_pos) AS alat, arg_min(alon, way_pos) AS alon, arg_min(blat, way_pos) AS blat, arg_min(blon, way_pos) AS blon FROM way GROUP BY 1),
tch AS (SELECT r.activity_id, r.name, r."start", bool_or({hav("lat", "lon", "alat", "alon", True)} <= 150) AS a, bool_or({hav("lat", "lon", "blat", "blon", True)} <= 150) AS b FROM tmrun r JOIN trk t ON t.activity_id = r.activity_id AND t.seq >= r."start" AND t.seq < r."end" JOIN f ON f.name = r.name GROUP BY 1, 2, 3)"""
_SHORT = "slen AS (SELECT name, length_m / 40 AS length_m FROM lens)"


def _touched(spark, d):
    ends = _ways(spark, d).groupBy("name").agg(*(F.min_by(c, "way_pos").alias(c) for c in ("alat", "alon", "blat", "blon")))
    return network.touches(track_points(spark, d), spatial.runs(_snapped(spark, d), 2), ends, 150.0)


def _short(spark, d):
    """Lengths of a fortieth, so that tracks come to cover some."""
    return _lengths(spark, d).select("name", (F.col("length_m") / 40).alias("length_m"))


@query("tm_13", f'WITH {LEGS}, {_WAYS}, {_SNAP}, {_RUNS}, {_LENGTHS}, {_SHORT}, {_TOUCH}, {_BOTH}, v AS (SELECT r.*, 100 * ridden_km / (length_m / 1000) AS raw, COALESCE(a AND b, false) AS ab FROM dirs r JOIN slen l ON l.name = r.name LEFT JOIN tch ON tch.activity_id = r.activity_id AND tch.name = r.name AND tch."start" = r."start" WHERE ridden_km >= 0.05) SELECT activity_id, name, "start", direction, round(least(100.0, raw), 3) AS coverage, raw >= 85 OR (raw >= 60 AND ab) AS completed, raw >= 60 AND raw < 85 AND ab AS by_ends, ROW_NUMBER() OVER (PARTITION BY activity_id ORDER BY "start") AS place FROM v')
def tm_13(spark, d):
    t = spatial.timeline(_directed(spark, d), _short(spark, d), _touched(spark, d))
    return t.select("activity_id", "name", "start", "direction", rnd("coverage", 3).alias("coverage"), "completed", "by_ends", "place")


@query("tm_13_directions", f'WITH {LEGS}, {_WAYS}, {_SNAP}, {_RUNS}, {_LENGTHS}, {_SHORT}, {_TOUCH}, {_BOTH}, v AS (SELECT r.*, CAST(t1 - t0 AS BIGINT) AS duration, 100 * ridden_km / (length_m / 1000) AS raw, COALESCE(a AND b, false) AS ab FROM dirs r JOIN slen l ON l.name = r.name LEFT JOIN tch ON tch.activity_id = r.activity_id AND tch.name = r.name AND tch."start" = r."start" WHERE ridden_km >= 0.05), c AS (SELECT *, raw >= 85 OR (raw >= 60 AND ab) AS completed FROM v) SELECT activity_id, name, direction, COUNT(*) AS visits, COUNT(*) FILTER (WHERE completed) AS completions, round(SUM(ridden_km), 5) AS ridden_km, MIN(duration) FILTER (WHERE completed) AS best, arg_max(duration, "start") FILTER (WHERE completed) AS last FROM c GROUP BY 1, 2, 3')
def tm_13_directions(spark, d):
    t = spatial.timeline(_directed(spark, d), _short(spark, d), _touched(spark, d))
    return spatial.by_direction(t).withColumn("ridden_km", rnd("ridden_km", 5))


@query("tm_14", f"WITH {LEGS}, {_WAYS}, {_SNAP}, {_RUNS}, {_LENGTHS}, {_SHORT}, {_TOUCH}, ab AS (SELECT activity_id, name, bool_or(a) AND bool_or(b) AS both_ends FROM tch GROUP BY 1, 2), g AS (SELECT activity_id, r.name, COUNT(*) AS visits, SUM(ridden_km) AS km, 100 * SUM(ridden_km) / (any_value(length_m) / 1000) AS raw FROM tmrun r JOIN slen l ON l.name = r.name GROUP BY 1, 2) SELECT g.activity_id, g.name, visits, round(km, 5) AS ridden_km, round(least(100.0, raw), 3) AS coverage, raw >= 85 OR (raw >= 60 AND COALESCE(both_ends, false)) AS completed, raw >= 60 AND raw < 85 AND COALESCE(both_ends, false) AS by_ends FROM g LEFT JOIN ab ON ab.activity_id = g.activity_id AND ab.name = g.name WHERE raw >= 5")
def tm_14(spark, d):
    s = spatial.summary(spatial.runs(_snapped(spark, d), 2), _short(spark, d), _touched(spark, d))
    return s.withColumns({"ridden_km": rnd("ridden_km", 5), "coverage": rnd("coverage", 3)})


@query("tm_15", f"WITH {LEGS}, {_WAYS}, {_SNAP} SELECT activity_id, COUNT(*) AS points, COUNT(name) AS matched, round(COUNT(name) / COUNT(*), 6) AS rate FROM snapped GROUP BY 1")
def tm_15(spark, d):
    return spatial.match_rates(_snapped(spark, d)).withColumn("rate", rnd("rate"))


def _attempts(spark, d):
    return activities(spark, d).select("activity_id", F.col("place").alias("name"), "direction", "duration", (F.col("n") > 1).alias("completed"), "type")


_ATT = f"{ACT}, att AS (SELECT activity_id, place AS name, direction, duration, n > 1 AS completed, type FROM act)"


@query("lb_01", f"WITH {_ATT} SELECT name, direction, activity_id, ROW_NUMBER() OVER (PARTITION BY name, direction ORDER BY duration, activity_id) AS rank, COUNT(*) OVER (PARTITION BY name, direction) AS total FROM att WHERE completed")
def lb_01(spark, d):
    return spatial.leaderboards(_attempts(spark, d), ["name", "direction"]).select("name", "direction", "activity_id", "rank", "total")


@query("lb_03", f"WITH {_ATT} SELECT name, string_agg(DISTINCT direction, ',' ORDER BY direction) AS directions FROM att WHERE completed GROUP BY 1")
def lb_03(spark, d):
    return spatial.directions(_attempts(spark, d))


@query("win_08", f"WITH {_ATT} SELECT activity_id, ROW_NUMBER() OVER (PARTITION BY name ORDER BY duration, activity_id) AS rank, COUNT(*) OVER (PARTITION BY name) AS total FROM att WHERE completed")
def win_08(spark, d):
    return spatial.leaderboards(_attempts(spark, d), ["name"]).select("activity_id", "rank", "total")


_LINE = "tl AS (SELECT activity_id, CAST(event_id % 2 AS VARCHAR) AS name, CASE WHEN event_id % 7 = 0 THEN 'lift' ELSE 'trail' END AS kind, CASE WHEN event_id % 5 < 4 THEN 'up' ELSE 'down' END AS direction, seq AS start_idx, seq + 1 + event_id % 2 AS end_idx, CASE WHEN event_id % 11 > 0 THEN t_s END AS start_t, CASE WHEN event_id % 6 > 0 THEN t_s + 5 END AS end_t FROM trk WHERE event_type <> 'error')"


def _entries(spark, d):
    """Timeline entries of each point but errors: of two names, kinds and directions, some without times."""
    i = F.col("event_id")
    p = track_points(spark, d).where("event_type != 'error'")
    kind, direction = F.when(i % 7 == 0, "lift").otherwise("trail"), F.when(i % 5 < 4, "up").otherwise("down")
    return p.select("activity_id", (i % 2).cast("string").alias("name"), kind.alias("kind"), direction.alias("direction"), F.col("seq").alias("start_idx"), (F.col("seq") + 1 + i % 2).alias("end_idx"), F.when(i % 11 > 0, F.col("t_s")).alias("start_t"), F.when(i % 6 > 0, F.col("t_s") + 5).alias("end_t"))


#: Entries one after the other, each against what has been merged so far.
_MERGED = "o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY activity_id ORDER BY start_idx, end_idx) AS k FROM tl), mg AS (SELECT activity_id, k, name, kind, direction, 1 AS g, start_idx, end_idx, start_t, end_t FROM o WHERE k = 1 UNION ALL SELECT o.activity_id, o.k, o.name, o.kind, o.direction, CASE WHEN near THEN g ELSE g + 1 END, CASE WHEN near THEN m0 ELSE o.start_idx END, o.end_idx, CASE WHEN near THEN s0 ELSE o.start_t END, CASE WHEN near THEN COALESCE(o.end_t, e0) ELSE o.end_t END FROM (SELECT o.*, m.g, m.start_idx AS m0, m.start_t AS s0, m.end_t AS e0, m.name = o.name AND m.kind = o.kind AND m.direction = o.direction AND o.start_idx - m.end_idx BETWEEN 0 AND 250 AND COALESCE(o.start_t - m.end_t <= 900, true) AS near FROM mg m JOIN o ON o.activity_id = m.activity_id AND o.k = m.k + 1) o)"


@query("rte_01", f"WITH RECURSIVE {TRK}, {_LINE}, {_MERGED} SELECT activity_id, name, kind, direction, MIN(start_idx) AS start_idx, MAX(end_idx) AS end_idx, arg_max(start_t, k) AS start_t, arg_max(end_t, k) AS end_t, COUNT(*) AS parts FROM mg GROUP BY activity_id, g, name, kind, direction")
def rte_01(spark, d):
    return spatial.coalesced(_entries(spark, d))


@query("spa_11", f"WITH {TRK}, v AS (SELECT CAST(l AS BIGINT) AS line_id, CAST(k AS BIGINT) AS i, 49.995 + 0.0002 * l + 0.0003 * k AS vlat, -115.999 + 0.0005 * l + 0.0004 * k AS vlon FROM range(8) a(l), range(30) b(k) WHERE k % 3 = 0), h AS (SELECT DISTINCT activity_id, line_id, i FROM v, trk WHERE seq % 3 = 0 AND {hav('vlat', 'vlon', 'lat', 'lon', True)} <= 40) SELECT activity_id, line_id, round(COUNT(*) / 10.0, 6) AS covered FROM h GROUP BY 1, 2")
def spa_11(spark, d):
    v = spark.range(240).select(F.floor(F.col("id") / 30).alias("line_id"), (F.col("id") % 30).alias("i"))
    v = v.select("line_id", "i", (49.995 + 0.0002 * F.col("line_id") + 0.0003 * F.col("i")).alias("vlat"), (-115.999 + 0.0005 * F.col("line_id") + 0.0004 * F.col("i")).alias("vlon"))
    return spatial.track_coverage(v, track_points(spark, d)).withColumn("covered", rnd("covered"))


# ---------------------------------------------------------------- similarity and sets

_PAIR = "sz AS (SELECT activity_id, COUNT(*) AS n FROM cells GROUP BY 1), pr AS (SELECT x.activity_id AS a, y.activity_id AS b, COUNT(*) AS both_n FROM cells x JOIN cells y ON x.cn = y.cn AND x.ce = y.ce AND x.activity_id < y.activity_id GROUP BY 1, 2), score AS (SELECT a, b, both_n, both_n / (p.n + q.n - both_n) AS jaccard, both_n / least(p.n, q.n) AS containment FROM pr JOIN sz p ON p.activity_id = a JOIN sz q ON q.activity_id = b)"


@query("sim_04", f"WITH {TRK}, {_CELLS}, {_PAIR} SELECT a, b, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM score")
def sim_04(spark, d):
    return similarity.pair_scores(_cells(spark, d)).select("a", "b", rnd("jaccard").alias("jaccard"), rnd("containment").alias("containment"))


@query("set_04", f"WITH {TRK}, {_CELLS}, {_PAIR} SELECT a, b, both_n AS \"both\" FROM score WHERE jaccard >= 0.1")
def set_04(spark, d):
    return similarity.similar_pairs(_cells(spark, d), 0.1).select("a", "b", "both")


_DUP = "dact AS (SELECT activity_id, DATE '2024-01-01' + CAST(activity_id % 4 AS INTEGER) AS d, MAX(seq) AS km, MAX(t_s) AS dur FROM trk GROUP BY 1), dup AS (SELECT x.activity_id AS a, y.activity_id AS b, x.d FROM dact x JOIN dact y ON x.d = y.d AND x.activity_id < y.activity_id LEFT JOIN score s ON s.a = x.activity_id AND s.b = y.activity_id WHERE CASE WHEN x.activity_id % 5 > 0 AND y.activity_id % 5 > 0 THEN COALESCE(jaccard >= 0.25, false) ELSE abs(x.km - y.km) <= 0.05 * greatest(x.km, y.km) AND abs(x.dur - y.dur) <= 0.05 * greatest(x.dur, y.dur) END)"


def _dups(spark, d):
    p = track_points(spark, d)
    a = p.groupBy("activity_id").agg(F.max("seq").alias("km"), F.max("t_s").alias("duration")).withColumns({"d": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("activity_id") % 4).cast("int")), "has_cells": F.col("activity_id") % 5 > 0})
    return similarity.duplicate_pairs(a, _cells(spark, d), 0.25)


@query("sim_01", f"WITH {TRK}, {_CELLS}, {_PAIR}, {_DUP} SELECT a, b, CAST(d AS DATE) AS d FROM dup")
def sim_01(spark, d):
    return _dups(spark, d)


@query("sim_03", f"WITH {TRK}, {_BOX}, r AS (SELECT b.*, MAX(seq) AS km FROM box b JOIN trk t ON t.activity_id = b.activity_id GROUP BY ALL), g AS (SELECT r.*, CASE WHEN activity_id % 4 = 0 THEN '' ELSE CAST(activity_id % 3 AS VARCHAR) END AS region FROM r) SELECT DISTINCT x.activity_id AS a, y.activity_id AS b FROM g x JOIN g y ON x.region = y.region AND x.activity_id < y.activity_id WHERE abs(x.km - y.km) <= 0.2 * greatest(x.km, y.km) AND COALESCE(greatest(0, least(x.c, y.c) - greatest(x.a, y.a)) * greatest(0, least(x.d, y.d) - greatest(x.b, y.b)) / nullif((x.c - x.a) * (x.d - x.b) + (y.c - y.a) * (y.d - y.b) - greatest(0, least(x.c, y.c) - greatest(x.a, y.a)) * greatest(0, least(x.d, y.d) - greatest(x.b, y.b)), 0), 0) >= 0.3")
def sim_03(spark, d):
    p = track_points(spark, d)
    r = T.bounding_boxes(p).join(p.groupBy("activity_id").agg(F.max("seq").alias("km")), "activity_id")
    regions = F.when(F.col("activity_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("activity_id") % 3).cast("string")))
    return similarity.candidates(r.withColumn("regions", regions))


@query("sim_06", f"WITH {TRK}, {_CELLS}, {_PAIR}, m AS (SELECT DISTINCT activity_id, activity_id % 6 AS cluster FROM trk), s2 AS (SELECT a, b, jaccard FROM score UNION ALL SELECT b, a, jaccard FROM score), g AS (SELECT x.cluster, x.activity_id, SUM(jaccard) AS s FROM m x JOIN s2 ON s2.a = x.activity_id JOIN m y ON y.activity_id = s2.b AND y.cluster = x.cluster GROUP BY 1, 2) SELECT cluster, activity_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY round(s, 9) DESC, activity_id) AS r FROM g) WHERE r = 1")
def sim_06(spark, d):
    m = track_points(spark, d).select("activity_id", (F.col("activity_id") % 6).alias("cluster")).distinct().withColumn("d", F.lit("2024-01-01").cast("date"))
    return similarity.medoids_of_cells(m, _cells(spark, d))


@query("set_01", f"WITH {ACT} SELECT activity_id FROM act WHERE km < 1 UNION SELECT activity_id FROM act WHERE gain IS NULL UNION SELECT activity_id FROM act WHERE n > 10")
def set_01(spark, d):
    a = activities(spark, d)
    return a.where("km < 1").select("activity_id").union(a.where("gain IS NULL").select("activity_id")).union(a.where("n > 10").select("activity_id")).distinct()


@query("set_02", f"WITH {_WAYS} SELECT way_pos, name, 'trail' AS kind_tag FROM way WHERE kind = 'trail' UNION ALL SELECT way_pos, name, 'road' FROM way WHERE kind = 'road'")
def set_02(spark, d):
    w = _ways(spark, d)
    pick = lambda k: w.where(F.col("kind") == k).select("way_pos", "name", F.lit(k).alias("kind_tag"))
    return pick("trail").unionByName(pick("road"))


@query("set_03", f"WITH {ACT} SELECT activity_id FROM act WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = activity_id AND l_quantity > 10)")
def set_03(spark, d):
    gone = read(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("activity_id"))
    return activities(spark, d).select("activity_id").join(gone, "activity_id", "left_anti")


# ---------------------------------------------------------------- data quality


_ISSUES = f"""sk AS (SELECT activity_id, COALESCE({hav("LAG(la) OVER w", "LAG(lo) OVER w", "la", "lo")}, 0.0) / 1000 AS leg FROM (SELECT activity_id, seq, AVG(lat) OVER v AS la, AVG(lon) OVER v AS lo FROM legs WINDOW v AS ({ROWS} 2 PRECEDING AND 2 FOLLOWING)) WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
sl AS (SELECT activity_id, SUM(leg) AS smooth_km FROM sk GROUP BY 1),
s AS (SELECT activity_id, MAX(dist_km) AS km, MAX(t_s) - MIN(t_s) AS dur, MAX(speed) AS top, SUM(greatest(ele_delta, 0)) AS gain, COUNT(*) AS n, COUNT(*) FILTER (WHERE spike) AS spikes, MAX(raw_kmh) FILTER (WHERE spike) AS peak, COUNT(*) FILTER (WHERE dist > 1000 AND dt < 300) AS jumps FROM spiked GROUP BY 1),
iss AS (SELECT activity_id, 'tiny_distance' AS code, 'low' AS severity, 1 AS rule FROM s WHERE km < 0.2 UNION ALL SELECT activity_id, 'tiny_duration', 'low', 2 FROM s WHERE dur > 0 AND dur < 60 UNION ALL SELECT activity_id, 'max_speed', 'high', 3 FROM s WHERE top > 150
 UNION ALL SELECT activity_id, 'climb_rate', 'med', 4 FROM s WHERE km > 0.5 AND gain / km > 200 UNION ALL SELECT activity_id, 'teleport', 'high', 5 FROM s WHERE jumps > 0 UNION ALL SELECT activity_id, 'speed_spike', 'med', 6 FROM s WHERE spikes >= 3 OR (spikes >= 1 AND peak >= 80)
 UNION ALL SELECT s.activity_id, 'jitter', 'med', 7 FROM s JOIN sl ON sl.activity_id = s.activity_id WHERE n >= 30 AND km > 1 AND km / smooth_km > 1.3)"""


def _issues(spark, d):
    from ..operators.quality import issues

    return issues(T.spikes(legs(spark, d, True)))


@query("dq_01", f"WITH {JLEGS}, {_SPIKES}, {_ISSUES} SELECT s.activity_id, COALESCE(string_agg(code || ':' || severity, ',' ORDER BY rule), '') AS issues FROM s LEFT JOIN iss ON iss.activity_id = s.activity_id GROUP BY 1")
def dq_01(spark, d):
    return _issues(spark, d).select("activity_id", F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(":"), i["severity"])), ",").alias("issues"))


@query("dq_02", f"WITH {JLEGS}, {_SPIKES} SELECT activity_id, COUNT(*) >= 3 OR (COUNT(*) >= 1 AND MAX(raw_kmh) >= 80) AS flagged FROM spiked WHERE spike GROUP BY 1")
def dq_02(spark, d):
    from ..operators.quality import flagged

    g = T.spikes(legs(spark, d, True)).where("spike").groupBy("activity_id").agg(F.count("*").alias("n"), F.max("raw_kmh").alias("peak"))
    return g.select("activity_id", flagged(F.col("n"), F.col("peak")).alias("flagged"))


_SPIKED_LIST = "fl AS (SELECT activity_id, COUNT(*) AS spikes, MAX(raw_kmh) AS peak FROM spiked WHERE spike AND activity_id % 5 > 0 GROUP BY 1 HAVING COUNT(*) >= 3 OR MAX(raw_kmh) >= 80)"


def _spike_list(spark, d):
    from ..operators.quality import spike_list

    p = T.spikes(legs(spark, d, True))
    return spike_list(p, p.where("activity_id % 5 = 0").select("activity_id").distinct())


@query("dq_03", f"WITH {JLEGS}, {_SPIKES}, {_SPIKED_LIST} SELECT activity_id, spikes, round(peak, 4) AS peak FROM fl")
def dq_03(spark, d):
    """Spiked activities; those of ids divisible by 5 stand for approved ones."""
    return _spike_list(spark, d).withColumn("peak", rnd("peak", 4))


@query("top_07", f"WITH {JLEGS}, {_SPIKES}, {_SPIKED_LIST} SELECT activity_id, ROW_NUMBER() OVER (ORDER BY peak DESC, spikes DESC, activity_id) AS place FROM fl")
def top_07(spark, d):
    return numbered(_spike_list(spark, d), "place", F.desc("peak"), F.desc("spikes"), F.col("activity_id")).select("activity_id", "place")


_LEFT = "lf AS (SELECT activity_id, DATE '2024-01-01' + CAST(activity_id % 9 AS INTEGER) AS d, COUNT(*) AS n, MAX(CASE severity WHEN 'high' THEN 3 WHEN 'med' THEN 2 ELSE 1 END) AS worst, string_agg(code, ',' ORDER BY rule) AS codes FROM iss WHERE code <> 'speed_spike' AND NOT (code = 'jitter' AND activity_id % 4 = 0) GROUP BY 1)"


def _report(spark, d):
    from ..operators.quality import report

    found = _issues(spark, d)
    approved = found.where("activity_id % 4 = 0").select("activity_id", F.lit("jitter").alias("code"))
    return report(found, approved, found.select("activity_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("activity_id") % 9).cast("int")).alias("d")))


@query("dq_05", f"WITH {JLEGS}, {_SPIKES}, {_ISSUES}, {_LEFT} SELECT activity_id, codes, n FROM lf")
def dq_05(spark, d):
    """Issues but for spikes and approved ones; jitter of ids divisible by 4 stands for approved."""
    return _report(spark, d).select("activity_id", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), F.col("n").cast("long").alias("n"))


@query("top_06", f"WITH {JLEGS}, {_SPIKES}, {_ISSUES}, {_LEFT} SELECT activity_id, ROW_NUMBER() OVER (ORDER BY d DESC, worst DESC, n DESC, activity_id) AS place FROM lf")
def top_06(spark, d):
    return numbered(_report(spark, d), "place", F.desc("d"), F.desc("worst"), F.desc("n"), F.col("activity_id")).select("activity_id", "place")


@query("dq_04", f"WITH {TRK} SELECT activity_id, hour(MIN(ts) - INTERVAL 7 HOUR) AS hour FROM trk GROUP BY 1 HAVING hour(MIN(ts) - INTERVAL 7 HOUR) IN (21, 22, 23, 0, 1, 2, 3, 4, 5, 6)")
def dq_04(spark, d):
    from ..operators.quality import odd_starts

    start = track_points(spark, d).groupBy("activity_id").agg(F.min("ts").alias("start"))
    return odd_starts(start, F.lit("Etc/GMT+7")).select("activity_id", F.col("hour").cast("long").alias("hour"))


# ---------------------------------------------------------------- sources and changes that the tables can show


@query("src_10", "SELECT event_id, CAST(k AS BIGINT) AS t, value * k AS temp FROM events, range(3) r(k)")
def src_10(spark, d):
    e = read(spark, d, "events")
    days = e.select("event_id", F.array(*(F.lit(k).cast("long") for k in range(3))).alias("time"), F.array(*(F.col("value") * k for k in range(3))).alias("temp"))
    return days.select("event_id", F.inline(F.arrays_zip("time", "temp"))).withColumnRenamed("time", "t")


@query("snk_04", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def snk_04(spark, d):
    from ..sources.writers import without_archived

    e = read(spark, d, "events")
    return without_archived(e.select("event_id"), e.where("event_type = 'view'"), "event_id")


@query("dml_01", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'patched' ELSE event_type END AS event_type FROM events")
def dml_01(spark, d):
    from ..sources.writers import patched

    e = read(spark, d, "events").select("event_id", "event_type")
    return patched(e, e.where("event_id % 3 = 0").select("event_id", F.lit("patched").alias("event_type")), "event_id")


@query("dml_02", "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'new' FROM events WHERE event_id % 3 = 0 UNION ALL SELECT -event_id, 'new' FROM events WHERE event_id % 3 = 0 AND event_id > 0")
def dml_02(spark, d):
    from ..sources.writers import upserted

    e = read(spark, d, "events").select("event_id", "event_type")
    hit = e.where("event_id % 3 = 0")
    new = hit.select("event_id", F.lit("new").alias("event_type")).unionByName(hit.where("event_id > 0").select((-F.col("event_id")).alias("event_id"), F.lit("new").alias("event_type")))
    return upserted(e, new, "event_id")


@query("gl_16", f"WITH {ACT} SELECT activity_id, COALESCE(CASE WHEN activity_id % 2 = 0 THEN 'kept' END, CASE type WHEN 'BUILDING' THEN 'ride' WHEN 'MACHINERY' THEN 'ski' ELSE 'other' END) AS tag FROM act")
def gl_16(spark, d):
    mapped = F.when(F.col("type") == "BUILDING", "ride").when(F.col("type") == "MACHINERY", "ski").otherwise("other")
    return activities(spark, d).select("activity_id", F.coalesce(F.when(F.col("activity_id") % 2 == 0, "kept"), mapped).alias("tag"))


@query("str_05", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, SUM(nw) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, COUNT(*) AS n, CAST(floor(epoch(MIN(ts))) AS BIGINT) AS start_s FROM s GROUP BY user_id, k")
def str_05(spark, d):
    from ..streaming.tracks import sessions

    s = sessions(read(spark, d, "events"), "6 hours", "1 day")
    return s.select("user_id", "n", F.unix_timestamp("start").alias("start_s"))


@query("str_01", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'view') AND event_id % 5 = 0")
def str_01(spark, d):
    from ..streaming.tracks import thinned

    return thinned(read(spark, d, "events"), ["purchase", "view"]).select("event_id")


@query("str_02", "SELECT event_id FROM events WHERE ts > (SELECT MAX(ts) FROM events WHERE day(ts) <= 15)")
def str_02(spark, d):
    from ..streaming.tracks import after_high_water

    e = read(spark, d, "events")
    return after_high_water(e, e.where(F.dayofmonth("ts") <= 15)).select("event_id")


@query("str_04", "SELECT user_id, event_id, CAST(greatest(0, t - COALESCE(MAX(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t)) AS DOUBLE) AS dt FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)")
def str_04(spark, d):
    """Events as a stream of files in the order of their ids, with the latest time of each user for state."""
    from ..streaming import stateful
    from ..streaming.tracks import read as stream

    e = read(spark, d, "events").select("user_id", "event_id", "ts")
    each = stateful.files_each(e, 3)
    with stateful.rocks(spark):
        return stateful.settled(stateful.ordered_legs(stream(spark, stateful.arrivals(e, "event_id", 3, each=each), e.schema, each), "400 days", 400 * 86400))


@query("str_03_join", "SELECT p.event_id, s.event_id AS sample FROM events p JOIN events s ON s.user_id = p.user_id AND s.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR WHERE p.event_type = 'view' AND s.event_type <> 'view'")
def str_03_join(spark, d):
    """Views as points, other events as sensor samples: two streams that meet within six hours."""
    from ..streaming import stateful
    from ..streaming.tracks import read as stream

    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    side = lambda rows: stream(spark, stateful.arrivals(rows, "event_id", 3), e.schema, 1)
    with stateful.rocks(spark):
        both = stateful.with_samples(side(e.where("event_type = 'view'")), side(e.where("event_type != 'view'")), "6 hours", "400 days")
        return stateful.settled(both.select("event_id", F.col("s_event_id").alias("sample")))


_UPLOADS = f"up AS (SELECT * FROM trk WHERE activity_id % 10 > 0 OR seq < 20), ucells AS (SELECT DISTINCT activity_id, CAST(floor(lat * {_M} / 60) AS BIGINT) AS cn, CAST(floor(lon * {_M} * cos(radians(CAST(50.7 AS DOUBLE))) / 60) AS BIGINT) AS ce FROM up)"


def _followed(spark, d, metres):
    """A store of the cells of all tracks, a tenth of which were uploaded again, cut short; and the tracks as they are then."""
    from ..functions.lineage import new_folder
    from ..streaming import incremental, stateful
    from ..streaming.tracks import read as stream

    p = track_points(spark, d).select("activity_id", "seq", "lat", "lon")
    again = p.where("activity_id % 10 = 0 AND seq < 20").withColumn("uploaded", F.lit(2).cast("long"))
    uploads = p.withColumn("uploaded", F.lit(1).cast("long")).unionByName(again)
    folder = new_folder(spark)
    source = stream(spark, stateful.arrivals(uploads, "uploaded", 2, f"{folder}/in"), uploads.schema, 1)
    incremental.follow(source, f"{folder}/store", 1, lambda t: spatial.cell_sets(t, metres, 50.7), f"{folder}/at")
    return f"{folder}/store", again.unionByName(uploads.where("activity_id % 10 > 0"))


_CELL_ROWS = "activity_id long, cn long, ce long"


@query("str_06", f"WITH {TRK}, {_UPLOADS} SELECT activity_id, cn, ce FROM ucells")
def str_06(spark, d):
    """Cells of tracks that follow their uploads."""
    from ..streaming import incremental

    store, _ = _followed(spark, d, 60.0)
    return incremental.current(spark, store, _CELL_ROWS)


@query("str_07", f"WITH {TRK}, {_UPLOADS} SELECT activity_id, cn, ce FROM ucells")
def str_07(spark, d):
    """The same after a change of the matcher: cells of another size, matched anew from the stored tracks."""
    from ..streaming import incremental

    store, tracks = _followed(spark, d, 500.0)
    incremental.rematch(tracks, store, 2, lambda t: spatial.cell_sets(t, 60.0, 50.7))
    return incremental.current(spark, store, _CELL_ROWS)


# ---------------------------------------------------------------- kernels, which SQL does not express


@query("det_17")
def det_17(spark, d):
    """All detectors side by side: assisted points and runs of each.  Flags of a point stay in one row; only counts and flagged points are turned into rows of an algorithm."""
    from ..operators.kernels import COMPOSED, DETECTORS, detect

    known, p = ["osm", *COMPOSED], legs(spark, d)
    plain = [k for k in DETECTORS if k not in known]
    by = Window.partitionBy("activity_id").orderBy("seq")
    f = detect(p, plain).withColumns({f"{k}_rise": F.col(k) & ~F.coalesce(F.lag(k).over(by), F.lit(False)) for k in plain})
    f = f.groupBy("activity_id").agg(*(F.struct(F.lit(k).alias("algorithm"), F.count_if(k).alias("points"), F.count_if(f"{k}_rise").alias("runs")).alias(k) for k in plain))
    counts = f.select("activity_id", F.explode(F.array(*plain)).alias("x")).select("x.algorithm", "activity_id", "x.points", "x.runs")
    own = Window.partitionBy("algorithm", "activity_id").orderBy("seq")
    found = lifts.detected(p, _lifts(spark, d), known).withColumn("rise", F.coalesce(F.col("seq") - F.lag("seq").over(own) > 1, F.lit(True)))
    found = found.groupBy("algorithm", "activity_id").agg(F.count("*").alias("points"), F.count_if("rise").alias("runs"))
    every = p.select("activity_id").distinct().select(F.explode(F.array(*map(F.lit, known))).alias("algorithm"), "activity_id")
    found = every.join(found, ["algorithm", "activity_id"], "left").select("algorithm", "activity_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("points", "runs")))
    return counts.unionByName(found)


@query("tm_03")
def tm_03(spark, d):
    from ..operators.kernels import coalesce_runs

    r = spatial.runs(_snapped(spark, d), 2)
    t = track_points(spark, d).select("activity_id", "seq", "t_s")
    r = r.join(t.toDF("activity_id", "start", "start_t"), ["activity_id", "start"]).join(t.select("activity_id", (F.col("seq") + 1).alias("end"), F.col("t_s").alias("end_t")), ["activity_id", "end"])
    return coalesce_runs(r.select("activity_id", "name", "start_t", "end_t", "ridden_km"))


_PROGRESS_M = 400.0


def _progress(spark, d):
    ways = _ways(spark, d)
    chain = routes.chain_segments(routes.linked_ways(ways, 50.0, -116.0, 150.0), ways)
    s = _snapped(spark, d).where("name IS NOT NULL").select("activity_id", "name", "seq", "lat", "lon")
    return spatial.progress(s, chain, _PROGRESS_M)


@query("tm_08")
def tm_08(spark, d):
    """How far along which chain of its line each snapped point is."""
    return _progress(spark, d).select("activity_id", "name", "seq", "chain", rnd("progress").alias("progress"))


@query("tm_09")
def tm_09(spark, d):
    from ..operators.kernels import traversals

    return traversals(_progress(spark, d).select("activity_id", "name", "chain", "seq", "progress"), least=3, turn=0.1, window=3)


@query("tm_10")
def tm_10(spark, d):
    """Laps around the middle of each track."""
    from ..operators.kernels import traversals

    p = track_points(spark, d)
    w = Window.partitionBy("activity_id")
    p = p.withColumn("a", F.atan2(F.col("lat") - F.avg("lat").over(w), F.col("lon") - F.avg("lon").over(w)))
    return traversals(T.unwrapped(p, "a").select("activity_id", F.lit("loop").alias("name"), "seq", F.col("a_unwrapped").alias("progress")), loop=True)


@query("tm_07")
def tm_07(spark, d):
    return routes.linked_ways(_ways(spark, d), 50.0, -116.0, 150.0)


@query("rg_02")
def rg_02(spark, d):
    return network.end_clusters(_ways(spark, d), 20.0).select("id", F.array_join("names", ",").alias("names"))


# ---------------------------------------------------------------- networks and routes


@query("tm_05", f"WITH {_WAYS}, e AS (SELECT name, way_pos * 2 AS p, alat AS lat, alon AS lon FROM way UNION ALL SELECT name, way_pos * 2 + 1, blat, blon FROM way) SELECT name, p0, p1, round(d, 3) AS d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY d DESC, p0, p1) AS r FROM (SELECT x.name, x.p AS p0, y.p AS p1, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon', True)} AS d FROM e x JOIN e y ON x.name = y.name AND x.p < y.p)) WHERE r = 1")
def tm_05(spark, d):
    return network.termini(_ways(spark, d)).withColumn("d", rnd("d", 3))


@query("tm_06", f"WITH {_WAYS}, e AS (SELECT name, way_pos * 2 AS p, alat AS lat, alon AS lon FROM way UNION ALL SELECT name, way_pos * 2 + 1, blat, blon FROM way), m AS (SELECT x.name, x.p, COUNT(y.p) AS n FROM e x LEFT JOIN e y ON y.name = x.name AND y.p <> x.p AND {hav('x.lat', 'x.lon', 'y.lat', 'y.lon', True)} <= 60 GROUP BY 1, 2), g AS (SELECT name, COUNT(*) FILTER (WHERE n = 0) AS free, MAX(n) AS most FROM m GROUP BY 1) SELECT name, free, most, CASE WHEN free = 0 AND most = 1 THEN 'loop' WHEN free = 2 AND most <= 1 THEN 'linear' ELSE 'messy' END AS topology FROM g")
def tm_06(spark, d):
    return network.degrees(_ways(spark, d), 60.0)


def _planar(lat, lon):
    """SQL of the distance of a point from the segment a-b on the plane at the point."""
    ax, ay, bx, by = f"((alon - {lon}) * cos(radians({lat})) * {_M})", f"((alat - {lat}) * {_M})", f"((blon - {lon}) * cos(radians({lat})) * {_M})", f"((blat - {lat}) * {_M})"
    t = f"greatest(0.0, least(1.0, (-{ax} * ({bx} - {ax}) - {ay} * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))))"
    return f"sqrt(pow({ax} + {t} * ({bx} - {ax}), 2) + pow({ay} + {t} * ({by} - {ay}), 2))"


_VERTICES = "vert AS (SELECT way_pos AS chain, name, kind, CAST(k AS BIGINT) AS i, way_pos * 10 + k AS id, alat + (blat - alat) * k / 4 AS lat, alon + (blon - alon) * k / 4 AS lon FROM way, range(5) r(k))"


def _vertices(spark, d):
    """Each way as a line of five vertices."""
    k = F.col("i")
    w = _ways(spark, d).drop("i").withColumn("i", F.explode(F.array(*(F.lit(j).cast("long") for j in range(5)))))
    return w.select(F.col("way_pos").alias("chain"), "name", "kind", "i", (F.col("way_pos") * 10 + k).alias("id"), (F.col("alat") + (F.col("blat") - F.col("alat")) * k / 4).alias("lat"), (F.col("alon") + (F.col("blon") - F.col("alon")) * k / 4).alias("lon"))


@query("rg_03", f"WITH {_WAYS}, {_VERTICES}, p AS (SELECT v.id, v.name, v.lat, v.lon, MIN(w.name) AS other FROM vert v JOIN way w ON w.name <> v.name WHERE v.i BETWEEN 1 AND 3 AND {_planar('v.lat', 'v.lon')} <= 8 GROUP BY 1, 2, 3, 4) SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon, least(name, other) || ',' || greatest(name, other) AS names FROM p")
def rg_03(spark, d):
    v = _vertices(spark, d).where("i BETWEEN 1 AND 3").select("id", "name", "lat", "lon")
    j = network.interior_junctions(v, _ways(spark, d))
    return j.select("id", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"), F.array_join("names", ",").alias("names"))


@query("rg_04")
def rg_04(spark, d):
    """Junctions from shared ends and from vertices on others' lines."""
    ways = _ways(spark, d)
    inner = network.interior_junctions(_vertices(spark, d).where("i BETWEEN 1 AND 3").select("id", "name", "lat", "lon"), ways)
    ends = network.end_clusters(ways, 20.0).select("id", "lat", "lon", "names")
    return network.junctions(ends.unionByName(inner.withColumn("id", F.col("id") + 1_000_000_000_000)))


_JUNCTIONS = "jn AS (SELECT 'J' || CAST(v.chain AS VARCHAR) AS junction_id, v.lat + CAST(0.00003 AS DOUBLE) AS lat, v.lon AS lon, unnest([v.name, 'W' || CAST((v.chain + 1) % 12 AS VARCHAR)]) AS jname FROM vert v WHERE v.i = 2 AND v.chain % 3 = 0)"
_EDGES = f"""pin AS (SELECT junction_id, name, chain, arg_min(i, (d, i)) AS i FROM (SELECT j.junction_id, v.name, v.chain, v.i, {hav('j.lat', 'j.lon', 'v.lat', 'v.lon', True)} AS d FROM jn j JOIN vert v ON v.name = j.jname) WHERE d <= 40 GROUP BY 1, 2, 3),
node AS (SELECT name, chain, i, MIN(junction_id) AS node FROM pin WHERE i BETWEEN 1 AND 3 GROUP BY 1, 2, 3 UNION ALL SELECT name, chain, 0, 'start|' || name || '|' || chain FROM vert WHERE i = 0 UNION ALL SELECT name, chain, 4, 'end|' || name || '|' || chain FROM vert WHERE i = 0),
ld AS (SELECT *, LEAD(node) OVER w AS e, LEAD(i) OVER w AS ei FROM node WINDOW w AS (PARTITION BY name, chain ORDER BY i)),
vl AS (SELECT *, SUM(leg) OVER (PARTITION BY name, chain ORDER BY i ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, COALESCE({hav('LAG(lat) OVER w', 'LAG(lon) OVER w', 'lat', 'lon', True)}, 0.0) AS leg FROM vert WINDOW w AS (PARTITION BY name, chain ORDER BY i))),
edge0 AS (SELECT l.name, l.chain, l.node AS start_node, e AS end_node, l.i AS start_i, ei AS end_i, b.m - a.m AS length_m, 'e_' || substr(md5(concat_ws('|', l.name, l.chain, l.node, e)), 1, 8) AS edge_id FROM ld l JOIN vl a ON a.chain = l.chain AND a.i = l.i JOIN vl b ON b.chain = l.chain AND b.i = ei WHERE ei > l.i)"""


def _made_junctions(spark, d):
    v = _vertices(spark, d).where("i = 2 AND chain % 3 = 0")
    return v.select(F.concat(F.lit("J"), F.col("chain").cast("string")).alias("junction_id"), (F.col("lat") + 0.00003).alias("lat"), "lon", F.array("name", F.concat(F.lit("W"), ((F.col("chain") + 1) % 12).cast("string"))).alias("names"))


def _edges(spark, d):
    v = _vertices(spark, d)
    return network.edges(network.pinned(_made_junctions(spark, d), v, 40.0), v)


@query("rg_05", f"WITH {_WAYS}, {_VERTICES}, {_JUNCTIONS}, {_EDGES} SELECT edge_id, name, chain, start_node, end_node, CAST(start_i AS BIGINT) AS start_i, CAST(end_i AS BIGINT) AS end_i, round(length_m, 4) AS length_m FROM edge0")
def rg_05(spark, d):
    return _edges(spark, d).drop("mid_i").withColumn("length_m", rnd("length_m", 4))


@query("rg_06", f"WITH {_WAYS}, {_VERTICES}, {_JUNCTIONS}, {_EDGES} SELECT name, COUNT(*) AS edges, COUNT(DISTINCT chain) AS components, round(SUM(length_m), 3) AS length_m, md5(string_agg(edge_id, ',' ORDER BY edge_id)) AS digest FROM edge0 GROUP BY 1")
def rg_06(spark, d):
    """The network as stored for a region: trails with their edges."""
    a = network.artifact(_edges(spark, d))
    return a.select("name", F.size("edges").cast("long").alias("edges"), "components", rnd("length_m", 3).alias("length_m"), "digest")


@query("gl_05", f"WITH {_WAYS}, {_VERTICES}, {_JUNCTIONS}, {_EDGES} SELECT edge_id, COUNT(*) AS vertices, round(any_value(length_m), 4) AS length_m FROM edge0 e JOIN vert v ON v.chain = e.chain AND v.i BETWEEN start_i AND end_i GROUP BY e.chain, edge_id")
def gl_05(spark, d):
    """Each edge with its own polyline."""
    return network.edge_lines(_edges(spark, d), _vertices(spark, d)).select("edge_id", F.size("line").cast("long").alias("vertices"), rnd("length_m", 4).alias("length_m"))


@query("gl_06", f"WITH {_WAYS}, {_VERTICES}, {_JUNCTIONS}, {_EDGES} SELECT edge_id, round(length_m, 1) AS length_m FROM edge0")
def gl_06(spark, d):
    return _edges(spark, d).select("edge_id", rnd("length_m", 1).alias("length_m"))


@query("gl_17", f"WITH {_WAYS}, {_VERTICES}, {_JUNCTIONS}, {_EDGES}, n AS (SELECT DISTINCT junction_id AS node, lat, lon, 0 AS pass FROM jn UNION ALL SELECT e.start_node, v.lat, v.lon, 1 FROM edge0 e JOIN vert v ON v.chain = e.chain AND v.i = start_i WHERE start_node LIKE 'start%' UNION ALL SELECT e.end_node, v.lat, v.lon, 1 FROM edge0 e JOIN vert v ON v.chain = e.chain AND v.i = end_i WHERE end_node LIKE 'end%') SELECT node, round(arg_max(lat, pass), 7) AS lat, round(arg_max(lon, pass), 7) AS lon FROM n GROUP BY 1")
def gl_17(spark, d):
    n = network.node_places(_made_junctions(spark, d), _edges(spark, d), _vertices(spark, d))
    return n.select("node", rnd("lat", 7).alias("lat"), rnd("lon", 7).alias("lon"))


@query("rg_09")
def rg_09(spark, d):
    """Routes of six ways each, sewn together for a preview."""
    w = _ways(spark, d).select((F.col("way_pos") % 17).alias("route_id"), F.col("way_pos").alias("pos"), "alat", "alon", "blat", "blon")
    return routes.sewn(w, 120.0, 900.0).withColumn("gap_m", rnd("gap_m", 3))


def _timeline(spark, d):
    """Runs on lines as timeline entries."""
    t = track_points(spark, d).select("activity_id", "seq", "t_s")
    r = spatial.runs(_snapped(spark, d), 2).withColumnRenamed("start", "start_idx").withColumn("end_idx", F.col("end") - 1)
    r = r.join(t.toDF("activity_id", "start_idx", "start_t"), ["activity_id", "start_idx"]).join(t.toDF("activity_id", "end_idx", "end_t"), ["activity_id", "end_idx"])
    return r.select("activity_id", F.col("start_idx").alias("entry"), "start_idx", "end_idx", "start_t", "end_t", "name", F.lit("trail").alias("kind"), (F.col("ridden_km") < 0.01).alias("noise"))


def _route_of(spark, d, names):
    """A route along ways 1 and up, whose names it takes in this order."""
    pos = F.coalesce(*(F.when(F.col("chain") == n, i) for i, n in enumerate(names)))
    v = _vertices(spark, d).withColumn("pos", pos.cast("long")).where("pos IS NOT NULL").withColumn("kind", F.lit("trail"))
    end = lambda i, k: v.where(F.col("i") == i).select("pos", F.col("lat").alias(f"{k}lat"), F.col("lon").alias(f"{k}lon"))
    return v.select("pos", "name", "kind").distinct().join(end(0, "a"), "pos").join(end(4, "b"), "pos"), v.select("pos", "name", "kind", "i", "lat", "lon")


@query("rte_03", f'WITH {LEGS}, {_WAYS}, {_SNAP}, {_RUNS}, {_VERTICES}, ep AS (SELECT r.activity_id, r.name, r."start" AS entry, t.seq, t.lat, t.lon FROM tmrun r JOIN trk t ON t.activity_id = r.activity_id AND t.seq >= r."start" AND t.seq < r."end"), tm AS (SELECT activity_id, entry, w.way_pos AS pos, bool_or({hav("e.lat", "e.lon", "alat", "alon", True)} <= 300) AND bool_or({hav("e.lat", "e.lon", "blat", "blon", True)} <= 300) AS touched FROM ep e JOIN way w ON w.name = e.name GROUP BY 1, 2, 3), cv AS (SELECT activity_id, entry, v.chain AS pos, COUNT(DISTINCT v.i) >= 3.75 AS followed FROM ep e JOIN vert v ON v.name = e.name AND {hav("e.lat", "e.lon", "v.lat", "v.lon", True)} <= 40 GROUP BY 1, 2, 3) SELECT tm.activity_id, tm.entry, tm.pos, touched, COALESCE(followed, false) AS followed FROM tm LEFT JOIN cv ON cv.activity_id = tm.activity_id AND cv.entry = tm.entry AND cv.pos = tm.pos WHERE touched OR COALESCE(followed, false)')
def rte_03(spark, d):
    """Entries that satisfy a way of their name, by a touch of both its ends or along it; every point and every vertex counts."""
    v = _vertices(spark, d).withColumn("kind", F.lit("trail")).withColumnRenamed("chain", "pos")
    seg = _ways(spark, d).select(F.col("way_pos").alias("pos"), "name", F.lit("trail").alias("kind"), "alat", "alon", "blat", "blon")
    return routes.every_edge(*routes.satisfied_edges(routes.entry_points(_timeline(spark, d), track_points(spark, d)), seg, v, 300.0, stride=1)).select("activity_id", "entry", "pos", "touched", "followed")


@query("rte_05")
def rte_05(spark, d):
    seg, v = _route_of(spark, d, (1, 2))
    return routes.attempts(_timeline(spark, d), legs(spark, d), seg, v, 0.1, 700.0)


@query("rte_05_all")
def rte_05_all(spark, d):
    """Attempts at every route of a table: the edges of each ride, in its order, are saved as a route."""
    ways = _ways(spark, d)
    edges = ways.select(F.col("way_pos").alias("edge"), "name", F.lit("trail").alias("kind"), "alat", "alon", "blat", "blon")
    vertices = _vertices(spark, d).withColumnRenamed("chain", "edge")
    t = cut(_timeline(spark, d))  # one row an entry
    saved = _from_rides(spark, d, t).select(F.col("activity_id").alias("route_id"), F.col("place").alias("pos"), "edge")
    return routes.attempts_of_routes(t, legs(spark, d), saved, edges, vertices, 0.1, 300.0)


def _from_rides(spark, d, timeline):
    v = _vertices(spark, d).withColumn("kind", F.lit("trail")).withColumnRenamed("chain", "edge")
    mid = v.where("i = 2").select("edge", F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
    e = _ways(spark, d).select(F.col("way_pos").alias("edge"), "name", F.lit("trail").alias("kind"), "alat", "alon", "blat", "blon").join(mid, "edge")
    return routes.from_ride(timeline, track_points(spark, d), e, v, 300.0)


@query("rte_08")
def rte_08(spark, d):
    return _from_rides(spark, d, _timeline(spark, d))


_ROUTE = "rt AS (SELECT l_orderkey AS route_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, 'N' || CAST(l_partkey % 3 AS VARCHAR) AS name, l_quantity AS length_m, l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem)"


def _route(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # partitions by the number of rows, so that what a task sorts doesn't grow with the table
    lines = read(spark, d, "lineitem")
    r = lines.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // 400_000 + 1), "l_orderkey").withColumn("pos", F.row_number().over(w).cast("long"))
    return r.select(F.col("l_orderkey").alias("route_id"), "pos", F.concat(F.lit("N"), (F.col("l_partkey") % 3).cast("string")).alias("name"), F.col("l_quantity").alias("length_m"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"))


@query("rte_02", f"WITH {_ROUTE}, c AS (SELECT *, CASE WHEN pos > 1 AND name IS NOT DISTINCT FROM LAG(name) OVER w THEN 0 ELSE 1 END AS nw FROM rt WINDOW w AS (PARTITION BY route_id ORDER BY pos)), g AS (SELECT *, SUM(nw) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS macro FROM c) SELECT route_id, CAST(macro AS BIGINT) AS macro, name, MIN(pos) AS first_pos, MAX(pos) AS last_pos, SUM(length_m) AS length_m FROM g GROUP BY 1, 2, 3")
def rte_02(spark, d):
    return network.macro_segments(_route(spark, d))


@query("rg_07", f"WITH {_ROUTE}, s AS (SELECT *, CAST(pos * 7 + a AS VARCHAR) AS edge_id FROM rt), e AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS edge_id, 'N' || CAST(p_size % 2 AS VARCHAR) AS name, p_partkey % 50 AS sn, p_size AS en FROM part), k AS (SELECT route_id, CASE WHEN edge_id IN (SELECT edge_id FROM e) THEN 0 WHEN EXISTS (SELECT 1 FROM e WHERE e.name = s.name AND least(sn, en) = least(a, b) AND greatest(sn, en) = greatest(a, b)) THEN 1 WHEN name IN (SELECT name FROM e) THEN 2 ELSE 3 END AS r FROM s) SELECT route_id, COUNT(*) AS segments, CASE MAX(r) WHEN 0 THEN 'fresh' WHEN 1 THEN 'exact' WHEN 2 THEN 'approximate' ELSE 'failed' END AS status FROM k GROUP BY 1")
def rg_07(spark, d):
    s = _route(spark, d).select("route_id", "name", F.col("a").alias("start_node"), F.col("b").alias("end_node"), (F.col("pos") * 7 + F.col("a")).cast("string").alias("edge_id"))
    e = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("edge_id"), F.concat(F.lit("N"), (F.col("p_size") % 2).cast("string")).alias("name"), (F.col("p_partkey") % 50).alias("start_node"), F.col("p_size").alias("end_node"))
    return network.resolved(s, e)


_TRY = "tries AS (SELECT o_orderkey AS activity_id, o_custkey % 40 * 10 AS route_id, o_totalprice AS duration FROM orders WHERE o_orderstatus = 'F')"


def _tries(spark, d):
    return read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("activity_id"), (F.col("o_custkey") % 40 * 10).alias("route_id"), F.col("o_totalprice").alias("duration"))


@query("rg_08", f"WITH {_ROUTE}, {_TRY}, l AS (SELECT route_id, SUM(length_m) AS length_m FROM rt GROUP BY 1), t AS (SELECT route_id, COUNT(*) AS n, MIN(duration) AS best, arg_min(activity_id, (duration, activity_id)) AS best_id FROM tries GROUP BY 1) SELECT l.route_id, length_m, COALESCE(n, 0) AS attempts, best, best_id FROM l LEFT JOIN t ON t.route_id = l.route_id")
def rg_08(spark, d):
    return network.route_list(_route(spark, d), _tries(spark, d))


@query("rte_07", f"WITH {_TRY}, o AS (SELECT route_id, activity_id, MIN(duration) AS duration FROM tries GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY duration, activity_id) AS rank, COUNT(*) OVER (PARTITION BY route_id) AS total FROM o) SELECT *, rank = 1 AS is_best FROM r")
def rte_07(spark, d):
    return network.routes_ridden(_tries(spark, d))


@query("rte_06", f"WITH {_TRY} SELECT route_id, MIN(duration) AS best, arg_min(activity_id, (duration, activity_id)) AS best_id FROM tries GROUP BY 1")
def rte_06(spark, d):
    return _tries(spark, d).groupBy("route_id").agg(F.min("duration").alias("best"), F.min_by("activity_id", F.struct("duration", "activity_id")).alias("best_id"))


@query("rte_09", f"WITH {TRK}, {_LINE}, b AS (SELECT *, LAG(name) OVER (PARTITION BY activity_id ORDER BY start_idx) AS p FROM tl) SELECT activity_id, CASE WHEN length(array_to_string(l, ' → ')) > 80 THEN array_to_string(l[1:3], ' → ') || ' → +' || CAST(len(l) - 3 AS VARCHAR) || ' more' ELSE array_to_string(l, ' → ') END AS title FROM (SELECT activity_id, list(name ORDER BY start_idx) AS l FROM b WHERE name IS DISTINCT FROM p GROUP BY 1)")
def rte_09(spark, d):
    p = track_points(spark, d).where("event_type != 'error'")
    return network.name_chain(p.select("activity_id", (F.col("event_id") % 2).cast("string").alias("name"), F.col("seq").alias("start_idx")))


@query("spa_12", f'WITH {LEGS}, {_WAYS}, {_SNAP}, {_RUNS}, {_TOUCH} SELECT activity_id, name, "start", a, b, a AND b AS "both" FROM tch')
def spa_12(spark, d):
    return _touched(spark, d)


@query("spa_10", f"WITH {TRK}, q AS (SELECT activity_id - 1 AS line_id, seq AS id, lat + CAST(0.0000137 AS DOUBLE) AS lat, lon + CAST(0.0000271 AS DOUBLE) AS lon FROM trk), p AS (SELECT q.line_id, q.id, v.seq AS i, {hav('q.lat', 'q.lon', 'v.lat', 'v.lon', True)} AS d FROM q JOIN trk v ON v.activity_id = q.line_id) SELECT line_id, id, arg_min(i, (round(d, 6), i)) AS i, round(MIN(d), 4) AS d FROM p GROUP BY 1, 2")
def spa_10(spark, d):
    """Each track's points, moved a little off the grid, against the vertices of the track before it."""
    p = track_points(spark, d)
    v = p.select(F.col("activity_id").alias("line_id"), F.col("seq").alias("i"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    q = p.select((F.col("activity_id") - 1).alias("line_id"), F.col("seq").alias("id"), (F.col("lat") + 0.0000137).alias("lat"), (F.col("lon") + 0.0000271).alias("lon"))
    return network.nearest_vertex(q, v).select("line_id", "id", "i", rnd("d", 4).alias("d"))


@query("spa_04", f"WITH {TRK}, {_INSIDE} SELECT DISTINCT activity_id AS line_id, region_id FROM inside")
def spa_04(spark, d):
    p = track_points(spark, d)
    inside = spatial.points_in_regions(p, spatial.ring_edges(_regions(spark)))
    return network.ways_in_region(p.select(F.col("activity_id").alias("line_id"), F.col("seq").alias("i")), inside)


@query("spa_09", f"WITH {TRK}, {_WAYS} SELECT activity_id, seq, round(MIN({_planar('lat', 'lon')}), 4) AS d FROM trk, way GROUP BY 1, 2 HAVING MIN({_planar('lat', 'lon')}) <= 10")
def spa_09(spark, d):
    near = spatial.near_any_segment(track_points(spark, d).select("activity_id", "seq", "lat", "lon"), _ways(spark, d).select("alat", "alon", "blat", "blon"), 10.0, "activity_id", "seq")
    return near.withColumn("d", rnd("d", 4))


@query("spa_07", f"WITH {_WAYS}, c AS (SELECT way_pos, unnest(generate_series(CAST(floor((least(alat, blat) - CAST(0.0002 AS DOUBLE)) / CAST(0.001 AS DOUBLE)) AS BIGINT), CAST(floor((greatest(alat, blat) + CAST(0.0002 AS DOUBLE)) / CAST(0.001 AS DOUBLE)) AS BIGINT))) AS ci, alon, blon FROM way) SELECT way_pos, ci, unnest(generate_series(CAST(floor((least(alon, blon) - CAST(0.0002 AS DOUBLE)) / CAST(0.001 AS DOUBLE)) AS BIGINT), CAST(floor((greatest(alon, blon) + CAST(0.0002 AS DOUBLE)) / CAST(0.001 AS DOUBLE)) AS BIGINT))) AS cj FROM c")
def spa_07(spark, d):
    return spatial.boxed_cells(_ways(spark, d), 0.001).select("way_pos", "ci", "cj")


# ---------------------------------------------------------------- the rest of the reports


@query("agg_02", f"WITH {LEGS} SELECT activity_id, round(COALESCE(SUM(CASE WHEN NOT assisted AND ele_delta > 0 THEN ele_delta END), 0), 4) AS gain, round(COALESCE(SUM(CASE WHEN NOT assisted AND ele_delta < 0 THEN -ele_delta END), 0), 4) AS loss FROM legs GROUP BY 1")
def agg_02(spark, d):
    p = legs(spark, d)
    on = lambda c, v: F.round(F.coalesce(F.sum(F.when(~F.col("assisted") & c, v)), F.lit(0.0)), 4)
    return p.groupBy("activity_id").agg(on(F.col("ele_delta") > 0, F.col("ele_delta")).alias("gain"), on(F.col("ele_delta") < 0, -F.col("ele_delta")).alias("loss"))


@query("fit_02", f"WITH {ACT}, {_RIDES}, wk AS (SELECT CAST(unnest(generate_series(DATE '2001-01-07', DATE '2001-07-29', INTERVAL 7 DAY)) AS DATE) AS week_end) SELECT week_end, round(SUM(hr_load * z2) / nullif(SUM(z2), 0), 4) AS weighted FROM wk JOIN rides ON d BETWEEN week_end - 28 AND week_end GROUP BY 1")
def fit_02(spark, d):
    ends = F.expr("sequence(DATE '2001-01-07', DATE '2001-07-29', interval 7 days)")
    near = F.filter(ends, lambda e: (F.col("d") <= e) & (F.col("d") >= F.date_sub(e, 28)))
    r = _rides(spark, d).where("d BETWEEN DATE '2000-12-10' AND DATE '2001-07-29'").withColumn("z2", F.col("zones")[1]).withColumn("week_end", F.explode(near))
    return r.groupBy("week_end").agg(F.round(F.sum(F.col("hr_load") * F.col("z2")) / F.nullif(F.sum("z2"), F.lit(0.0)), 4).alias("weighted"))


@query("fit_13", f"WITH {TRK}, {_SENSOR} SELECT activity_id, round(15.3 * MAX(bpm) / MIN(bpm), 1) AS vo2max FROM sensor GROUP BY 1")
def fit_13(spark, d):
    return _sensor(spark, d).groupBy("activity_id").agg(F.round(15.3 * F.max("bpm") / F.min("bpm"), 1).alias("vo2max"))


@query("fit_16", f"WITH {ACT}, {_RIDES} SELECT round(100 * SUM(z1) / SUM(z1 + z2 + z3 + z4 + z5), 4) AS p1, round(100 * SUM(z5) / SUM(z1 + z2 + z3 + z4 + z5), 4) AS p5 FROM rides WHERE d > DATE '2001-07-04'")
def fit_16(spark, d):
    r = _rides(spark, d).where("d > DATE '2001-07-04'")
    total = F.sum(F.aggregate("zones", F.lit(0.0), lambda a, x: a + x))
    return r.agg(F.round(100 * F.sum(F.col("zones")[0]) / total, 4).alias("p1"), F.round(100 * F.sum(F.col("zones")[4]) / total, 4).alias("p5"))


@query("win_06", f"WITH {ACT}, {_DAYS}, {_FF}, w AS (SELECT CAST(unnest(generate_series(DATE '2001-01-07', DATE '2001-09-02', INTERVAL 7 DAY)) AS DATE) AS d) SELECT w.d, round(fitness, 4) AS fitness FROM w ASOF LEFT JOIN ff ON ff.d <= w.d")
def win_06(spark, d):
    ends = spark.range(1).select(F.explode(F.expr("sequence(DATE '2001-01-07', DATE '2001-09-02', interval 7 days)")).alias("d"))
    f = reports.ewma(_days(spark, d), 42.0, "fitness").select("d", rnd("fitness", 4).alias("fitness"))
    return asof.asof_backward(ends, f, "d", "fitness")


@query("win_07", f"WITH {ACT}, {_DAYS} SELECT d, round(v, 6) AS v FROM days ORDER BY t DESC LIMIT 84")
def win_07(spark, d):
    r = _days(spark, d).withColumn("r", F.row_number().over(Window.orderBy(F.desc("t"))))
    return r.where("r <= 84").select("d", rnd("v", 6).alias("v"))


@query("flt_04", f"WITH {ACT} SELECT type, COUNT(*) AS n FROM act WHERE NOT assisted GROUP BY 1")
def flt_04(spark, d):
    return reports.log_query(activities(spark, d), assisted=False).groupBy("type").agg(F.count("*").alias("n"))


@query("flt_06", f"WITH {ACT} SELECT activity_id FROM act WHERE gain IS NULL OR type = ''")
def flt_06(spark, d):
    return activities(spark, d).where("gain IS NULL OR type = ''").select("activity_id")


@query("flt_10", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def flt_10(spark, d):
    hidden = read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part").where(F.lower("p_name").contains("red")).select("p_partkey", "p_name").join(hidden, "p_partkey", "left_anti")


@query("top_05", f"WITH {_ATT}, g AS (SELECT name, direction, COUNT(*) AS attempts, MIN(duration) AS best FROM att WHERE completed GROUP BY 1, 2) SELECT *, ROW_NUMBER() OVER (ORDER BY best, attempts DESC, name, direction) AS place FROM g")
def top_05(spark, d):
    g = spatial.trail_index(_attempts(spark, d), ["name", "direction"]).select("name", "direction", "attempts", "best")
    return numbered(g, "place", F.col("best"), F.desc("attempts"), F.col("name"), F.col("direction"))


@query("top_08", f"WITH {_ATT}, g AS (SELECT type, name, COUNT(*) AS attempts FROM att WHERE completed GROUP BY 1, 2) SELECT *, ROW_NUMBER() OVER (PARTITION BY type ORDER BY attempts DESC, name) AS place, SUM(attempts) OVER (PARTITION BY type) AS total FROM g")
def top_08(spark, d):
    g = spatial.trail_index(_attempts(spark, d), ["type", "name"]).select("type", "name", "attempts")
    w = Window.partitionBy("type")
    return g.withColumns({"place": F.row_number().over(w.orderBy(F.desc("attempts"), "name")).cast("long"), "total": F.sum("attempts").over(w)})


@query("sim_07", f"WITH {TRK}, {_CELLS}, {_PAIR} SELECT activity_id FROM sz WHERE activity_id NOT IN (SELECT b FROM score WHERE containment >= 0.55)")
def sim_07(spark, d):
    c = _cells(spark, d)
    covered = similarity.similar_pairs(c, 0.55, "containment").select(F.col("b").alias("activity_id"))
    return c.select("activity_id").distinct().join(covered, "activity_id", "left_anti")


@query("edt_05", f"WITH {JLEGS}, {_SPIKES}, {_REPAIR} SELECT activity_id, seq, spike AS changed, round(km0, 6) AS raw_km, round(km1, 6) AS repaired_km, round(speed0, 4) AS raw_speed, round(speed1, 4) AS repaired_speed FROM fixed")
def edt_05(spark, d):
    """Tracks before and after repair, point by point."""
    raw = T.spikes(legs(spark, d, True))
    after = T.repaired(raw, 4).select("activity_id", "seq", rnd("dist_km").alias("repaired_km"), rnd("speed", 4).alias("repaired_speed"))
    return raw.select("activity_id", "seq", F.col("spike").alias("changed"), rnd("dist_km").alias("raw_km"), rnd("speed", 4).alias("raw_speed")).join(after, ["activity_id", "seq"])


# ---------------------------------------------------------------- lifts

_LIFTS = "lift AS (SELECT s_suppkey AS lift, alat, alon, blat, blon FROM (SELECT s_suppkey, CAST(49.995 AS DOUBLE) + CAST(0.0002 AS DOUBLE) * (s_suppkey * 37 % 60) AS alat, CAST(-116.0 AS DOUBLE) + CAST(0.0002 AS DOUBLE) * (s_suppkey * 53 % 90) AS alon, CAST(49.995 AS DOUBLE) + CAST(0.0002 AS DOUBLE) * (s_suppkey * 71 % 60) AS blat, CAST(-116.0 AS DOUBLE) + CAST(0.0002 AS DOUBLE) * (s_suppkey * 89 % 90) AS blon FROM supplier))"


def _lifts(spark, d):
    k = F.col("s_suppkey")
    at = lambda base, m, n: (base + 0.0002 * (k * m % n))
    return read(spark, d, "supplier").select(k.alias("lift"), at(49.995, 37, 60).alias("alat"), at(-116.0, 53, 90).alias("alon"), at(49.995, 71, 60).alias("blat"), at(-116.0, 89, 90).alias("blon"))


#: The greedy order of rides: from each candidate to the first that begins after its end.
_STATIONS = f"""up AS (SELECT activity_id, seq, t_s, lat, lon, SUM(ele_delta) OVER (PARTITION BY activity_id ORDER BY seq) AS up FROM legs),
n AS (SELECT activity_id, seq, t_s, up, lift, 'a' AS stop FROM up, lift WHERE {hav('lat', 'lon', 'alat', 'alon', True)} <= 100 UNION ALL SELECT activity_id, seq, t_s, up, lift, 'b' FROM up, lift WHERE {hav('lat', 'lon', 'blat', 'blon', True)} <= 100),
f AS (SELECT l.activity_id, l.lift, l.stop, l.seq AS s0, l.t_s AS t0, l.up AS u0, MIN(h.seq) AS s1 FROM n l JOIN n h ON h.activity_id = l.activity_id AND h.lift = l.lift AND h.stop <> l.stop AND h.seq > l.seq AND h.t_s >= l.t_s + 30 GROUP BY ALL),
c AS (SELECT f.*, up.up - u0 AS gain FROM f JOIN up ON up.activity_id = f.activity_id AND up.seq = s1 WHERE up.t_s - t0 <= 1800),
x AS (SELECT c.*, (SELECT MIN(d.s0) FROM c d WHERE d.activity_id = c.activity_id AND d.lift = c.lift AND d.stop = c.stop AND d.s0 > c.s1) AS after, s0 = MIN(s0) OVER (PARTITION BY activity_id, lift, stop) AS first FROM c),
r AS (SELECT activity_id, lift, stop, s0, s1, gain, after FROM x WHERE first UNION ALL SELECT x.activity_id, x.lift, x.stop, x.s0, x.s1, x.gain, x.after FROM r JOIN x ON x.activity_id = r.activity_id AND x.lift = r.lift AND x.stop = r.stop AND x.s0 = r.after)"""


@query("det_07", f"WITH RECURSIVE {LEGS}, {_LIFTS}, {_STATIONS} SELECT activity_id, lift, s0 AS \"start\", s1 AS \"end\" FROM r WHERE gain >= 5")
def det_07(spark, d):
    """Rides between stations, one after the other; shorter and lower ones than the default count, for these tracks are short and flat."""
    return lifts.station_rides(legs(spark, d), _lifts(spark, d), least_s=30, gain=5.0)


_SPANS = "spans AS (SELECT activity_id, CAST(10 AS BIGINT) AS \"start\", MAX(seq) - 5 AS \"end\" FROM legs GROUP BY 1)"


def _spans(p):
    return p.groupBy("activity_id").agg(F.lit(10).cast("long").alias("start"), (F.max("seq") - 5).alias("end"))


@query("det_09", f"WITH {LEGS}, {_SPANS}, k AS (SELECT *, least(45, (\"end\" - \"start\") // 4) AS reach FROM spans) SELECT k.activity_id, COALESCE(MIN(seq) FILTER (WHERE seq < \"start\" + reach AND seq >= \"start\"), \"start\") AS \"from\", COALESCE(MAX(seq) FILTER (WHERE seq > \"end\" - reach AND seq <= \"end\"), \"end\") AS \"to\" FROM k LEFT JOIN legs l ON l.activity_id = k.activity_id AND speed >= 6 GROUP BY k.activity_id, \"start\", \"end\"")
def det_09(spark, d):
    p = legs(spark, d)
    return lifts.trimmed_to_cable_speed(p, _spans(p)).select("activity_id", "from", "to")


@query("det_10", f"WITH {LEGS}, {_SPANS}, j AS (SELECT s.activity_id, \"start\", \"end\", seq, COALESCE(speed, 0.0) AS speed FROM spans s JOIN legs l ON l.activity_id = s.activity_id AND seq BETWEEN \"start\" AND \"end\") SELECT activity_id, arg_min(seq, (speed, seq)) FILTER (WHERE seq <= least(\"start\" + 30, \"end\")) AS \"from\", arg_min(seq, (speed, seq)) FILTER (WHERE seq >= greatest(\"end\" - 30, \"start\")) AS \"to\" FROM j GROUP BY 1")
def det_10(spark, d):
    p = legs(spark, d)
    return lifts.trimmed_to_slowest(p, _spans(p)).select("activity_id", "from", "to")


@query("det_08")
def det_08(spark, d):
    p = track_points(spark, d)
    return lifts.snapped_spans(p, _spans(p), _lifts(spark, d))


def _one_detector(name):
    def run(spark, d):
        from ..operators.kernels import detect

        return detect(legs(spark, d), [name]).where(name).select("activity_id", "seq")

    return run


for _id, _name in (("det_02", "speed_sinuosity"), ("det_04", "elevation_rate"), ("det_05", "elevation_rate_high"), ("det_06", "shuttle"), ("det_11", "heuristic")):
    query(_id)(_one_detector(_name))


def _detector_with_lifts(name):
    def run(spark, d):
        return lifts.detected(legs(spark, d), _lifts(spark, d), [name]).select("activity_id", "seq")

    return run


for _id, _name in (("det_12", "osm"), ("det_13", "speed_osm"), ("det_14", "smart"), ("det_15", "lift"), ("det_16", "bike")):
    query(_id)(_detector_with_lifts(_name))


from . import additions  # noqa: E402, F401  (its queries register themselves)
