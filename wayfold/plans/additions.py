"""Queries of the smaller operators, each beside its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lookups
from ..functions.order import numbered
from ..operators import asof, network, overview, reports, routes, similarity, spatial
from ..operators import tracks as T
from . import catalog as C
from .bindings import ACT, AS_OF, LEGS, TRK, activities, legs, read, track_points
from .catalog import query, rnd

# ---------------------------------------------------------------- stored results, lookups, digests


@query("gl_01", f"WITH {ACT} SELECT activity_id FROM act WHERE n % 3 = 1 AND gain IS NOT NULL")
def gl_01(spark, d):
    stored = activities(spark, d).select("activity_id", (F.col("n") % 3).alias("version"), F.col("gain").alias("timeline"))
    return overview.current_results(stored, 1).select("activity_id")


@query("gl_09", f"WITH {ACT} SELECT activity_id, d, type, place, round(km, 6) AS km, assisted FROM act")
def gl_09(spark, d):
    return activities(spark, d).select("activity_id", "d", "type", "place", rnd("km").alias("km"), "assisted")


@query("gl_10", f"WITH {TRK}, p AS (SELECT *, COUNT(*) OVER () AS n FROM trk WHERE activity_id = 7) SELECT seq, round(lat, 5) AS lat, round(lon, 5) AS lon FROM p WHERE seq % greatest(1, n // 20) = 0 OR seq = n - 1")
def gl_10(spark, d):
    return T.decimated(track_points(spark, d).where("activity_id = 7"), 20).select("seq", "lat", "lon")


@query("gl_04", f"WITH {TRK}, p AS (SELECT *, COUNT(*) OVER (PARTITION BY activity_id) AS n FROM trk), t AS (SELECT * FROM p WHERE n <= 20 OR seq = n - 1 OR seq IN (SELECT CAST(floor(i * n / 20.0) AS BIGINT) FROM range(20) r(i))) SELECT activity_id AS id, MIN(lat) AS min_lat, MIN(lon) AS min_lon, MAX(lat) AS max_lat, MAX(lon) AS max_lon FROM t GROUP BY 1")
def gl_04(spark, d):
    t = T.thumbnails(track_points(spark, d), 20)
    lines = t.groupBy(F.col("activity_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("line"))
    return overview.line_boxes(lines)


@query("gl_18", "SELECT n_nationkey AS region_id, CAST(49 + n_nationkey * 0.1 AS DOUBLE) AS min_lat, CAST(-117 + n_regionkey * 0.5 AS DOUBLE) AS min_lon, CAST(50 + n_nationkey * 0.1 AS DOUBLE) AS max_lat, CAST(-116.75 + n_regionkey * 0.5 AS DOUBLE) AS max_lon FROM nation")
def gl_18(spark, d):
    """Outer rings of nations, each a triangle with a hole, placed by its keys; the boxes of those rings."""
    lat, lon = 49 + F.col("n_nationkey") * 0.1, -117 + F.col("n_regionkey") * 0.5
    at = lambda a, b: F.array(lon + b, lat + a)
    outer, hole = F.array(at(0.0, 0.0), at(1.0, 0.0), at(0.5, 0.25), at(0.0, 0.0)), F.array(at(-9.0, 0.1), at(0.3, 0.1), at(0.2, 9.0), at(0.2, 0.1))
    r = read(spark, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.array(outer, hole).alias("coordinates"))
    found = overview.outer_rings(r)
    return found.select("region_id", *(rnd(c).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")))


@query("src_14", f"WITH {TRK}, place AS (SELECT CAST(k / 10.0 AS DOUBLE) AS la, -116.0 AS lo, 'P' || CAST(k AS VARCHAR) AS place FROM range(498, 503) r(k)) SELECT activity_id, seq, place FROM trk LEFT JOIN place ON round(lat, 1) = la AND round(lon, 1) = lo")
def src_14(spark, d):
    places = spark.range(498, 503).select((F.col("id") / 10).alias("lat1"), F.lit(-116.0).alias("lon1"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("place"))
    return overview.geocoded(track_points(spark, d), places).select("activity_id", "seq", "place")


@query("flt_08", "SELECT p_partkey AS id, p_size AS first_ring FROM part WHERE p_partkey % 4 IN (0, 1) AND p_size % 5 <> 2")
def flt_08(spark, d):
    """Parts stand for results of a region search: kinds and classes by their numbers."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 4 == 0, "Polygon").when(k % 4 == 1, "MultiPolygon").when(k % 4 == 2, "Point")
    found = read(spark, d, "part").select(k.alias("id"), kind.alias("kind"), F.concat(F.lit("c"), (size % 5).cast("string")).alias("class"), F.array(F.array(size), F.array(size + 1)).alias("polygons"))
    return overview.region_results(found, ["c2"]).select("id", F.col("ring").alias("first_ring"))


@query("gl_19", f"WITH {ACT} SELECT activity_id, md5(concat_ws(chr(31), CAST(activity_id AS VARCHAR), COALESCE(CASE WHEN n % 4 > 0 THEN type END, chr(0)), CAST(n AS VARCHAR))) AS fingerprint FROM act")
def gl_19(spark, d):
    kind = F.when(F.col("n") % 4 > 0, F.col("type"))
    return activities(spark, d).select("activity_id", overview.digest([F.col("activity_id"), kind, F.col("n")]).alias("fingerprint"))


@query("gl_19_table", f"WITH {ACT} SELECT COUNT(*) AS n, md5(CAST(SUM(CAST(('0x' || substr(md5(concat_ws(chr(31), CAST(activity_id AS VARCHAR), type)), 1, 15)) AS HUGEINT)) AS VARCHAR)) AS fingerprint FROM act")
def gl_19_table(spark, d):
    return overview.table_digest(activities(spark, d), "activity_id", ["type"])


def _md5(*parts):
    """SQL of ``overview.digest``."""
    return f"md5(concat_ws(chr(31), {', '.join(f'COALESCE(CAST({p} AS VARCHAR), chr(0))' for p in parts)}))"


@query("gl_19_keys", f"""WITH {ACT}, rt AS (SELECT o_orderkey AS route_id, o_custkey % 30 AS region_id, '2001-01-01' AS created, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS modified, o_custkey AS time FROM orders),
ms AS (SELECT CAST(COUNT(*) AS VARCHAR) || ':' || CAST(MAX(n) AS VARCHAR) AS state FROM act), ss AS (SELECT CAST(COUNT(*) AS VARCHAR) || ':' || CAST(MAX(time) AS VARCHAR) AS saved FROM rt)
SELECT 'edits' AS kind, activity_id AS id, substr({_md5("CASE WHEN n % 3 = 0 THEN n END", "CASE WHEN n % 4 = 0 THEN 5 END", "CASE WHEN n % 5 = 0 THEN 2 END", "n % 2 = 0")}, 1, 12) AS fingerprint FROM act
UNION ALL SELECT 'entry', activity_id, substr({_md5("n", "7", "9", "type", "CASE WHEN n % 3 = 0 THEN n END", "'osm'", "3", "12", "190", "CASE WHEN n % 2 = 0 THEN 50 END")}, 1, 16) FROM act
UNION ALL SELECT 'regions', 0, md5(CAST(SUM(CAST(('0x' || substr({_md5("n_nationkey", "n_regionkey")}, 1, 15)) AS HUGEINT)) AS VARCHAR)) FROM nation
UNION ALL SELECT 'route', route_id, {_md5("2", "5", "COALESCE(modified, created)", "state", "11", "COALESCE(n_regionkey, -1)")} FROM rt CROSS JOIN ms LEFT JOIN nation ON n_nationkey = region_id
UNION ALL SELECT 'suggestions', 0, {_md5("4", "5", "state", "saved", "11", "13")} FROM ms, ss""")
def gl_19_keys(spark, d):
    """Keys of stored results: a track's edits, its entry, regions' geometry, attempts at a route, suggestions.  Nations stand for regions, orders for saved routes."""
    a, i = activities(spark, d), F.col("n")
    edits = [F.when(i % 3 == 0, i), F.when(i % 4 == 0, F.lit(5)), F.when(i % 5 == 0, F.lit(2)), i % 2 == 0]
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.cast("long").alias("id"), "fingerprint")
    one = row(a.withColumn("fingerprint", overview.edit_key(*edits)), "edits", F.col("activity_id"))
    entry = overview.entry_key([i, F.lit(7), F.lit(9)], [F.col("type"), edits[0]], F.lit("osm"), [F.lit(3), F.lit(12)], [F.lit(190), F.when(i % 2 == 0, F.lit(50))])
    two = row(a.withColumn("fingerprint", entry), "entry", F.col("activity_id"))
    nations = read(spark, d, "nation")
    three = row(overview.table_digest(nations, "n_nationkey", ["n_regionkey"]), "regions", F.lit(0))
    k = F.col("o_orderkey")
    saved = read(spark, d, "orders").select(k.alias("route_id"), (F.col("o_custkey") % 30).alias("region_id"), F.lit("2001-01-01").alias("created"), F.when(k % 2 == 0, F.col("o_orderdate").cast("date").cast("string")).alias("modified"), F.col("o_custkey").alias("time"))
    matched = overview.table_state(a, "n")
    keys = overview.route_keys(saved, nations.select(F.col("n_nationkey").alias("region_id"), F.col("n_regionkey").alias("time")), matched, 11, [2, 5])
    four = row(keys, "route", F.col("route_id"))
    five = row(overview.suggestion_key(matched, overview.table_state(saved, "time"), [11, 13], [4, 5]), "suggestions", F.lit(0))
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)


@query("agg_03", f"WITH {ACT} SELECT activity_id, CASE WHEN activity_id % 3 = 0 THEN round(km / 2, 12) ELSE round(km, 12) END AS km, round(hours, 12) AS hours, CASE WHEN activity_id % 3 = 0 THEN n END AS lifts FROM act")
def agg_03(spark, d):
    a = activities(spark, d)
    new = a.where("activity_id % 3 = 0").select("activity_id", (F.col("km") / 2).alias("km"), F.col("n").alias("lifts"))
    m = overview.merged_statistics(a.select("activity_id", "km", "hours"), new)
    return m.select("activity_id", rnd("km", 12).alias("km"), rnd("hours", 12).alias("hours"), "lifts")


# ---------------------------------------------------------------- sensors, weather, dates


_HOURS = "h AS (SELECT k * 3600 AS t, CAST(k * 7 % 31 AS DOUBLE) AS temp, CAST(k % 5 AS DOUBLE) AS rain, CAST(k % 3 AS DOUBLE) AS snow, CAST(k * 11 % 47 AS DOUBLE) AS wind, k * 13 % 4 AS code FROM (SELECT unnest(range(CAST(MAX(end_s) // 3600 + 2 AS BIGINT))) AS k FROM sp))"
_WEATHER = "j AS (SELECT * FROM sp JOIN h ON t + 3600 > start_s AND t < end_s), c AS (SELECT activity_id, code, ROW_NUMBER() OVER (PARTITION BY activity_id ORDER BY COUNT(*) DESC, MIN(t)) AS r FROM j GROUP BY 1, 2) SELECT j.activity_id, MIN(temp) AS temp_min, MAX(temp) AS temp_max, SUM(rain) AS rain, SUM(snow) AS snow, MAX(wind) AS wind, any_value(c.code) AS code FROM j JOIN c ON c.activity_id = j.activity_id AND r = 1 GROUP BY 1"


def _hours(spark, spans):
    """As many hours of weather as the spans reach over."""
    k, last = F.col("k"), spans.agg(F.max("end_s").alias("last"))
    h = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.coalesce("last", F.lit(0)) / 3600) + 1)).alias("k"))
    return h.select((k * 3600).alias("t"), (k * 7 % 31).cast("double").alias("temp"), (k % 5).cast("double").alias("rain"), (k % 3).cast("double").alias("snow"), (k * 11 % 47).cast("double").alias("wind"), (k * 13 % 4).alias("code"))


@query("jn_10", f"WITH {TRK}, sp AS (SELECT activity_id, MIN(t_s) + activity_id * 1000 AS start_s, MAX(t_s) + activity_id * 1000 AS end_s FROM trk GROUP BY 1), {_HOURS}, {_WEATHER}")
def jn_10(spark, d):
    sp = track_points(spark, d).groupBy("activity_id").agg((F.min("t_s") + F.col("activity_id") * 1000).alias("start_s"), (F.max("t_s") + F.col("activity_id") * 1000).alias("end_s"))
    return asof.weather_overlap(sp, _hours(spark, sp))


@query("gl_11", f"WITH {TRK}, sp AS (SELECT activity_id, MIN(t_s) AS start_s, CASE WHEN MAX(t_s) > MIN(t_s) THEN MAX(t_s) ELSE MIN(t_s) + 3600 END AS end_s FROM trk GROUP BY 1 HAVING round(AVG(lat), 1) = 50.0 AND round(AVG(lon), 1) = -116.0), {_HOURS}, {_WEATHER}")
def gl_11(spark, d):
    """Weather of each track at its mean place; one station has data."""
    p = track_points(spark, d)
    h = _hours(spark, p.agg(F.max("t_s").alias("end_s"))).withColumns({"place_lat": F.lit(50.0), "place_lon": F.lit(-116.0)})
    return overview.activity_weather(p, h)


@query("gl_12", f"WITH {TRK}, s AS (SELECT CAST(ts AS DATE) AS d, event_id AS t, CASE WHEN event_id % 7 > 0 THEN 90 + event_id % 97 END AS bpm FROM trk), k AS (SELECT *, COUNT(*) OVER (PARTITION BY d) AS n, ROW_NUMBER() OVER (PARTITION BY d ORDER BY bpm, t) AS p FROM s WHERE bpm IS NOT NULL) SELECT d, t, bpm, MIN(bpm) OVER w AS day_min, MAX(bpm) OVER w AS day_max, MAX(CASE WHEN p = floor(ceil(n / 10.0) / 2) + 1 THEN bpm END) OVER w AS resting FROM k WINDOW w AS (PARTITION BY d)")
def gl_12(spark, d):
    s = track_points(spark, d).select(F.to_date("ts").alias("d"), F.col("event_id").alias("t"), F.when(F.col("event_id") % 7 > 0, 90 + F.col("event_id") % 97).alias("bpm"))
    return overview.sensor_day(s)


@query("gl_14", "WITH have AS (SELECT CAST(ts AS DATE) AS d, bool_or(event_type = 'purchase' AND event_id % 3 = 0) AS complete FROM events GROUP BY 1), sp AS (SELECT CAST(unnest(generate_series(DATE '2024-02-11' - 40, DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS d) SELECT d FROM (SELECT d FROM sp WHERE d NOT IN (SELECT d FROM have WHERE complete) UNION SELECT d FROM sp WHERE d >= DATE '2024-02-08') ORDER BY d DESC LIMIT 20")
def gl_14(spark, d):
    have = read(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)).alias("complete"))
    return overview.dates_to_fetch(have, "2024-02-11", 40, 3, 20)


@query("gl_15", "SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_id % 977 = 0)")
def gl_15(spark, d):
    e = read(spark, d, "events").withColumn("d", F.to_date("ts"))
    return overview.missing_days(e, e.where("event_id % 977 = 0"))


@query("jn_06", f"WITH {ACT}, x AS (SELECT d, activity_id * 100 % 70000 AS first, activity_id * 100 % 70000 + 3000 AS last, CASE WHEN n > 1 THEN activity_id * 100 % 70000 + n * 90 - 200 END AS lo, activity_id * 100 % 70000 + 2500 + n * 100 AS hi, CASE WHEN n % 2 = 0 THEN d + CAST(n AS INTEGER) END AS fetched FROM act) SELECT d FROM x WHERE d <= DATE '2001-08-01' GROUP BY 1 HAVING bool_or((lo IS NULL OR lo > first + 300 OR hi < last - 300) AND NOT COALESCE(date_diff('day', d, CAST(fetched AS DATE)) >= 7, false))")
def jn_06(spark, d):
    """Days whose sensor file is short of an activity; those fetched a week later or more are trusted."""
    first = F.col("activity_id") * 100 % 70000
    n = F.col("n")
    x = activities(spark, d).select("d", first.alias("first"), (first + 3000).alias("last"), F.when(n > 1, first + n * 90 - 200).alias("lo"), (first + 2500 + n * 100).alias("hi"), F.when(n % 2 == 0, F.date_add("d", n.cast("int"))).alias("fetched"))
    return overview.incomplete_days(x, AS_OF)


@query("jn_08", f"WITH {TRK}, {C._SENSOR}, w AS (SELECT activity_id, list_sort(list(bpm - 40)) AS l FROM sensor WHERE t % 3 = 0 GROUP BY 1) SELECT s.activity_id, COALESCE(CASE WHEN s.activity_id % 4 = 0 THEN 185.0 END, MAX(bpm), 190.0) AS max_hr, COALESCE(CASE WHEN s.activity_id % 5 = 0 THEN 52.0 END, any_value(l[len(l) // 2 + 1]), 60.0) AS resting FROM sensor s LEFT JOIN w ON w.activity_id = s.activity_id GROUP BY 1")
def jn_08(spark, d):
    """Effective greatest and resting rates: what was set, else what was seen, else a default."""
    s, i = C._sensor(spark, d), F.col("activity_id")
    g = s.groupBy("activity_id").agg(F.max("bpm").alias("m"), C.stats.median_upper(F.collect_list(F.when(F.col("t") % 3 == 0, F.col("bpm") - 40))).alias("r"))
    return g.select("activity_id", asof.effective(F.when(i % 4 == 0, 185.0), F.col("m"), 190.0).alias("max_hr"), asof.effective(F.when(i % 5 == 0, 52.0), F.col("r"), 60.0).alias("resting"))


@query("jn_12_preferred", "SELECT event_id AS id FROM events b WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND abs(date_diff('second', a.ts, b.ts)) <= 600)")
def jn_12_preferred(spark, d):
    """Signups without a purchase within ten minutes, which would be preferred."""
    e = read(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id"))
    return asof.preferred(C.jn_12(spark, d), e)


@query("fit_14", f"WITH {TRK}, x AS (SELECT activity_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 6 > 0 THEN 45 + event_id % 23 END AS rhr FROM trk), l AS (SELECT activity_id, list_sort(list(rhr) FILTER (WHERE rhr IS NOT NULL)) AS l FROM x WHERE d > DATE '2024-01-20' - 30 AND d <= DATE '2024-01-20' GROUP BY 1) SELECT activity_id, l[len(l) // 2 + 1] AS baseline FROM l")
def fit_14(spark, d):
    """Resting baseline of each person over the last 30 days."""
    x = track_points(spark, d).select("activity_id", F.to_date("ts").alias("d"), F.when(F.col("event_id") % 6 > 0, 45 + F.col("event_id") % 23).alias("rhr"))
    return reports.resting_baseline(x, "2024-01-20", "activity_id")


# ---------------------------------------------------------------- duplicates, clusters, suggestions


_GROUPS = f"""e AS (SELECT a, b FROM dup UNION SELECT b, a FROM dup), reach AS (SELECT a AS v, a AS c FROM e UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v), cc AS (SELECT v, MIN(c) AS c FROM reach GROUP BY 1),
gr AS (SELECT cc.c, string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) AS members, COUNT(*) AS n, MAX(d) AS d FROM cc JOIN dact ON dact.activity_id = v GROUP BY 1 HAVING COUNT(*) >= 2)"""


def _group_report(spark, d):
    groups = similarity.duplicate_groups(C._dups(spark, d))
    dates = track_points(spark, d).select("activity_id").distinct().withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("activity_id") % 4).cast("int")))
    dismissed = overview.group_report(groups, dates, spark.createDataFrame([], "signature string")).where("c % 3 = 0").select("signature")
    return overview.group_report(groups, dates, dismissed)


@query("sim_02", f"WITH RECURSIVE {TRK}, {C._CELLS}, {C._PAIR}, {C._DUP}, {_GROUPS} SELECT c, members, CAST(d AS DATE) AS d FROM gr WHERE c % 3 > 0")
def sim_02(spark, d):
    """Duplicate groups; those whose first member is divisible by 3 stand for dismissed ones."""
    return _group_report(spark, d).select("c", F.array_join(F.col("members").cast("array<string>"), "|").alias("members"), "d")


@query("gl_13", f"WITH RECURSIVE {TRK}, {C._CELLS}, {C._PAIR}, {C._DUP}, {_GROUPS} SELECT COUNT(*) AS groups, CAST(SUM(n) AS BIGINT) AS tracks, CAST(SUM(n - 1) AS BIGINT) AS redundant FROM gr WHERE c % 3 > 0")
def gl_13(spark, d):
    n = F.size("members")
    return _group_report(spark, d).agg(F.count("*").alias("groups"), F.sum(n).alias("tracks"), F.sum(n - 1).alias("redundant"))


@query("sim_05")
def sim_05(spark, d):
    """Complete-linkage clusters of tracks by their cells."""
    s = similarity.similar_pairs(C._cells(spark, d), 0.15).select("a", "b", F.col("jaccard").alias("score"))
    return overview.clusters_of_rides(s, track_points(spark, d).select(F.col("activity_id").alias("v")).distinct(), 0.15)


@query("sim_08", f"WITH {TRK}, m AS (SELECT DISTINCT activity_id, activity_id % 40 AS cluster, activity_id % 3 AS region_id FROM trk), g AS (SELECT cluster, region_id, MIN(activity_id) AS representative, COUNT(*) AS rides, substr(md5(concat_ws('|', CAST(region_id AS VARCHAR), string_agg(CAST(activity_id AS VARCHAR), '|' ORDER BY activity_id))), 1, 12) AS suggestion_id FROM m GROUP BY 1, 2 HAVING COUNT(*) >= 2), s AS (SELECT *, 'T' || CAST(representative % 7 AS VARCHAR) AS title FROM g WHERE cluster % 9 > 0) SELECT suggestion_id, cluster, region_id, representative, rides, title, ROW_NUMBER() OVER (ORDER BY rides DESC, title, suggestion_id) AS place FROM s")
def sim_08(spark, d):
    """Suggestions from made-up clusters; every ninth is dismissed."""
    m = track_points(spark, d).select("activity_id", (F.col("activity_id") % 40).alias("cluster"), (F.col("activity_id") % 3).alias("region_id")).distinct()
    m = m.withColumn("representative", F.min("activity_id").over(Window.partitionBy("cluster", "region_id")))
    titles = m.select("activity_id", F.concat(F.lit("T"), (F.col("activity_id") % 7).cast("string")).alias("title"))
    gone = overview.suggestions(m, titles, spark.createDataFrame([], "suggestion_id string")).where("cluster % 9 = 0").select("suggestion_id")
    s = overview.suggestions(m, titles, gone)
    s = s.select("suggestion_id", "cluster", "region_id", "representative", F.col("rides").cast("long").alias("rides"), "title")
    return numbered(s, "place", F.desc("rides"), F.col("title"), F.col("suggestion_id"))


@query("gl_03", f"WITH {C._WAYS}, {C._VERTICES}, s AS (SELECT DISTINCT way_pos % 11 AS route_id, way_pos AS chain FROM way) SELECT DISTINCT route_id, CAST(floor(lat * {C._M} / 60) AS BIGINT) AS cn, CAST(floor(lon * {C._M} * cos(radians(CAST(50.7 AS DOUBLE))) / 60) AS BIGINT) AS ce FROM s JOIN vert v ON v.chain = s.chain")
def gl_03(spark, d):
    """Cells of saved routes, which ways make up here."""
    v = C._vertices(spark, d).select(F.col("chain").alias("edge_id"), "lat", "lon")
    s = v.select((F.col("edge_id") % 11).alias("route_id"), "edge_id").distinct()
    return overview.route_cells(s, v, 60.0, 50.7)


@query("gl_08", f"WITH {C._TRY} SELECT activity_id, duration, ROW_NUMBER() OVER (ORDER BY duration, activity_id) AS place FROM tries WHERE route_id = 70")
def gl_08(spark, d):
    t = C._tries(spark, d).where("route_id = 70")
    return numbered(t.select("activity_id", "duration"), "place", F.col("duration"), F.col("activity_id"))


@query("gl_07", f"WITH {TRK}, {C._LINE}, b AS (SELECT *, LAG(name) OVER (ORDER BY start_idx) AS p FROM tl WHERE activity_id = 7) SELECT CASE WHEN length(array_to_string(l, ' → ')) > 80 THEN array_to_string(l[1:3], ' → ') || ' → +' || CAST(len(l) - 3 AS VARCHAR) || ' more' ELSE array_to_string(l, ' → ') END AS title FROM (SELECT list(name ORDER BY start_idx) AS l FROM b WHERE name IS DISTINCT FROM p)")
def gl_07(spark, d):
    """The proposal for a single ride."""
    return C.rte_09(spark, d).where("activity_id = 7").select("title")


@query("gl_02")
def gl_02(spark, d):
    """Runs on lines as traversals with their direction: topology, progress or angle, smoothing, splits, folding and direction together; around loops laps with a way."""
    ways = C._ways(spark, d)
    chain = routes.chain_segments(routes.linked_ways(ways, 50.0, -116.0, 150.0), ways)
    points = C._snapped(spark, d).where("name IS NOT NULL").select("activity_id", "name", "seq", "lat", "lon")
    t = routes.ridden(points, ways, chain, C._PROGRESS_M, 150.0, least=3, turn=0.1, window=3)
    p = track_points(spark, d).select("activity_id", "seq", "ele")
    t = t.join(p.toDF("activity_id", "start", "e0"), ["activity_id", "start"]).join(p.toDF("activity_id", "end", "e1"), ["activity_id", "end"])
    n = F.col("end") - F.col("start") + 1
    return t.select("activity_id", "name", "chain", "part", "start", "end", "loop", spatial.direction(F.col("e0"), F.col("e1"), n, F.col("along"), F.col("loop")).alias("direction"))


# ---------------------------------------------------------------- reports in full


@query("cnt_02", f"WITH RECURSIVE {C.JLEGS}, {C._SPIKES}, {C._ISSUES}, {C._CELLS}, {C._PAIR}, {C._DUP}, {_GROUPS}, odd AS (SELECT activity_id FROM trk GROUP BY 1 HAVING hour(MIN(ts) - INTERVAL 7 HOUR) IN (21, 22, 23, 0, 1, 2, 3, 4, 5, 6)), n AS (SELECT (SELECT COUNT(*) FROM gr) AS duplicates, (SELECT COUNT(DISTINCT activity_id) FROM trk WHERE activity_id % 13 = 0) AS untyped, (SELECT COUNT(*) FROM iss WHERE code = 'speed_spike') AS spikes, (SELECT COUNT(*) FROM odd) AS odd_times, (SELECT COUNT(DISTINCT activity_id) FROM iss WHERE code <> 'speed_spike') AS issues) SELECT *, duplicates + untyped + spikes + odd_times + issues AS total FROM n")
def cnt_02(spark, d):
    """What waits for review: numbers of each kind, and in all."""
    from ..operators.quality import odd_starts

    p = track_points(spark, d, True)
    found = C._issues(spark, d)
    has = lambda cond: F.count_if(F.exists("issues", cond))
    i = found.agg(has(lambda x: x["code"] == "speed_spike").alias("spikes"), has(lambda x: x["code"] != "speed_spike").alias("issues"))
    dups = similarity.duplicate_groups(_jumpy_dups(spark, d)).agg(F.count_distinct("c").alias("duplicates"))
    odd = odd_starts(p.groupBy("activity_id").agg(F.min("ts").alias("start")), F.lit("Etc/GMT+7")).agg(F.count("*").alias("odd_times"))
    untyped = p.where("activity_id % 13 = 0").agg(F.count_distinct("activity_id").alias("untyped"))
    one = dups.crossJoin(untyped).crossJoin(i).crossJoin(odd)  # a row each
    return one.withColumn("total", sum((F.col(c) for c in ("duplicates", "untyped", "spikes", "odd_times", "issues")), F.lit(0)))


def _jumpy_dups(spark, d):
    p = track_points(spark, d, True)
    a = p.groupBy("activity_id").agg(F.max("seq").alias("km"), F.max("t_s").alias("duration")).withColumns({"d": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("activity_id") % 4).cast("int")), "has_cells": F.col("activity_id") % 5 > 0})
    return similarity.duplicate_pairs(a, spatial.cell_sets(p, 60.0, 50.7, 3), 0.25)



@query("top_01", f"""WITH {ACT}, a AS (SELECT *, n * 1.5 AS speed, gain * 0.9 AS loss FROM act), m AS (SELECT type, activity_id, d, assisted, unnest(CASE WHEN type = 'MACHINERY' THEN ['Vertical', 'Longest', 'Top speed', 'Duration'] ELSE ['Longest', 'Climbing', 'Descent', 'Top speed', 'Duration'] END) AS metric, km, gain, loss, speed, hours FROM a),
v AS (SELECT *, CASE metric WHEN 'Longest' THEN CASE WHEN NOT assisted THEN km END WHEN 'Duration' THEN CASE WHEN NOT assisted THEN hours END WHEN 'Climbing' THEN gain WHEN 'Top speed' THEN speed ELSE loss END AS value FROM m),
s AS (SELECT 'all' AS span, * FROM v UNION ALL SELECT 'window', * FROM v WHERE d BETWEEN DATE '2001-05-04' AND DATE '2001-08-01')
SELECT span, type, metric, activity_id, d, round(value, 6) AS value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY span, type, metric ORDER BY value DESC, activity_id) AS r FROM s WHERE value IS NOT NULL) WHERE r = 1""")
def top_01(spark, d):
    """Records of each type, of all time and of the window; MACHINERY stands for a snow sport."""
    a = activities(spark, d).withColumns({"speed": F.col("n") * 1.5, "loss": F.col("gain") * 0.9})
    both = reports.record_book(a, ["MACHINERY"]).withColumn("span", F.lit("all")).unionByName(reports.record_book(reports.log_query(a, since="2001-05-04", until=AS_OF), ["MACHINERY"]).withColumn("span", F.lit("window")))
    return both.withColumn("value", rnd("value", 6))


@query("top_02", f"WITH {ACT}, l AS (SELECT activity_id, d, unnest(['distance', 'climb', 'duration', 'max', 'hr']) AS metric, unnest([km, gain, hours, n * 1.5, CASE WHEN n % 3 > 0 THEN 120.0 + n END]) AS value FROM act WHERE d BETWEEN DATE '2001-05-04' AND DATE '2001-08-01') SELECT metric, activity_id, d, round(value, 6) AS value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY value DESC, activity_id) AS r FROM l WHERE value IS NOT NULL) WHERE r = 1")
def top_02(spark, d):
    a = reports.log_query(activities(spark, d), since="2001-05-04", until=AS_OF).withColumn("all", F.lit("all"))
    m = {"distance": "km", "climb": "gain", "duration": "hours", "max": "n * 1.5", "hr": "CASE WHEN n % 3 > 0 THEN 120.0 + n END"}
    return reports.records(a, m, "all").drop("all").withColumn("value", rnd("value", 6))


@query("set_05", f"WITH {TRK}, {C._INSIDE}, m AS (SELECT activity_id, list(DISTINCT region_id ORDER BY region_id) AS m FROM inside GROUP BY 1), p AS (SELECT DISTINCT activity_id, [(activity_id % 8), (activity_id % 3)] AS pins FROM trk) SELECT p.activity_id, array_to_string(list_concat(COALESCE(m, []), list_filter(CASE WHEN activity_id % 8 = activity_id % 3 THEN pins[1:1] ELSE pins END, lambda x: x < 6 AND NOT list_contains(COALESCE(m, []), x))), ',') AS regions FROM p LEFT JOIN m USING (activity_id)")
def set_05(spark, d):
    """Matched regions, then pinned ones that exist and aren't matched, in the order of the pins."""
    p = track_points(spark, d)
    tags = spatial.points_in_regions(p, spatial.ring_edges(C._regions(spark))).groupBy("activity_id").agg(F.array_sort(F.collect_set("region_id")).alias("matched"))
    pins = p.select("activity_id", F.array(F.col("activity_id") % 8, F.col("activity_id") % 3).alias("pinned")).distinct()
    known = C._regions(spark).agg(F.collect_list("region_id").alias("known"))  # one row, of the regions' ids
    return reports.with_pins(pins.join(tags, "activity_id", "left"), known).select("activity_id", F.array_join(F.col("regions").cast("array<string>"), ",").alias("regions"))


_REGIONED = "reg AS (SELECT *, CASE WHEN n % 4 = 0 THEN [] WHEN n % 4 = 1 THEN [CAST(activity_id % 5 AS BIGINT)] ELSE [CAST(activity_id % 5 AS BIGINT), CAST(activity_id % 7 + 1 AS BIGINT)] END AS regions FROM act)"


def _regioned(spark, d):
    i = F.col("activity_id")
    r = F.when(F.col("n") % 4 == 0, F.array().cast("array<bigint>")).when(F.col("n") % 4 == 1, F.array(i % 5)).otherwise(F.array(i % 5, i % 7 + 1))
    return activities(spark, d).withColumn("regions", r)


_REGION_TYPES = "rt AS (SELECT CAST(k AS BIGINT) AS region_id, CASE WHEN k % 3 > 0 THEN 'ride' || CAST(k AS VARCHAR) ELSE '' END AS summer, CASE WHEN k % 2 = 0 THEN 'snow' || CAST(k AS VARCHAR) END AS winter, k % 4 = 1 AS lifts FROM range(8) r(k))"


def _region_types(spark):
    k = F.col("id")
    return spark.range(8).select(k.alias("region_id"), F.when(k % 3 > 0, F.concat(F.lit("ride"), k.cast("string"))).otherwise("").alias("default_type"), F.when(k % 2 == 0, F.concat(F.lit("snow"), k.cast("string"))).alias("winter_default_type"), F.array(*map(F.lit, (12, 1, 2))).alias("winter_months"), (k % 4 == 1).alias("assisted"))


@query("flt_01", f"WITH {ACT}, {_REGIONED} SELECT activity_id, d, type, round(km, 6) AS km FROM reg WHERE type IN ('BUILDING', 'MACHINERY') AND d BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' AND list_contains(regions, 3) AND activity_id % 2 = 0 AND n % 3 = 2")
def flt_01(spark, d):
    """The log by types, dates, a region, issues and flags."""
    a = _regioned(spark, d).withColumns({"has_issues": F.col("activity_id") % 2 == 0, "flagged": F.col("n") % 3 == 2})
    return reports.log_query(a, ["BUILDING", "MACHINERY"], "2000-01-01", "2000-06-30", region=3, issues_only=True, flagged_only=True).select("activity_id", "d", "type", rnd("km", 6).alias("km"))


@query("flt_01_unassigned", f"WITH {ACT}, {_REGIONED} SELECT COUNT(*) AS n, MIN(d) AS first, MAX(d) AS last FROM reg WHERE len(regions) = 0 AND d >= DATE '1999-01-01'")
def flt_01_unassigned(spark, d):
    return reports.log_query(_regioned(spark, d), since="1999-01-01", region="unassigned").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


@query("flt_02", f"WITH {ACT}, {_REGIONED}, {_REGION_TYPES}, x AS (SELECT activity_id, d, unnest(regions) AS region_id, unnest(range(len(regions))) AS pos FROM reg), e AS (SELECT activity_id, arg_min(t, pos) AS t FROM (SELECT activity_id, pos, COALESCE(CASE WHEN month(d) IN (12, 1, 2) THEN winter END, nullif(summer, '')) AS t FROM x JOIN rt ON rt.region_id = x.region_id) WHERE t IS NOT NULL GROUP BY 1) SELECT reg.activity_id, COALESCE(CASE WHEN reg.activity_id % 5 = 0 THEN type END, t, '') AS effective FROM reg LEFT JOIN e ON e.activity_id = reg.activity_id")
def flt_02(spark, d):
    """The type set, else that of the first region that has one for the season."""
    a = _regioned(spark, d).withColumn("explicit", F.when(F.col("activity_id") % 5 == 0, F.col("type")))
    return reports.types_by_region(a, _region_types(spark)).select("activity_id", "effective")


@query("flt_03", f"WITH {ACT}, {_REGIONED}, {_REGION_TYPES}, x AS (SELECT activity_id, unnest(regions) AS region_id FROM reg), e AS (SELECT activity_id, bool_or(lifts) AS l FROM x JOIN rt ON rt.region_id = x.region_id GROUP BY 1) SELECT reg.activity_id, COALESCE(CASE WHEN reg.activity_id % 3 = 0 THEN assisted END, l, false) AS effective FROM reg LEFT JOIN e ON e.activity_id = reg.activity_id")
def flt_03(spark, d):
    a = _regioned(spark, d).withColumn("explicit", F.when(F.col("activity_id") % 3 == 0, F.col("assisted")))
    return reports.assisted_by_region(a, _region_types(spark)).select("activity_id", "effective")


@query("flt_07", f"WITH {TRK}, {C._INSIDE} SELECT DISTINCT activity_id FROM trk WHERE activity_id NOT IN (SELECT activity_id FROM inside) AND activity_id % 4 > 0 GROUP BY activity_id HAVING COUNT(*) >= 2")
def flt_07(spark, d):
    """Tracks of two points or more without a region, matched or pinned; every fourth has a pin."""
    p = track_points(spark, d)
    tags = spatial.points_in_regions(p, spatial.ring_edges(C._regions(spark))).select("activity_id").distinct()
    pins = p.where("activity_id % 4 = 0").select("activity_id").distinct()
    n = p.groupBy("activity_id").agg(F.count("*").alias("n")).where("n >= 2").select("activity_id")
    return n.join(tags, "activity_id", "left_anti").join(pins, "activity_id", "left_anti")


@query("lb_02", f"WITH {ACT}, {_REGIONED}, att AS (SELECT activity_id, unnest(regions) AS region, place AS name, direction, duration FROM reg WHERE n > 1) SELECT region, name, direction, COUNT(*) AS attempts, MIN(duration) AS best, arg_min(activity_id, (duration, activity_id)) AS best_id FROM att GROUP BY 1, 2, 3")
def lb_02(spark, d):
    """The index of trails by region; a ride of several regions counts in each."""
    a = _regioned(spark, d).select("activity_id", F.explode("regions").alias("region"), F.col("place").alias("name"), "direction", "duration", (F.col("n") > 1).alias("completed"))
    return spatial.trail_index(a, ["region", "name", "direction"])


@query("lb_04", f"WITH {ACT}, {_REGIONED}, att AS (SELECT unnest(regions) AS region, place AS name FROM reg WHERE n > 1), g AS (SELECT region, name, COUNT(*) AS attempts, name % 6 = 0 AS hidden, name * 100.0 AS length_m FROM att GROUP BY 1, 2) SELECT region, CAST(SUM(attempts) AS BIGINT) AS attempts, COUNT(*) AS trails, COUNT(*) FILTER (WHERE hidden) AS hidden, SUM(length_m) FILTER (WHERE NOT hidden) AS length_m FROM g GROUP BY 1")
def lb_04(spark, d):
    a = _regioned(spark, d).select("activity_id", F.explode("regions").alias("region"), F.col("place").alias("name"), "duration", (F.col("n") > 1).alias("completed"))
    names = a.select("name").distinct()
    return spatial.region_cards(spatial.trail_index(a, ["region", "name"]), names.where("name % 6 = 0"), names.select("name", (F.col("name") * 100.0).alias("length_m"))).groupBy("region").agg(F.sum("attempts").alias("attempts"), F.count("*").alias("trails"), F.count_if("hidden").alias("hidden"), F.sum(F.when(~F.col("hidden"), F.col("length_m"))).alias("length_m"))


@query("sm_06_strategies", f"""WITH {TRK}, e AS (SELECT activity_id, seq, ele FROM trk WHERE ele IS NOT NULL), m AS (SELECT *, {", ".join(f"AVG(ele) OVER (PARTITION BY activity_id ORDER BY seq ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING) AS ma{k}" for k in (10, 15, 20))} FROM e),
x AS (SELECT activity_id, ele - LAG(ele) OVER w AS raw, {", ".join(f"ma{k} - LAG(ma{k}) OVER w AS d{k}" for k in (10, 15, 20))} FROM m WINDOW w AS (PARTITION BY activity_id ORDER BY seq)) SELECT activity_id, round(SUM(greatest(raw, 0)), 4) AS raw, {", ".join(f"round(SUM(greatest(d{k}, 0)), 4) AS ma_{k}" for k in (10, 15, 20))} FROM x GROUP BY 1""")
def sm_06_strategies(spark, d):
    """Ascent by each way of counting that is a window."""
    return T.gain_strategies(track_points(spark, d)).select("activity_id", *(rnd(c, 4).alias(c) for c in ("raw", "ma_10", "ma_15", "ma_20")))


@query("agg_04_open", f"WITH {LEGS}, {C._SEG} SELECT s.activity_id, s.seg_no, s.type, round(SUM(dist), 3) AS dist_m, round(MAX(speed), 4) AS max_speed FROM seg s JOIN legs l ON l.activity_id = s.activity_id AND seq BETWEEN CASE WHEN start_seq > 0 THEN start_seq ELSE 0 END AND end_seq GROUP BY 1, 2, 3")
def agg_04_open(spark, d):
    """Segments with the leg into their first point, the other convention of their bounds."""
    p = legs(spark, d)
    return T.segment_sums(p, T.segments(p), closed=True).select("activity_id", "seg_no", "type", rnd("dist_m", 3).alias("dist_m"), rnd("max_speed", 4).alias("max_speed"))


@query("sum_04_measures", f"WITH {ACT}, s AS (SELECT type, CAST(date_trunc('month', d) AS DATE) AS month, COUNT(*) AS n, SUM(km) AS km, SUM(hours) AS hours, SUM(COALESCE(gain, 0)) AS ascent, SUM(COALESCE(n, 0)) AS descent FROM act GROUP BY 1, 2), t AS (SELECT type, CAST(date_trunc('month', MIN(d)) AS DATE) AS first FROM act GROUP BY 1), m AS (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month) SELECT t.type, m.month, CASE WHEN ok THEN COALESCE(n, 0) END AS n, round(CASE WHEN ok THEN COALESCE(km, 0.0) END, 6) AS km, round(CASE WHEN ok THEN COALESCE(hours, 0.0) END, 6) AS hours, CASE WHEN ok THEN COALESCE(ascent, 0.0) END AS ascent, CASE WHEN ok THEN COALESCE(descent, 0) END AS descent FROM (SELECT t.type, t.first, m.month, m.month >= t.first AND m.month <= DATE '2001-08-01' AS ok FROM t CROSS JOIN m) q JOIN t ON t.type = q.type JOIN m ON m.month = q.month LEFT JOIN s ON s.type = q.type AND s.month = q.month")
def sum_04_measures(spark, d):
    a = activities(spark, d).withColumns({"ascent": F.coalesce("gain", F.lit(0.0)), "descent": F.coalesce("n", F.lit(0))})
    h = reports.history(a, AS_OF, 8, ("km", "hours", "ascent", "descent"))
    return h.select("type", "month", "n", rnd("km").alias("km"), rnd("hours").alias("hours"), "ascent", F.col("descent").cast("long").alias("descent"))


@query("sum_03_totals", f"WITH {ACT} SELECT COUNT(DISTINCT CASE WHEN d > DATE '2001-07-18' AND d <= DATE '2001-08-01' THEN d END) AS active_14, date_diff('day', MAX(d) FILTER (WHERE d <= DATE '2001-08-01'), DATE '2001-08-01') AS days_since FROM act")
def sum_03_totals(spark, d):
    return reports.recency(activities(spark, d), AS_OF)


@query("fit_01_zones", f"WITH {ACT}, {C._RIDES}, {C._WEEK}, z2w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS week, SUM(z1) AS z1, SUM(z2) AS z2, SUM(z3) AS z3, SUM(z4) AS z4, SUM(z5) AS z5, SUM(kcal) AS kcal FROM rides GROUP BY 1) SELECT wk.week, {', '.join(f'round(COALESCE(z{k}, 0), 3) AS z{k}' for k in range(1, 6))}, round(COALESCE(kcal, 0), 3) AS kcal FROM wk LEFT JOIN z2w ON z2w.week = wk.week")
def fit_01_zones(spark, d):
    w = reports.weekly_zones(C._rides(spark, d), AS_OF, 26)
    return w.select("week", *(F.round(F.col("zones")[k], 3).alias(f"z{k + 1}") for k in range(5)), rnd("kcal", 3).alias("kcal"))


@query("fit_03", f"WITH {ACT}, {C._RIDES} SELECT activity_id, round(75.0 * CASE WHEN z1 + z2 + z3 + z4 + z5 > 0 THEN (3 * z1 + 5 * z2 + 8 * z3 + 11 * z4 + 14 * z5) / 3600 ELSE CASE type WHEN 'BUILDING' THEN 8.5 WHEN 'MACHINERY' THEN 7.0 ELSE 6.0 END * hours END, 3) AS kcal FROM rides")
def fit_03(spark, d):
    """Energy by zones, else by the type's metabolic equivalent (6 for types without one)."""
    met = F.when(F.col("type") == "BUILDING", 8.5).when(F.col("type") == "MACHINERY", 7.0).otherwise(6.0)
    return C._rides(spark, d).select("activity_id", F.round(reports.calories(F.col("zones"), met, F.lit(75.0), F.col("hours")), 3).alias("kcal"))


@query("rte_02_ends", f"WITH {C._ROUTE}, c AS (SELECT *, CASE WHEN pos > 1 AND name IS NOT DISTINCT FROM LAG(name) OVER w THEN 0 ELSE 1 END AS nw FROM rt WINDOW w AS (PARTITION BY route_id ORDER BY pos)), g AS (SELECT *, SUM(nw) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS macro FROM c) SELECT route_id, CAST(macro AS BIGINT) AS macro, name, arg_min(a, pos) AS start_node, arg_max(b, pos) AS end_node, string_agg(CAST(a AS VARCHAR), '-' ORDER BY pos) AS line FROM g GROUP BY 1, 2, 3")
def rte_02_ends(spark, d):
    """Macro segments with their ends and line."""
    r = C._route(spark, d).withColumnsRenamed({"a": "start_node", "b": "end_node"}).withColumn("line", F.array(F.col("start_node")))
    m = network.macro_lines(r)
    return m.select("route_id", "macro", "name", "start_node", "end_node", F.array_join(F.col("line").cast("array<string>"), "-").alias("line"))


@query("rg_08_stale", f"WITH {C._ROUTE}, e AS (SELECT DISTINCT p_partkey AS edge FROM part) SELECT route_id, bool_or(pos * 7 + a NOT IN (SELECT edge FROM e)) AS stale FROM rt GROUP BY 1")
def rg_08_stale(spark, d):
    """Routes with a segment that no edge of today's has."""
    s = C._route(spark, d).select("route_id", (F.col("pos") * 7 + F.col("a")).alias("edge_id"))
    return network.stale_routes(s, read(spark, d, "part").select(F.col("p_partkey").alias("edge_id")))


@query("str_03", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, MAX(ts) AS seen, COUNT(*) FILTER (WHERE event_type <> 'error') AS n FROM events GROUP BY 1, 2) SELECT user_id, d, n, n = 0 AND date_diff('day', d, DATE '2024-01-20') < 7 AS again FROM d")
def str_03(spark, d):
    """Sensor days that came empty are asked for again for a week, then trusted; batch form of the watermark."""
    from ..streaming.tracks import empty_days

    e = read(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.lit(1)))
    return empty_days(e, "2024-01-20")


@query("sum_01_cards", f"""WITH {ACT}, a AS (SELECT *, n * 40.0 AS loss, CASE WHEN n > 0 THEN 8.0 + n END AS avg_speed, n * 5.5 AS max_speed, CASE WHEN n % 3 > 0 THEN 110 + n END AS hr_avg, CASE WHEN n % 3 > 0 THEN 150 + n END AS hr_max FROM act WHERE d BETWEEN DATE '2001-05-04' AND DATE '2001-08-01'),
g AS (SELECT type, COUNT(DISTINCT d) AS days, COUNT(*) AS n, round(SUM(km), 1) AS km, CAST(round_even(COALESCE(SUM(gain), 0), 0) AS BIGINT) AS gain, CAST(round_even(SUM(loss), 0) AS BIGINT) AS loss, round(SUM(CASE WHEN avg_speed > 0 THEN km / avg_speed ELSE 0 END), 2) AS riding_h, nullif(round(MAX(max_speed), 1), 0) AS max_speed, CAST(round_even(AVG(hr_avg), 0) AS BIGINT) AS hr_avg, MAX(hr_max) AS hr_max, MAX(d) AS last_day FROM a GROUP BY 1),
runs AS (SELECT type, COUNT(*) AS n, MAX(d) AS last_day FROM (SELECT type, d, d - CAST(ROW_NUMBER() OVER (PARTITION BY type ORDER BY d) AS INTEGER) AS g FROM (SELECT DISTINCT type, d FROM a)) GROUP BY type, g), st AS (SELECT type, MAX(n) AS longest, COALESCE(MAX(CASE WHEN last_day BETWEEN DATE '2001-07-31' AND DATE '2001-08-01' THEN n END), 0) AS current FROM runs GROUP BY 1)
SELECT g.*, CASE WHEN riding_h > 0 THEN round(km / riding_h, 1) END AS avg_speed, longest, current FROM g JOIN st ON st.type = g.type""")
def sum_01_cards(spark, d):
    n = F.col("n")
    a = activities(spark, d).withColumns({"loss": n * 40.0, "avg_speed": F.when(n > 0, 8.0 + n), "max_speed": n * 5.5, "hr_avg": F.when(n % 3 > 0, 110 + n), "hr_max": F.when(n % 3 > 0, 150 + n)})
    return reports.type_summary(a, AS_OF, 90)


@query("agg_10_facts", f"""WITH {LEGS}, {C._INSIDE}, {C._SPARK}, {C._AGG}, {C._SEG}, {C._SPIKES}, {C._ISSUES}, rg AS (SELECT activity_id, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY region_id) AS regions FROM (SELECT i.activity_id, region_id FROM inside i JOIN (SELECT activity_id, COUNT(*) AS total FROM trk GROUP BY 1) t ON t.activity_id = i.activity_id GROUP BY 1, 2, total HAVING COUNT(*) >= greatest(1, floor(total * CAST(0.15 AS DOUBLE)))) GROUP BY 1), hr AS (SELECT activity_id, CAST(round_even(AVG(bpm), 0) AS BIGINT) AS hr_avg, MAX(bpm) AS hr_max FROM (SELECT activity_id, CASE WHEN event_id % 7 > 0 THEN 90 + event_id % 97 END AS bpm FROM trk WHERE activity_id % 3 > 0) GROUP BY 1), x AS (SELECT activity_id, arg_min(lat, seq) AS lat0, arg_min(lon, seq) AS lon0, MIN(lat) AS min_lat, MIN(lon) AS min_lon, MAX(lat) AS max_lat, MAX(lon) AS max_lon, CAST(MIN(ts) AS DATE) AS date, MIN(t_s) AS start_s, MAX(t_s) AS end_s, COUNT(*) AS points FROM legs GROUP BY 1), sg AS (SELECT activity_id, COUNT(*) FILTER (WHERE type = 'assisted') AS lifts FROM seg GROUP BY 1), i AS (SELECT activity_id, COUNT(*) AS issues FROM iss GROUP BY 1)
SELECT st.activity_id, date, points, round(distance_km, 4) AS distance_km, round(elev_gain_m, 3) AS elev_gain_m, round(elev_loss_m, 3) AS elev_loss_m, round(assisted_gain_m, 3) AS assisted_gain_m, riding_s, duration_sec, round(distance_km / nullif(riding_s / 3600.0, 0), 3) AS avg_speed_kmh, round(max_speed_kmh, 3) AS max_speed_kmh, peak_ele_m, lifts, round(lat0, 4) AS lat0, round(lon0, 4) AS lon0, round(max_lat - min_lat, 6) AS height, round(max_lon - min_lon, 6) AS width, COALESCE(issues, 0) AS issues, start_s, end_s, COALESCE(regions, '') AS regions, hr_avg IS NOT NULL AS has_hr, hr_avg, hr_max, CASE WHEN spk.n >= 2 THEN spk.n END AS spark_n, CASE WHEN spk.n >= 2 THEN round(spk.total, 4) END AS spark_total,
 CASE WHEN st.activity_id % 4 = 0 THEN 'hike' WHEN month(date) IN (12, 1, 2, 3) AND regions IS NOT NULL THEN 'ski' ELSE 'ride' END AS effective_type, CASE WHEN distance_km > 0 THEN greatest(1, CAST(round_even(pow(distance_km + elev_gain_m / 55, 0.83) / 3.2 * (1 + greatest(0, elev_gain_m / distance_km - 30) / 60), 0) AS INTEGER)) END AS difficulty
FROM st JOIN x USING (activity_id) JOIN sg USING (activity_id) JOIN spk USING (activity_id) LEFT JOIN i USING (activity_id) LEFT JOIN rg USING (activity_id) LEFT JOIN hr USING (activity_id)""")
def agg_10_facts(spark, d):
    """The fact row of each activity: statistics, box, difficulty, issues, times, regions, type, heart rates (two of three activities have any) and the sparkline."""
    from ..operators.quality import issues

    p = legs(spark, d)
    ends = p.groupBy("activity_id").agg(F.min_by("lat", "seq").alias("lat0"), F.min_by("lon", "seq").alias("lon0"), F.to_date(F.min("ts")).alias("date"), F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"), F.count("*").alias("points"))
    f = T.activity_stats(T.smooth_speed(p)).join(ends, "activity_id").join(T.bounding_boxes(p), "activity_id").join(T.lift_counts(p), "activity_id")
    f = f.join(issues(T.spikes(p)).select("activity_id", F.size("issues").cast("long").alias("issues")), "activity_id")
    tags = spatial.region_tags(p, spatial.ring_edges(C._regions(spark))).groupBy("activity_id").agg(F.array_join(F.array_sort(F.collect_list("region_id")).cast("array<string>"), ",").alias("regions"))
    rates = p.where("activity_id % 3 > 0").withColumn("bpm", F.when(F.col("event_id") % 7 > 0, 90 + F.col("event_id") % 97)).groupBy("activity_id").agg(F.bround(F.avg("bpm")).cast("long").alias("hr_avg"), F.max("bpm").alias("hr_max"))
    lines = T.sparklines(p).select("activity_id", F.when(F.col("spark").isNotNull(), F.size("spark").cast("long")).alias("spark_n"), F.round(F.aggregate("spark", F.lit(0.0), lambda a, x: a + x), 4).alias("spark_total"))
    f = f.join(lines, "activity_id").join(tags, "activity_id", "left").join(rates, "activity_id", "left")
    kind = reports.effective_type(F.when(F.col("activity_id") % 4 == 0, F.lit("hike")), F.month("date").isin(12, 1, 2, 3), F.when(F.col("regions").isNotNull(), F.lit("ski")), F.lit("ride"))
    f = f.withColumns({"effective_type": kind, "regions": F.coalesce("regions", F.lit("")), "has_hr": F.col("hr_avg").isNotNull()})
    score = reports.difficulty(F.col("distance_km"), F.col("elev_gain_m"), F.col("elev_loss_m"), F.lit(False))
    return f.select("start_s", "end_s", "regions", "has_hr", "hr_avg", "hr_max", "spark_n", "spark_total", "effective_type", "activity_id", "date", "points", rnd("distance_km", 4).alias("distance_km"), *(rnd(c, 3).alias(c) for c in ("elev_gain_m", "elev_loss_m", "assisted_gain_m", "avg_speed_kmh", "max_speed_kmh")), "riding_s", "duration_sec", "peak_ele_m", F.col("lift_count").alias("lifts"), rnd("lat0", 4).alias("lat0"), rnd("lon0", 4).alias("lon0"), rnd(F.col("max_lat") - F.col("min_lat")).alias("height"), rnd(F.col("max_lon") - F.col("min_lon")).alias("width"), "issues", score.alias("difficulty"))


@query("rte_09_region", f"WITH {TRK}, s AS (SELECT activity_id, event_id % 3 AS region_id, seq AS pos, 'trail ' || CAST(event_id % 4 AS VARCHAR) AS name FROM trk), b AS (SELECT *, LAG(name) OVER (PARTITION BY activity_id, region_id ORDER BY pos) AS p FROM s), g AS (SELECT activity_id, region_id, COUNT(*) AS segments, list(name ORDER BY pos) FILTER (WHERE name IS DISTINCT FROM p) AS l FROM b GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY activity_id ORDER BY segments DESC, region_id) AS r FROM g) SELECT activity_id, region_id, segments, CASE WHEN length(array_to_string(l, ' → ')) > 80 THEN array_to_string(l[1:3], ' → ') || ' → +' || CAST(len(l) - 3 AS VARCHAR) || ' more' ELSE array_to_string(l, ' → ') END AS title FROM r WHERE r = 1")
def rte_09_region(spark, d):
    """Proposals by the region that resolves the most."""
    p = track_points(spark, d)
    return network.proposals(p.select("activity_id", (F.col("event_id") % 3).alias("region_id"), F.col("seq").alias("pos"), F.concat(F.lit("trail "), (F.col("event_id") % 4).cast("string")).alias("name")))


@query("fn_lookups", f"WITH {ACT} SELECT activity_id, round(km * 0.621371, 6) AS miles, round(CAST(n AS DOUBLE) * CAST(3.28084 AS DOUBLE), 6) AS feet, CASE WHEN c = 0 THEN 'clear' WHEN c <= 3 THEN 'cloud' WHEN c <= 48 THEN 'fog' WHEN c <= 67 THEN 'rain' WHEN c <= 77 THEN 'snow' WHEN c <= 82 THEN 'rain' WHEN c <= 86 THEN 'snow' WHEN c > 86 THEN 'storm' END AS weather, CASE s WHEN 'Snowboard' THEN 'snowboard' WHEN 'Hike' THEN 'hike' WHEN 'GravelRide' THEN 'mtb' WHEN 'NordicSki' THEN 'ski' END AS sport FROM (SELECT *, CASE WHEN n % 5 > 0 THEN activity_id % 100 END AS c, ['Snowboard', 'Hike', 'GravelRide', 'NordicSki', 'Run'][activity_id % 5 + 1] AS s FROM act)")
def fn_lookups(spark, d):
    i = F.col("activity_id")
    sport = F.element_at(F.array(*map(F.lit, ("Snowboard", "Hike", "GravelRide", "NordicSki", "Run"))), (i % 5 + 1).cast("int"))
    return activities(spark, d).select("activity_id", rnd(lookups.distance(F.col("km"), True)).alias("miles"), rnd(lookups.height(F.col("n"), True)).alias("feet"), lookups.weather_class(F.when(F.col("n") % 5 > 0, i % 100)).alias("weather"), lookups.sport_type(sport).alias("sport"))
