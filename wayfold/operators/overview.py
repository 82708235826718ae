"""Smaller operators around tracks and activities: lookups, look-backs, reports for a page, and digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .asof import weather_overlap
from .similarity import duplicate_groups
from .spatial import grid_cells

# ---------------------------------------------------------------- stored results and lookups


def current_results(results: DataFrame, version: int) -> DataFrame:
    """Stored match results of the present version whose timeline can be read; others are left for a new match."""
    return results.where((F.col("version") == version) & F.col("timeline").isNotNull())


def geocoded(points: DataFrame, places: DataFrame) -> DataFrame:
    """``points(..., lat, lon)`` with the place known for their coordinates at one decimal, null if none is."""
    known = places.select(F.col("lat1").alias("_a"), F.col("lon1").alias("_b"), "place").dropDuplicates(["_a", "_b"])
    p = points.withColumns({"_a": F.round("lat", 1), "_b": F.round("lon", 1)})
    return p.join(known, ["_a", "_b"], "left").drop("_a", "_b")


def region_results(found: DataFrame, denied: list[str]) -> DataFrame:
    """Results of a region search that are polygons and of no denied class; of several polygons the first."""
    ok = found.where(F.col("kind").isin("Polygon", "MultiPolygon") & ~F.coalesce(F.col("class").isin(denied), F.lit(False)))
    return ok.where(F.size("polygons") > 0).withColumn("ring", F.col("polygons")[0][0]).drop("polygons", "kind")


def outer_rings(regions: DataFrame) -> DataFrame:
    """Regions' outer rings turned from (lon, lat) to (lat, lon), with their boxes."""
    ring = F.transform(F.col("coordinates")[0], lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    r = regions.withColumn("ring", ring)
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return r.select("region_id", "ring", side(F.array_min, "lat").alias("min_lat"), side(F.array_min, "lon").alias("min_lon"), side(F.array_max, "lat").alias("max_lat"), side(F.array_max, "lon").alias("max_lon"))


def line_boxes(lines: DataFrame) -> DataFrame:
    """Boxes of ``lines(id, line array<struct<lat, lon>>)``; of an empty line null."""
    side = lambda f, c: f(F.transform("line", lambda p: p[c]))
    return lines.select("id", side(F.array_min, "lat").alias("min_lat"), side(F.array_min, "lon").alias("min_lon"), side(F.array_max, "lat").alias("max_lat"), side(F.array_max, "lon").alias("max_lon"))


# ---------------------------------------------------------------- statistics and weather


def merged_statistics(base: DataFrame, recomputed: DataFrame, key: str = "activity_id") -> DataFrame:
    """Statistics in which what was computed anew takes the place of what was there, and the rest stays."""
    new = recomputed.withColumnsRenamed({c: f"__{c}" for c in recomputed.columns if c != key}).withColumn("__known", F.lit(True))
    j = base.join(new, key, "left")
    extra = [F.col(f"__{c}").alias(c) for c in recomputed.columns if c not in base.columns]
    return j.select(*(F.when(F.col("__known"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in recomputed.columns and c != key else F.col(c) for c in base.columns), *extra)


def activity_weather(points: DataFrame, stations: DataFrame, default_s: int = 3600) -> DataFrame:
    """Weather of each track at its mean position (to ``stations(place_lat, place_lon, t, ...)`` by whole tenths of a degree) from its start for its duration, or ``default_s``."""
    g = points.groupBy("activity_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("t_s").alias("start_s"), F.max("t_s").alias("last_s"))
    spans = g.select("activity_id", F.round("lat", 1).alias("place_lat"), F.round("lon", 1).alias("place_lon"), "start_s", F.when(F.col("last_s") > F.col("start_s"), F.col("last_s")).otherwise(F.col("start_s") + default_s).alias("end_s"))
    return weather_overlap(spans, stations, ["place_lat", "place_lon"])


def sensor_day(samples: DataFrame) -> DataFrame:
    """Samples of each day that have a value, with the day's least, greatest and resting (upper median of its lowest tenth) rates."""
    w = Window.partitionBy("d")
    s = samples.where("bpm IS NOT NULL")
    s = s.withColumns({"n": F.count("*").over(w), "place": F.row_number().over(w.orderBy("bpm", "t"))})
    resting = F.max(F.when(F.col("place") == F.floor(F.ceil(F.col("n") / 10) / 2) + 1, F.col("bpm"))).over(w)
    return s.select("d", "t", "bpm", F.min("bpm").over(w).alias("day_min"), F.max("bpm").over(w).alias("day_max"), resting.alias("resting"))


def dates_to_fetch(have: DataFrame, today: str, days: int, always: int = 3, most: int | None = None) -> DataFrame:
    """Dates of the last ``days`` before ``today`` that are missing or complete in no row of ``have(d, complete)``, with the last ``always`` in any case; the newest ``most``."""
    end = F.to_date(F.lit(today))
    spine = have.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days), F.date_sub(end, 1))).alias("d"))
    full = have.where("complete").select("d").distinct()
    out = spine.join(full, "d", "left_anti").unionByName(spine.where(F.col("d") >= F.date_sub(end, always))).distinct()
    return out if most is None else out.orderBy(F.desc("d")).limit(most)


def missing_days(active: DataFrame, have: DataFrame) -> DataFrame:
    """Days with an activity and no sensor file."""
    return active.select("d").distinct().join(have.select("d").distinct(), "d", "left_anti")


def incomplete_days(days: DataFrame, today: str, trusted_after: int = 7) -> DataFrame:
    """Days whose sensor file doesn't reach over their activities, unless it was fetched ``trusted_after`` days or more after the day: then what it lacks doesn't exist.

    ``days(d, first, last, lo, hi, fetched)``: span of activities, of samples, and the date of the fetch, null if never.
    """
    short = F.col("lo").isNull() | (F.col("lo") > F.col("first") + 300) | (F.col("hi") < F.col("last") - 300)
    late = F.coalesce(F.datediff("fetched", "d") >= trusted_after, F.lit(False))
    bad = days.withColumn("bad", short & ~late).where(F.col("d") <= F.to_date(F.lit(today)))
    return bad.groupBy("d").agg(F.bool_or("bad").alias("bad")).where("bad").select("d")


# ---------------------------------------------------------------- routes, groups and suggestions


def route_cells(segments: DataFrame, vertices: DataFrame, metres: float, ref_lat: float) -> DataFrame:
    """Cells of saved routes: ``segments(route_id, edge_id)`` through ``vertices(edge_id, lat, lon)``."""
    p = segments.select("route_id", "edge_id").distinct().join(vertices, "edge_id")
    return grid_cells(p, metres, ref_lat).select("route_id", "cn", "ce").distinct()


def group_report(groups: DataFrame, dates: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Duplicate groups of two or more, newest first: members, their number and a signature; groups with a dismissed signature go."""
    g = groups.join(dates, groups["v"] == dates["activity_id"]).groupBy("c").agg(F.array_sort(F.collect_list("v")).alias("members"), F.max("d").alias("d"))
    g = g.withColumn("signature", F.md5(F.array_join(F.transform("members", lambda m: m.cast("string")), "|"))).where(F.size("members") >= 2)
    return g.join(dismissed.select("signature").distinct(), "signature", "left_anti").orderBy(F.desc("d"), "c")


def suggestions(clusters: DataFrame, titles: DataFrame, dismissed: DataFrame, region: str | None = None, least: int = 2) -> DataFrame:
    """Routes to suggest: clusters of ``clusters(cluster, region_id, activity_id, representative)`` with an id from region and members, the most rides first, then by the representative's title; dismissed ones, and those of other regions than ``region``, go."""
    g = clusters.groupBy("cluster", "region_id", "representative").agg(F.array_sort(F.collect_list("activity_id")).alias("members"))
    text = F.concat_ws("|", F.coalesce(F.col("region_id").cast("string"), F.lit("")), F.array_join(F.transform("members", lambda m: m.cast("string")), "|"))
    g = g.withColumns({"suggestion_id": F.substring(F.md5(text), 1, 12), "rides": F.size("members")}).where(F.col("rides") >= least)
    if region is not None:
        g = g.where(F.col("region_id").cast("string") == region)
    g = g.join(dismissed.select("suggestion_id").distinct(), "suggestion_id", "left_anti")
    t = titles.select(F.col("activity_id").alias("representative"), "title")
    return g.join(t, "representative", "left").orderBy(F.desc("rides"), "title", "suggestion_id")


DENSE = 2048  #: clusters of which one task holds the scores of all pairs, at most


def _joined_within(pairs: pd.DataFrame) -> pd.DataFrame:
    """``clusters_of_rides`` of what hangs together by ``pairs(a, b, score)``, in the same rounds: each cluster ``v`` and the one it ends in."""
    ids, at = np.unique(pairs[["a", "b"]].to_numpy(), return_inverse=True)
    n, at = len(ids), at.reshape(-1, 2)
    score = np.full((n, n), -np.inf)
    score[at[:, 0], at[:, 1]] = score[at[:, 1], at[:, 0]] = pairs["score"].to_numpy()
    cluster, every = np.arange(n), np.arange(n)
    best = score.argmax(1)  # the first of equals: ids are in order
    while True:
        one = np.flatnonzero((best[best] == every) & (every < best) & (score[every, best] > -np.inf))
        if not len(one):
            return pd.DataFrame({"v": ids, "to": ids[cluster]})
        two = best[one]
        # a pair that either part lacks is lost, as the least of both
        score[one] = np.minimum(score[one], score[two])
        score[:, one] = np.minimum(score[:, one], score[:, two])
        score[two] = score[:, two] = score[one, one] = -np.inf
        to = every.copy()
        to[two] = one
        cluster = to[cluster]
        anew = np.isin(best, np.concatenate([one, two]))  # scores only fall, so that any other best one stays
        best[anew] = score[anew].argmax(1)


def clusters_of_rides(scores: DataFrame, rides: DataFrame, least: float) -> DataFrame:
    """Complete-linkage clusters in rounds: two that are each other's most alike, by the least score between their members, are joined, until no pair has ``least``.

    ``scores(a, b, score)`` has all pairs of ``rides(v)`` that may join; a pair
    that it lacks never does.  A round joins many pairs at once; ties go to the
    smaller ids, which may take as many rounds as there are rides.  What hangs
    together by at most ``DENSE`` rides goes through its rounds in one task, of
    many; what is larger goes by joins and minima, so that no component is one
    task's, until as few clusters are left.
    """
    name = cut(rides.select("v", F.col("v").alias("cluster")))
    live = cut(scores.where(F.col("score") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"))
    group = cut(duplicate_groups(live).select(F.col("v").alias("a"), "c"))
    few = group.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") <= DENSE).select("c", F.lit(True).alias("few"))
    live = cut(live.join(group.join(few, "c", "left"), "a"))
    name = cut(_within(live.where("few"), name))
    live = live.where("few IS NULL").select("a", "b", "score")
    while not live.isEmpty():
        if live.select(F.explode(F.array("a", "b"))).distinct().count() <= DENSE:
            return _within(live.withColumn("c", F.lit(0)), name)
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        pair = F.struct(F.col("score").alias("s"), (-F.least("a", "b")).alias("x"), (-F.greatest("a", "b")).alias("y"))
        best = both.groupBy("a").agg(F.max(F.struct(pair.alias("p"), F.col("b").alias("b"))).alias("m")).select("a", F.col("m.b").alias("b"))
        back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
        moved = cut(best.join(back, ["a", "b"]).where("a < b").select(F.col("b").alias("old"), F.col("a").alias("new")))
        to = lambda df, c: df.join(F.broadcast(moved) if moved.count() <= 200_000 else moved, df[c] == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        joined = moved.select(F.col("new").alias("c"), F.lit(2).alias("parts"))
        renamed = to(to(live, "a"), "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
        g = renamed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("score").alias("score"))
        g = g.join(joined.withColumnsRenamed({"c": "a", "parts": "pa"}), "a", "left").join(joined.withColumnsRenamed({"c": "b", "parts": "pb"}), "b", "left")
        # all pairs of the parts must be there, or one was below the least
        live = cut(g.where(F.col("n") == F.coalesce("pa", F.lit(1)) * F.coalesce("pb", F.lit(1))).select("a", "b", "score"))
        name = cut(to(name, "cluster").select("v", "cluster"))
    return name


def _within(live: DataFrame, name: DataFrame) -> DataFrame:
    """``name(v, cluster)`` after all rounds of each group ``c`` of ``live(a, b, score, c)``."""
    done = live.select("a", "b", "score", "c").groupBy("c").applyInPandas(_joined_within, "v long, to long")
    return name.join(done.withColumnRenamed("v", "cluster"), "cluster", "left").select("v", F.coalesce("to", "cluster").alias("cluster"))


# ---------------------------------------------------------------- digests


def digest(columns: list[Column]) -> Column:
    """A digest of values in a fixed order; nulls have a mark of their own."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)))


def table_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: number of rows, and a digest of them all that doesn't depend on their order."""
    each = F.conv(F.substring(digest([F.col(c) for c in [key, *columns]]), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.md5(F.coalesce(F.sum(each), F.lit(0)).cast("string")).alias("fingerprint"))


def edit_key(trim: Column, smoothing: Column, shift: Column, repair: Column) -> Column:
    """Key of what edits of a track change its points; other metadata don't."""
    return F.substring(digest([trim, smoothing, shift, repair]), 1, 12)


def entry_key(times: list[Column], meta: list[Column], algorithm: Column, versions: list[Column], rates: list[Column]) -> Column:
    """Key of all that an activity's entry depends on: times of the file, regions and types, to milliseconds; its metadata; the detector; versions; greatest and resting heart rate."""
    return F.substring(digest([*(F.round(t, 3) for t in times), *meta, algorithm, *versions, *rates]), 1, 16)


def table_state(rows: DataFrame, time: str) -> DataFrame:
    """One row of ``state``: number of rows and latest time, which both move with every change; 0 and -1 for an empty table."""
    state = F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.max(time), F.lit(-1)).cast("string"))
    return rows.agg(state.alias("state"))


def route_keys(routes: DataFrame, regions: DataFrame, matched: DataFrame, meta_time: int, versions: list[int]) -> DataFrame:
    """Keys of the attempts at each of ``routes(route_id, region_id, created, modified)``: versions, when the route changed, the state of the ``matched`` tracks, metadata, and ``regions(region_id, time)``, the time of its region's network or -1."""
    r = routes.join(regions.select("region_id", F.col("time").alias("_time")), "region_id", "left").crossJoin(F.broadcast(matched))  # one row
    parts = [*map(F.lit, versions), F.coalesce("modified", "created", F.lit("")), F.col("state"), F.lit(meta_time), F.coalesce("_time", F.lit(-1))]
    return r.select("route_id", digest(parts).alias("fingerprint"))


def suggestion_key(matched: DataFrame, saved: DataFrame, times: list[int], versions: list[int]) -> DataFrame:
    """One row: key of the suggestions, from versions, the states of the ``matched`` tracks and ``saved`` routes, and times of metadata and regions."""
    both = matched.crossJoin(saved.withColumnRenamed("state", "_saved"))  # a row each
    return both.select(digest([*map(F.lit, versions), F.col("state"), F.col("_saved"), *map(F.lit, times)]).alias("fingerprint"))


def wellness(days: DataFrame) -> DataFrame:
    """Flat row a day of payloads of several kinds; what a payload lacks is null.

    ``days`` has ``date`` and, nested: ``status`` (``vo2``, and devices by name),
    ``battery`` (levels as arrays whose last item counts), ``resting``,
    ``sleep`` and ``stress``.  Of the devices the newest by its time stamp counts.
    """
    newest = F.array_max(F.transform(F.map_values("status.devices"), lambda d: F.struct(F.coalesce(d["timestamp"], F.lit(0)).alias("timestamp"), d["training_status"].alias("training_status"), d["load"].alias("load"))))
    levels = F.filter(F.transform("battery.levels", lambda e: F.try_element_at(e, F.lit(-1))), lambda x: x.isNotNull())
    asleep = lambda c: F.when(F.col("sleep.total").isNotNull(), F.col(f"sleep.{c}"))
    return days.select(
        "date", F.round("status.vo2.value", 1).alias("vo2max"), F.when(F.col("status.vo2.value").isNotNull(), F.col("status.vo2.age")).alias("fitness_age"), newest["training_status"].alias("training_status"), newest["load"].alias("weekly_load"),
        F.col("battery.charged").alias("charged"), F.col("battery.drained").alias("drained"), F.array_max(levels).alias("level_high"), F.array_min(levels).alias("level_low"), F.try_element_at(levels, F.lit(-1)).alias("level_end"),
        F.try_element_at("resting", F.lit(1)).alias("resting_hr"), F.col("sleep.total").alias("sleep_sec"), asleep("deep").alias("sleep_deep"), asleep("light").alias("sleep_light"), asleep("rem").alias("sleep_rem"), F.col("stress.avg").alias("stress_avg"), F.col("stress.most").alias("stress_max"),
    )
