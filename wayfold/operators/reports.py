"""Reports over activities: rollups, records, streaks, calendar spines and training load.

Activities have ``activity_id, d (date), type, km, gain, hours, assisted``
and more where a function says so; "today" is always a parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import median_upper

# ---------------------------------------------------------------- summaries


def window_rollup(acts: DataFrame, as_of: str, days: int, by: str = "type") -> DataFrame:
    """Rollup of the last ``days`` days and of as many before, in one pass; with the totals over all types, whose ``by`` is null.

    Active days are counted distinct for each group and for the total.
    """
    today = F.to_date(F.lit(as_of))
    now, prior = F.col("d").between(F.date_sub(today, days - 1), today), F.col("d").between(F.date_sub(today, 2 * days - 1), F.date_sub(today, days))
    a = acts.where(now | prior).withColumns({"now": now, "prior": prior})
    pick = lambda c, v: F.coalesce(F.sum(F.when(F.col(c), v)), F.lit(0.0))
    return a.groupingSets([["type"], []], F.col(by)).agg(
        F.count_if("now").alias("n"), F.count_distinct(F.when(F.col("now"), F.col("d"))).alias("days"), pick("now", F.col("km")).alias("km"), pick("now", F.col("gain")).alias("gain"), pick("now", F.col("hours")).alias("hours"), F.max(F.when(F.col("now"), F.col("km"))).alias("max_km"), F.max(F.when(F.col("now"), F.col("d"))).alias("last_day"),
        F.count_if("prior").alias("prior_n"), pick("prior", F.col("km")).alias("prior_km"),
    )


def type_summary(acts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Card of each type over the last ``days`` days: active days, count, distance, ascent, descent, riding hours (distance over average speed), speeds, heart rates, streaks, last day.

    The average speed is that of the rounded distance and hours.
    """
    today = F.to_date(F.lit(as_of))
    a = acts.where(F.col("d").between(F.date_sub(today, days - 1), today))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    hours = total(F.when(F.col("avg_speed") > 0, F.col("km") / F.nullif("avg_speed", F.lit(0.0))))
    g = a.groupBy("type").agg(
        F.count_distinct("d").alias("days"), F.count("*").alias("n"), F.round(total("km"), 1).alias("km"), F.rint(total("gain")).cast("long").alias("gain"), F.rint(total("loss")).cast("long").alias("loss"), F.round(hours, 2).alias("riding_h"),
        F.nullif(F.round(F.max("max_speed"), 1), F.lit(0.0)).alias("max_speed"), F.rint(F.avg("hr_avg")).cast("long").alias("hr_avg"), F.max(F.nullif("hr_max", F.lit(0))).alias("hr_max"), F.max("d").alias("last_day"),
    )
    g = g.withColumn("avg_speed", F.when(F.col("riding_h") > 0, F.round(F.col("km") / F.nullif("riding_h", F.lit(0.0)), 1)))
    return g.join(streaks(a, as_of), "type")


def history(acts: DataFrame, as_of: str, years: int, measures: tuple[str, ...] = ("km",)) -> DataFrame:
    """Type x month: count and sums of ``measures``; zero in empty months, null before the first activity's month and after ``as_of``'s."""
    months = F.explode(F.sequence(F.add_months(F.trunc(F.to_date(F.lit(as_of)), "year"), -12 * (years - 1)), F.add_months(F.trunc(F.to_date(F.lit(as_of)), "year"), 11), F.expr("interval 1 month")))
    types = acts.groupBy("type").agg(F.trunc(F.min("d"), "month").alias("first"))
    spine = types.withColumn("month", months)  # types are few
    sums = acts.groupBy("type", F.trunc("d", "month").alias("month")).agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in measures))
    known = (F.col("month") >= F.col("first")) & (F.col("month") <= F.to_date(F.lit(as_of)))
    kept = lambda c: F.when(known, F.coalesce(c, F.lit(0).cast(sums.schema[c].dataType))).alias(c)
    return spine.join(sums, ["type", "month"], "left").select("type", "month", kept("n"), *map(kept, measures))


def stepwise_sums(acts: DataFrame) -> DataFrame:
    """Monthly distance of each type, rounded to one place after each addition, in the order of ids."""
    rows = acts.groupBy("type", F.trunc("d", "month").alias("month")).agg(F.array_sort(F.collect_list(F.struct("activity_id", "km"))).alias("s"))
    return rows.select("type", "month", F.aggregate("s", F.lit(0.0), lambda a, x: F.round(a + x["km"], 1)).alias("km"))


def dominant_types(acts: DataFrame) -> DataFrame:
    """Each day's type: that of the most recently active type among the day's."""
    recent = acts.groupBy("type").agg(F.max("d").alias("last_day"))
    w = Window.partitionBy("d").orderBy(F.desc("last_day"), F.desc("type"))
    return acts.select("d", "type").distinct().join(recent, "type").withColumn("r", F.row_number().over(w)).where("r = 1").select("d", "type")


def type_order(acts: DataFrame) -> DataFrame:
    """Types by their last day, newest first, then id descending."""
    recent = acts.groupBy("type").agg(F.max("d").alias("last_day"))
    return recent.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_day"), F.desc("type"))).cast("long"))


def year_over_year(acts: DataFrame, as_of: str) -> DataFrame:
    """Growth of distance in this year's months so far against the same months of the last."""
    today = F.to_date(F.lit(as_of))
    upto = F.month("d") <= F.month(today)
    this, last = upto & (F.year("d") == F.year(today)), upto & (F.year("d") == F.year(today) - 1)
    g = acts.groupBy("type").agg(F.sum(F.when(this, F.col("km")).otherwise(0.0)).alias("km"), F.sum(F.when(last, F.col("km")).otherwise(0.0)).alias("km_before"))
    return g.withColumn("growth", 100 * (F.col("km") - F.col("km_before")) / F.nullif("km_before", F.lit(0.0)))


def streaks(acts: DataFrame, as_of: str, by: str = "type") -> DataFrame:
    """Longest run of consecutive active days, and the run that ends on ``as_of`` or the day before, else 0."""
    days = acts.select(by, "d").distinct()
    runs = days.withColumn("g", F.date_sub("d", F.row_number().over(Window.partitionBy(by).orderBy("d")))).groupBy(by, "g").agg(F.count("*").alias("n"), F.max("d").alias("last_day"))
    today = F.to_date(F.lit(as_of))
    return runs.groupBy(by).agg(F.max("n").alias("longest"), F.coalesce(F.max(F.when(F.col("last_day").between(F.date_sub(today, 1), today), F.col("n"))), F.lit(0)).alias("current"))


def records(acts: DataFrame, metrics: dict[str, str], by: str = "type") -> DataFrame:
    """The best activity of each group for each metric (label to expression); ties go to the first id."""
    stack = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in metrics.items())
    long = acts.selectExpr(by, "activity_id", "d", f"stack({len(metrics)}, {stack}) AS (metric, value)").where("value IS NOT NULL")
    w = Window.partitionBy(by, "metric").orderBy(F.desc("value"), "activity_id")
    return long.withColumn("r", F.row_number().over(w)).where("r = 1").select(by, "metric", "activity_id", "d", "value")


def record_book(acts: DataFrame, snow: list[str]) -> DataFrame:
    """Records of each type: snow sports by vertical, others by climbing and descent; length and duration of unassisted activities alone."""
    free = lambda c: f"CASE WHEN NOT assisted THEN {c} END"
    common = {"Longest": free("km"), "Top speed": "speed", "Duration": free("hours")}
    is_snow = F.col("type").isin(snow)
    return records(acts.where(is_snow), {"Vertical": "loss"} | common).unionByName(records(acts.where(~is_snow), {"Climbing": "gain", "Descent": "loss"} | common))


def recency(acts: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """One row: active days among the last ``days``, and days since the last activity."""
    today = F.to_date(F.lit(as_of))
    upto = F.when(F.col("d") <= today, F.col("d"))
    return acts.agg(F.count_distinct(F.when(upto > F.date_sub(today, days), upto)).alias(f"active_{days}"), F.datediff(today, F.max(upto)).cast("long").alias("days_since"))


def recent(acts: DataFrame, per_type: int = 5, most: int = 25) -> DataFrame:
    """Newest activities: some of each type, then the newest of all, duration as H:MM."""
    w = Window.partitionBy("type").orderBy(F.desc("d"), "activity_id")
    top = acts.withColumn("r", F.row_number().over(w)).where(f"r <= {per_type}").orderBy(F.desc("d"), "activity_id").limit(most)
    minutes = F.round(F.col("hours") * 60).cast("long")
    return top.select("activity_id", "d", "type", F.concat(F.floor(minutes / 60), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0")).alias("duration"))


# ---------------------------------------------------------------- training


def weekly(acts: DataFrame, as_of: str, weeks: int) -> DataFrame:
    """Dense Monday weeks with hours, ascent, count and distance; zeros where nothing happened."""
    end = F.trunc(F.to_date(F.lit(as_of)), "week")
    spine = acts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, 7 * (weeks - 1)), end, F.expr("interval 7 days"))).alias("week"))
    sums = acts.groupBy(F.trunc("d", "week").alias("week")).agg(F.count("*").alias("rides"), F.sum("hours").alias("hours"), F.sum(F.coalesce("gain", F.lit(0.0))).alias("gain"), F.sum("km").alias("km"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return spine.join(sums, "week", "left").select("week", zero("rides", 0), zero("hours", 0.0), zero("gain", 0.0), zero("km", 0.0))


def weekly_zones(rides: DataFrame, as_of: str, weeks: int) -> DataFrame:
    """Dense Monday weeks with seconds in each of the five zones, and energy."""
    end = F.trunc(F.to_date(F.lit(as_of)), "week")
    spine = rides.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, 7 * (weeks - 1)), end, F.expr("interval 7 days"))).alias("week"))
    sums = rides.groupBy(F.trunc("d", "week").alias("week")).agg(*(F.sum(F.col("zones")[k]).alias(f"_z{k}") for k in range(5)), F.sum("kcal").alias("kcal"))
    return spine.join(sums, "week", "left").select("week", F.array(*(F.coalesce(f"_z{k}", F.lit(0.0)) for k in range(5))).alias("zones"), F.coalesce("kcal", F.lit(0.0)).alias("kcal"))


def resting_baseline(days: DataFrame, as_of: str, by: str, length: int = 30) -> DataFrame:
    """Upper median of the resting rates known of the last ``length`` days."""
    today = F.to_date(F.lit(as_of))
    last = days.where((F.col("d") > F.date_sub(today, length)) & (F.col("d") <= today))
    return last.groupBy(by).agg(F.collect_list("rhr").alias("_l")).select(by, median_upper(F.col("_l")).alias("baseline"))


def zone_load(zones: Column) -> Column:
    """Load of seconds in five zones: minutes times 0, 1, 2, 3 and 5."""
    weights = F.array(*(F.lit(float(w)) for w in (0, 1, 2, 3, 5)))
    return F.aggregate(F.zip_with(zones, weights, lambda z, w: z / 60 * w), F.lit(0.0), lambda a, x: a + x)


def surrogate_load(duration_s: Column, gain_m: Column, km: Column, met: Column) -> Column:
    """Load without a heart rate: minutes, by the kind's metabolic equivalent and the steepness beyond 30 m a km."""
    steep = F.greatest(F.lit(0.0), F.coalesce(gain_m / F.nullif(km, F.lit(0.0)), F.lit(0.0)) - 30) / 120
    return duration_s / 60 * met / 8.5 * (1 + steep)


def calories(zones: Column, met: Column, weight: Column, hours: Column) -> Column:
    """By the zones' metabolic equivalents (3, 5, 8, 11, 14) if any zone has time, else by the kind's."""
    equivalents = F.array(*(F.lit(float(w)) for w in (3, 5, 8, 11, 14)))
    in_zones = F.aggregate(F.zip_with(zones, equivalents, lambda z, m: z / 3600 * m), F.lit(0.0), lambda a, x: a + x)
    timed = F.aggregate(zones, F.lit(0.0), lambda a, x: a + x) > 0
    return weight * F.when(F.coalesce(timed, F.lit(False)), in_zones).otherwise(met * hours)


def calibration(rides: DataFrame) -> DataFrame:
    """One row: median ratio of zone load to surrogate over rides that have both, else 1."""
    ratio = F.when((F.col("hr_load") > 0) & (F.col("surrogate") > 0), F.col("hr_load") / F.nullif("surrogate", F.lit(0.0)))
    return rides.agg(F.coalesce(F.median(ratio), F.lit(1.0)).alias("k"))


def ride_loads(rides: DataFrame) -> DataFrame:
    """Zone load where there is one, else the calibrated surrogate."""
    return rides.crossJoin(F.broadcast(calibration(rides))).withColumn("load", F.when(F.col("hr_load") > 0, F.col("hr_load")).otherwise(F.col("k") * F.col("surrogate")))


def daily(acts: DataFrame, value: str, as_of: str) -> DataFrame:
    """Dense days from the first activity to ``as_of``, with ``t`` from 0; rest days are zero."""
    first = acts.agg(F.min("d").alias("first"))
    spine = first.select("first", F.explode(F.sequence("first", F.to_date(F.lit(as_of)), F.expr("interval 1 day"))).alias("d"))
    sums = acts.groupBy("d").agg(F.sum(value).alias("v"))
    return spine.join(sums, "d", "left").select("d", F.datediff("d", "first").alias("t"), F.coalesce("v", F.lit(0.0)).alias("v"))


def ewma(days: DataFrame, tau: float, out: str) -> DataFrame:
    """Exponentially weighted mean of dense ``days(t, v)`` with seed 0; a series by days is short, whatever the number of activities.

    Growing weights are summed within spans of 300 time constants, so that they
    stay within a double; a span starts from the last value of the one before.
    """
    rate, size = 1.0 - math.exp(-1.0 / tau), int(300 * tau)
    w = Window.partitionBy("_span").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    p = days.withColumn("_span", F.floor(F.col("t") / size)).withColumn("_at", F.col("t") - F.col("_span") * size)
    p = p.withColumn("_own", F.exp(-F.col("_at") / tau) * F.sum(rate * F.col("v") * F.exp(F.col("_at") / tau)).over(w))
    # what a span leaves of the one before it is below the last place of its own end
    ends = p.groupBy("_span").agg(F.max_by("_own", "t").alias("_end")).withColumn("_span", F.col("_span") + 1)
    carried = F.coalesce("_end", F.lit(0.0)) * F.exp(-(F.col("_at") + 1) / tau)
    return p.join(ends, "_span", "left").withColumn(out, F.col("_own") + carried).drop("_span", "_at", "_own", "_end")


def fitness(days: DataFrame) -> DataFrame:
    """Fitness (42 days), fatigue (7 days), and form: the day before's difference, 0 at first."""
    both = ewma(ewma(days, 42.0, "fitness"), 7.0, "fatigue")
    return both.withColumn("form", F.coalesce(F.lag(F.col("fitness") - F.col("fatigue")).over(Window.orderBy("t")), F.lit(0.0)))


def acute_chronic(days: DataFrame) -> DataFrame:
    """Mean of 7 days over that of 28; null in the first 27 days, or where nothing was done in 28."""
    w = Window.orderBy("t")
    acute, chronic = F.avg("v").over(w.rowsBetween(-6, 0)), F.avg("v").over(w.rowsBetween(-27, 0))
    return days.withColumn("acwr", F.when((F.col("t") >= 27) & (chronic > 0), acute / F.nullif(chronic, F.lit(0.0))))


def monotony(days: DataFrame) -> DataFrame:
    """Mean over population deviation of the last 28 days; null before, or without spread."""
    w = Window.orderBy("t").rowsBetween(-27, 0)
    return days.withColumn("monotony", F.when(F.col("t") >= 27, F.avg("v").over(w) / F.nullif(F.stddev_pop("v").over(w), F.lit(0.0))))


def trend(days: DataFrame, n: int = 4) -> DataFrame:
    """One row: signed change of the mean of the last ``n`` values that aren't null against the mean of up to ``n`` before them, relative to that mean's size.

    Where there are none before, the first value stands for them; fewer than
    two values, or a mean of zero before, have no change.
    """
    r = days.where("v IS NOT NULL").withColumn("r", F.row_number().over(Window.orderBy(F.desc("t"))))
    pick = lambda cond: F.avg(F.when(cond, F.col("v")))
    g = r.agg(F.count("*").alias("n"), pick(F.col("r") <= n).alias("last_n"), F.coalesce(pick((F.col("r") > n) & (F.col("r") <= 2 * n)), F.max_by("v", "r")).alias("before_n"))
    change = (F.col("last_n") - F.col("before_n")) / F.nullif(F.abs("before_n"), F.lit(0.0))
    return g.select("last_n", "before_n", F.when(F.col("n") >= 2, change).alias("change"))


def week_ends(days: DataFrame, value: str) -> DataFrame:
    """Last value of each Monday week."""
    return days.groupBy(F.trunc("d", "week").alias("week")).agg(F.max_by(value, "d").alias(value))


def rolling_weeks(weeks: DataFrame, value: str) -> DataFrame:
    """Means of 4 and 8 weeks."""
    w = Window.orderBy("week")
    return weeks.withColumns({f"{value}_{n}": F.avg(value).over(w.rowsBetween(1 - n, 0)) for n in (4, 8)})


def polarization(low: Column, middle: Column, high: Column) -> list[Column]:
    """Shares of the three zones, null without time."""
    total = F.nullif(low + middle + high, F.lit(0.0))
    return [(low / total).alias("low"), (middle / total).alias("middle"), (high / total).alias("high")]


def _votes(*signals: tuple[Column, Column]) -> Column:
    """Sum of the signals' signs: 1 where the first condition holds, -1 where the second does."""
    return sum((F.when(up, 1).when(down, -1).otherwise(0) for up, down in signals), F.lit(0))


# The verdicts' words and bounds.


def fitness_verdict(resting_change: Column, easy_change: Column, fitness_change: Column) -> Column:
    """Rising or falling by the sum of three signs: resting rate and rate at easy effort count down, fitness up; unknown without any."""
    none = F.coalesce(resting_change, easy_change, fitness_change).isNull()
    score = _votes((resting_change < -0.02, resting_change > 0.02), (easy_change < -0.02, easy_change > 0.02), (fitness_change > 0.05, fitness_change < -0.05))
    return F.when(none, "unknown").when(score >= 1, "rising").when(score <= -1, "falling").otherwise("steady")


def readiness_verdict(reserve: Column, resting: Column, baseline: Column, sleep_h: Column, form: Column) -> Column:
    """By how many of four signals are fresh and how many tired: two of the one kind, and more of it than of the other, decide."""
    known = baseline.isNotNull() & (baseline != 0)
    fresh = [reserve >= 60, known & (resting <= baseline - 1), sleep_h >= 7.5, form > 1]
    tired = [reserve < 25, known & (resting >= baseline + 5), sleep_h < 6, form < -1]
    n_fresh, n_tired = (sum((F.when(c, 1).otherwise(0) for c in cs), F.lit(0)) for cs in (fresh, tired))
    none = reserve.isNull() & (resting.isNull() | ~known) & sleep_h.isNull() & form.isNull()
    return F.when(none, "unknown").when((n_tired >= 2) & (n_tired > n_fresh), "easy").when((n_fresh >= 2) & (n_fresh > n_tired), "go_hard").otherwise("steady")


def load_verdict(acwr: Column) -> Column:
    return F.when(acwr.isNull(), "unknown").when(acwr > 1.5, "ramping_hard").when(acwr >= 0.8, "safe").otherwise("detraining")


def mix_verdict(hard: Column) -> Column:
    """By the share of hard time."""
    return F.when(hard.isNull(), "unknown").when(hard > 0.25, "too_hard").when(hard < 0.08, "too_easy").otherwise("balanced")


def difficulty(km: Column, gain: Column, loss: Column, descent: Column) -> Column:
    """Whole score, at least 1, null without distance; of a climb or, for lift-assisted sports, of a descent.

    A climb counts 55 m of ascent as a km and grows with steepness beyond 30 m
    a km; a descent counts km alone and grows beyond 90 m a km.
    """
    gain, loss = F.coalesce(gain, F.lit(0.0)), F.coalesce(loss, F.lit(0.0))
    per = lambda m: m / F.nullif(km, F.lit(0.0))
    base = lambda x: F.pow(x, F.lit(0.83)) / 3.2
    up = base(km + gain / 55) * (1 + F.greatest(F.lit(0.0), per(gain) - 30) / 60)
    down = base(km) * (1 + F.greatest(F.lit(0.0), per(loss) - 90) / 90)
    return F.when(km > 0, F.greatest(F.lit(1.0), F.rint(F.when(descent, down).otherwise(up))).cast("int"))


# ---------------------------------------------------------------- filters


def log_query(acts: DataFrame, types: list[str] | None = None, since: str | None = None, until: str | None = None, assisted: bool | None = None, region: object = None, issues_only: bool = False, flagged_only: bool = False) -> DataFrame:
    """Activities by type, dates, assistance, region (``"unassigned"``: of none), issues and flags; a filter that isn't given doesn't hold any back."""
    if types is not None:
        acts = acts.where(F.col("type").isin(types))
    if since is not None:
        acts = acts.where(F.col("d") >= F.to_date(F.lit(since)))
    if until is not None:
        acts = acts.where(F.col("d") <= F.to_date(F.lit(until)))
    if assisted is not None:
        acts = acts.where(F.col("assisted") == assisted)
    if region is not None:
        acts = acts.where(F.size("regions") == 0 if region == "unassigned" else F.array_contains("regions", F.lit(region)))
    if issues_only:
        acts = acts.where("has_issues")
    if flagged_only:
        acts = acts.where("flagged")
    return acts


def _by_region(acts: DataFrame, regions: DataFrame) -> DataFrame:
    """Activities' regions in their order, with what is known of them."""
    return acts.select("activity_id", "d", F.posexplode("regions").alias("pos", "region_id")).join(regions, "region_id")


def types_by_region(acts: DataFrame, regions: DataFrame) -> DataFrame:
    """``effective``: the explicit type, else that of the first region that has one, in its winter months its winter type first; else empty."""
    winter = F.when(F.array_contains("winter_months", F.month("d")), F.nullif("winter_default_type", F.lit("")))
    t = _by_region(acts, regions).withColumn("t", F.coalesce(winter, F.nullif("default_type", F.lit("")))).where("t IS NOT NULL")
    first = t.groupBy("activity_id").agg(F.min_by("t", "pos").alias("t"))
    return acts.join(first, "activity_id", "left").withColumn("effective", F.coalesce(F.nullif("explicit", F.lit("")), "t", F.lit(""))).drop("t")


def assisted_by_region(acts: DataFrame, regions: DataFrame) -> DataFrame:
    """``effective``: the explicit flag, else whether any region is assisted."""
    r = regions.withColumnRenamed("assisted", "_lifts")
    known = _by_region(acts, r).groupBy("activity_id").agg(F.bool_or("_lifts").alias("_any"))
    return acts.join(known, "activity_id", "left").withColumn("effective", F.coalesce("explicit", "_any", F.lit(False))).drop("_any")


def with_pins(acts: DataFrame, known: DataFrame) -> DataFrame:
    """``regions``: the matched ones, then the pinned ones that exist, each once, in their order; ``known`` is one row with all regions' ids."""
    both = acts.crossJoin(F.broadcast(known))  # one row
    matched = F.coalesce("matched", F.array().cast("array<bigint>"))
    return both.withColumn("regions", F.array_distinct(F.concat(matched, F.filter("pinned", lambda p: F.array_contains("known", p))))).drop("known")


def clamp_days(days: int) -> int:
    return max(1, min(3650, days))


def effective_type(explicit: Column, winter_month: Column, winter: Column, default: Column) -> Column:
    """The explicit type, else the season's of the region, else the region's."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(winter_month, F.nullif(winter, F.lit(""))), default, F.lit(""))
