from __future__ import annotations

import numpy as np
import pytest

from wayfold.operators import kernels as K
from wayfold.operators import reports
from wayfold.operators import tracks as T
from wayfold.operators.route_scan import Automaton, _close, _satisfied


def legs(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "activity_id long, seq long, dt double, dist double, ele_delta double, speed double")


def flags(df):
    return [tuple(r)[2:] for r in K.detect(df).orderBy("seq").collect()]


NAMES = list(K.DETECTORS)


def test_lift_day_and_descent(spark):
    up, down = [(1.0, 4.2, 8.0, 15.0)] * 120, [(1.0, 5.5, -5.0, 20.0)] * 100
    got = flags(legs(spark, [(0.0, 0.0, 0.0, None), *up, *down]))
    lift = [g[NAMES.index("lift")] for g in got]
    assert sum(lift[:121]) > 100 and sum(lift[150:]) == 0
    assert not any(any(g) for g in flags(legs(spark, [(1.0, 5.0, -4.0, 18.0)] * 200)))


def test_time_gap(spark):
    rows = [(1.0, 3.0, 0.0, 10.0)] * 200 + [(300.0, 50.0, 150.0, 0.6)] + [(1.0, 3.0, -2.0, 10.0)] * 200
    got = [i for i, g in enumerate(flags(legs(spark, rows))) if g[NAMES.index("time_gap")]]
    assert got == [200]


def test_detection_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(a, i, 1.0 + rng.random(), 4 * rng.random(), rng.normal(0.3, 1), 15 * rng.random()) for a in range(6) for i in range(150)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, s double, dt double, dist double, ele_delta double, speed double").selectExpr("CAST(a AS LONG) activity_id", "CAST(s AS LONG) seq", "dt", "dist", "ele_delta", "speed")
    key = lambda d: sorted(map(tuple, K.detect(d).collect()))
    assert key(df.repartition(1)) == key(df.repartition(5))


def test_splits_share_their_turning_point():
    there_and_back = np.concatenate([np.linspace(0, 1, 50), np.linspace(1, 0, 50)[1:]])
    assert K._split_linear(there_and_back) == [(0, 50, True), (49, 99, False)]
    assert K._split_linear(np.linspace(0, 1, 30)) == [(0, 30, True)] and K._split_linear(np.linspace(1, 0, 30)) == [(0, 30, False)]
    assert K._split_linear(np.array([0.5, 0.55, 0.45, 0.52, 0.5])) == [(0, 5, True)]
    zigzag = np.concatenate([np.linspace(0, 1, 20), np.linspace(1, 0.5, 10)[1:], np.linspace(0.5, 1, 10)[1:]])
    assert K._split_linear(zigzag) == [(0, 20, True), (19, 29, False), (28, 38, True)]


def test_a_turn_lies_where_the_steady_return_began():
    # a wobble after the peak: the return that is noticed at 0.7 began at the second, lower peak
    x = np.array([0.0, 0.5, 1.0, 0.9, 0.95, 0.85, 0.7, 0.4, 0.0])
    assert K._split_linear(x) == [(0, 5, True), (4, 9, False)]
    # a plateau: its last point, from which it falls
    assert K._split_linear(np.array([0.0, 0.5, 1.0, 1.0, 0.9, 0.75, 0.5])) == [(0, 4, True), (3, 7, False)]
    # a slow fall and a rise: the fall is short of a turn in one step, so the rise is first, and the fall before it a turn of its own
    assert K._split_linear(np.array([1.0, 0.9, 0.8, 0.7, 0.6, 0.9, 1.0])) == [(0, 1, True), (0, 5, False), (4, 7, True)]
    assert K._split_linear(np.array([0.1, 0.5, 0.1])) == [(0, 3, True)]


def test_laps_keep_a_rest_of_an_eighth_and_drop_less():
    laps = lambda turns: K._split_loop(np.linspace(0, turns * 2 * np.pi, 401))
    assert [p[2] for p in laps(2.05)] == [True, True] and [p[2] for p in laps(-2.2)] == [False, False, False]
    one, two = laps(2.05)
    assert one[1] - 1 == two[0] and two[1] < 401
    assert laps(0.05) == [(0, 401, True)]


def test_short_parts_go_to_the_longer_neighbour():
    assert K._fold_short([(0, 20, True), (19, 22, False), (21, 60, True)], 8) == [(0, 20, True), (19, 60, True)]
    assert K._fold_short([(0, 20, True), (19, 22, False)], 8) == [(0, 22, True)]
    assert K._fold_short([(0, 3, True), (2, 22, False)], 8) == [(0, 22, False)]


def test_medians_at_the_ends():
    x = np.random.default_rng(4).random(30)
    want = [sorted(x[max(0, i - 4) : i + 5])[len(x[max(0, i - 4) : i + 5]) // 2] for i in range(30)]
    assert K._median(x, 9).tolist() == want and K._median(x[:2], 9).tolist() == x[:2].tolist()


def test_runs_are_coalesced(spark):
    rows = [(1, "A", 0, 100, 1.0), (1, "A", 200, 300, 1.0), (1, "B", 310, 370, 0.1), (1, "A", 380, 500, 1.0), (1, "A", 700, 800, 1.0)]
    df = spark.createDataFrame(rows, "activity_id long, name string, start_t long, end_t long, ridden_km double")
    got = [(r.name, r.start_t, r.end_t, r.ridden_km) for r in K.coalesce_runs(df).orderBy("start_t").collect()]
    assert got == [("A", 0, 500, 3.0), ("A", 700, 800, 1.0)]


def test_a_detour_goes_whatever_the_gap_but_not_if_it_is_long(spark):
    merged = lambda rows: [(r.name, r.start_t, r.end_t) for r in K.coalesce_runs(spark.createDataFrame([(1, *r, 1.0) for r in rows], "activity_id long, name string, start_t long, end_t long, ridden_km double")).orderBy("start_t").collect()]
    assert merged([("A", 0, 100), ("B", 900, 950), ("A", 2000, 2100)]) == [("A", 0, 2100)]
    assert merged([("A", 0, 100), ("B", 110, 200), ("A", 210, 300)]) == [("A", 0, 100), ("B", 110, 200), ("A", 210, 300)]
    assert merged([("A", 0, 100), ("B", 110, 130), ("B", 140, 150), ("A", 160, 300)]) == [("A", 0, 100), ("B", 110, 150), ("A", 160, 300)]


ROUTE = [{"pos": k, "name": n, "kind": "trail", "vertices": 4} for k, n in enumerate("ABC")]
WHOLE = {(k, "own"): (True, True, ()) for k in range(3)}


def entries(*names, marks=WHOLE, noise=(), gap=10, pause=60):
    return [{"name": n, "kind": "trail", "start_idx": k * (50 + gap), "end_idx": k * (50 + gap) + 50, "start_t": k * (100 + pause), "end_t": k * (100 + pause) + 100, "noise": k in noise, "marks": marks} for k, n in enumerate(names)]


def found_in(rows, route):
    return [(a, z) for _, a, z in Automaton([(7, route)]).attempts(rows)]


def test_route_attempts():
    assert found_in(entries(*"ABC"), ROUTE) == [(0, 2)]
    assert found_in(entries(*"ABCABC"), ROUTE) == [(0, 2), (3, 5)]
    assert found_in(entries(*"AxBC"), ROUTE) == []
    assert found_in(entries(*"AxBC", noise={1}), ROUTE) == [(0, 3)]
    assert found_in(entries(*"AABC"), ROUTE) == [(0, 3)]  # leftover of the first trail right after its match
    assert found_in(entries(*"AABC", pause=1000), ROUTE) == [(1, 3)]  # hours apart: starts over
    assert found_in(entries(*"ABxABC"), ROUTE) == [(3, 5)]
    assert found_in(entries(*"BC"), ROUTE) == []


def test_segments_need_a_touch_of_both_ends_or_cover():
    nothing = {(k, "own"): (True, False, ()) for k in range(3)}
    assert found_in(entries(*"ABC", marks=nothing), ROUTE) == []
    followed = {(k, "own"): (False, False, (0, 1, 2)) for k in range(3)}
    assert found_in(entries(*"ABC", marks=followed), ROUTE) == [(0, 2)]
    # two fragments of one trail touch an end each; a touch between them counts as well
    rows = entries(*"AABC")
    rows[0]["marks"], rows[1]["marks"] = {(0, "own"): (True, False, ())}, {(0, "own"): (False, True, ())}
    assert found_in(rows, ROUTE) == [(0, 3)]
    rows[1]["marks"] = {(0, "gap"): (False, True, ())}
    assert found_in(rows, ROUTE) == [(0, 3)]
    rows[1]["start_t"] += 2000
    assert found_in(rows, ROUTE) == []


def test_clusters_do_not_chain_and_equal_one_by_one(spark):
    from wayfold.operators.overview import clusters_of_rides

    def found(pairs, n, least):
        df = spark.createDataFrame(pairs, "a long, b long, score double")
        return {r.v: r.cluster for r in clusters_of_rides(df, spark.range(n).withColumnRenamed("id", "v"), least).collect()}

    assert found([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.85)], 5, 0.5) == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3}
    rng = np.random.default_rng(7)
    pairs = [(i, j, float(s)) for i in range(14) for j in range(i + 1, 14) if (s := rng.random()) > 0.3]
    groups = [{v} for v in range(14)]
    score = {frozenset(p[:2]): p[2] for p in pairs}
    far = lambda x, y: min(score.get(frozenset((i, j)), -1.0) for i in x for j in y)
    while True:
        best = max(((far(x, y), x, y) for k, x in enumerate(groups) for y in groups[k + 1 :]), key=lambda t: t[0])
        if best[0] < 0.4:
            break
        groups = [g for g in groups if g is not best[1] and g is not best[2]] + [best[1] | best[2]]
    assert found(pairs, 14, 0.4) == {v: min(g) for g in groups for v in g}


def test_chains(spark):
    w = spark.createDataFrame([("A", 0, 0.0, 0.0, 10.0, 0.0), ("A", 1, 50.0, 0.0, 60.0, 0.0), ("A", 2, 20.0, 0.0, 12.0, 0.0)], "name string, way_pos long, ax double, ay double, bx double, by double")
    groups = spark.createDataFrame([(0, 0), (2, 0), (1, 1)], "way_pos long, c long")
    assert {(r.way_pos, r.chain, r.place, r.back) for r in K.chains(w, groups).collect()} == {(0, 0, 0, False), (2, 0, 1, True), (1, 1, 0, False)}


def test_leaders_equal_one_by_one(spark):
    from wayfold.operators.network import leaders

    rng = np.random.default_rng(9)
    lat, lon = 50 + rng.random(300) * 0.004, -116 + rng.random(300) * 0.004
    metres = lambda i, j: 6371000 * np.hypot(np.radians(lat[i] - lat[j]), np.radians(lon[i] - lon[j]) * np.cos(np.radians(50.002)))
    lead, want = [], {}
    for i in range(300):
        want[i] = next((k for k in lead if metres(i, k) <= 25), i)
        if want[i] == i:
            lead.append(i)
    got = {r.id: r.leader for r in leaders(spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon, strict=True))], "id long, lat double, lon double"), 25.0).collect()}
    assert got == want


def test_training_values(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    zones = F.array(*(F.lit(600.0) for _ in range(5)))
    r = one.select(reports.zone_load(zones).alias("z"), reports.surrogate_load(F.lit(3600.0), F.lit(300.0), F.lit(10.0), F.lit(8.5)).alias("a"), reports.surrogate_load(F.lit(3600.0), F.lit(600.0), F.lit(10.0), F.lit(8.5)).alias("b")).first()
    assert (r.z, r.a, r.b) == (pytest.approx(110), pytest.approx(60), pytest.approx(75))
    k = spark.createDataFrame([(110.0, 55.0), (100.0, 50.0), (90.0, 30.0)], "hr_load double, surrogate double")
    assert reports.calibration(k).first().k == 2.0 and reports.calibration(k.where("false")).first().k == 1.0
    assert reports.clamp_days(0) == 1 and reports.clamp_days(9999) == 3650


def test_streaks(spark):
    rows = [("x", d) for d in ("2001-07-29", "2001-07-30", "2001-07-31")] + [("y", "2001-07-29"), ("y", "2001-07-29")]
    a = spark.createDataFrame(rows, "type string, d string").selectExpr("type", "to_date(d) d")
    assert {r.type: (r.longest, r.current) for r in reports.streaks(a, "2001-08-01").collect()} == {"x": (3, 3), "y": (1, 0)}


def test_spikes_need_a_long_track_and_no_lift(spark):
    def track(n, jump, lift=()):
        rows = [(1, i, 10.0, (60.0 if i == jump else 10.0) / 0.36, i in lift) for i in range(n)]
        return T.spikes(spark.createDataFrame(rows, "activity_id long, seq long, dt double, dist double, assisted boolean"))

    hits = lambda df: [r.seq for r in df.where("spike").collect()]
    assert hits(track(60, 30)) == [30] and hits(track(20, 10)) == [] and hits(track(60, 30, {30})) == [] and hits(track(60, 30, {29})) == []


def test_trim_is_a_no_op_where_it_must_be(spark):
    p = spark.createDataFrame([(1, i, i / 10) for i in range(10)], "activity_id long, seq long, dist_km double")
    assert T.trimmed(p, 0.7, 0.3).count() == 10
    rows = T.trimmed(p, 0.3, 0.7).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2, 3, 4] and rows[0].dist_km == 0


def plain_flags(name, dt, dz, dist, speed, lat, lon):
    """Detectors point by point, as they are described: windows from each point on, and what is accepted is passed over."""
    n, out, i = len(dt), np.zeros(len(dt), bool), 1
    valid = [k for k in range(n) if not np.isnan(speed[k]) and 0 < dt[k] < 5]

    def reach(a, seconds):
        k = a
        while k < n and sum(dt[a:k]) < seconds:
            k += 1
        return k

    def mean(a, b, fit):
        v = [speed[k] for k in range(a, b) if k in fit]
        return sum(v) / len(v) if v else None

    valid, any_speed = set(valid), {k for k in range(n) if not np.isnan(speed[k])}
    while i < n:
        end = None
        if name.startswith("elevation_rate"):
            rate, gain = (15.0, 40.0) if name.endswith("high") else (5.0, 25.0)
            j = reach(i, 60)
            secs, up = sum(dt[i:j]), sum(dz[i:j])
            if secs > 0 and up >= gain and up / secs * 60 >= rate:
                while j < n and (k := reach(j, 30)) > j and sum(dt[j:k]) > 0 and sum(dz[j:k]) / sum(dt[j:k]) * 60 >= rate / 2:
                    j = k
                end = j if sum(dt[i:j]) >= 60 else None
        elif name == "speed_sinuosity":
            j = min(i + 60, n)
            if len(valid & set(range(i, j))) >= 30 and sum(dz[i:j]) >= 25 and 6 < mean(i, j, valid) < 25:
                while j < n and (m := mean(max(i, j - 20), j, valid)) is not None and 6 < m < 25:
                    j += 1
                v = [speed[k] for k in range(i, j) if k in valid]
                straight = K._metres(lat[i], lon[i], lat[j - 1], lon[j - 1])
                winds = sum(dist[i:j]) / straight if straight > 1 else 1.0
                if sum(dz[i:j]) >= 40 and sum(dt[i:j]) >= 90 and (np.std(v, ddof=1) < 13 or winds <= 1.15):
                    end = j
        else:
            j = reach(i, 90)
            m = mean(i, j, any_speed)
            if sum(dt[i:j]) >= 45 and sum(dz[i:j]) >= 50 and m is not None and m >= 20:
                while j < n and (m := mean(max(i, j - 30), j, any_speed)) is not None and m >= 20 and sum(dz[max(i, j - 30) : j]) >= 0:
                    j += 1
                end = j
        if end is None:
            i += 1
        else:
            out[i:end] = True
            i = end
    return out


@pytest.mark.parametrize("name", ["elevation_rate", "elevation_rate_high", "speed_sinuosity", "shuttle"])
def test_detectors_equal_plain_ones(name):
    rng, hits = np.random.default_rng(21), 0
    for _ in range(25):
        n = int(rng.integers(20, 260))
        kind = np.repeat(rng.integers(0, 3, n), rng.integers(10, 60, n))[:n]
        dt = rng.integers(1, 5, n).astype(float)
        speed = np.where(kind == 0, rng.normal(12, 3, n), np.where(kind == 1, rng.normal(32, 6, n), rng.normal(8, 6, n))).clip(0.5)
        dz = np.where(kind < 2, rng.normal(1.5, 0.8, n), rng.normal(-0.5, 1, n))
        dz, speed = np.round(dz * 8) / 8, np.round(speed * 8) / 8  # so that sums are exact
        dist = speed / 3.6 * dt
        lat = 50 + np.cumsum(dist * rng.choice([1.0, 0.7], n)) * 1e-5
        speed[rng.random(n) < 0.1] = np.nan
        lon = np.full(n, -116.0)
        want = plain_flags(name, dt, dz, dist, speed, lat, lon)
        got = K.DETECTORS[name](dt, dist, dz, speed, lat, lon)
        assert got.tolist() == want.tolist()
        hits += want.sum()
    assert hits > 100
