"""Detectors against hand-made tracks: ends of a track, straightness, net gain, snapping, trimming, station rides."""

from __future__ import annotations

import numpy as np

from wayfold.operators import kernels as K
from wayfold.operators import lifts as L

M = 1 / 111194.9  # degrees of latitude in a metre


def track(spark, rows):
    """Points of (dt, metres north, ele_delta, speed) each, from 50 degrees north."""
    out, t, y = [], 0.0, 0.0
    for i, (dt, dy, dz, v) in enumerate(rows):
        t, y = t + dt, y + dy
        out.append((1, i, t, float(dt), abs(float(dy)), float(dz), None if v is None else float(v), 50.0 + y * M, -116.0, None))
    return spark.createDataFrame(out, "activity_id long, seq long, t_s double, dt double, dist double, ele_delta double, speed double, lat double, lon double, ele double")


def lift(spark, *rows):
    return spark.createDataFrame([(k, 50.0 + a * M, -116.0, 50.0 + b * M, -116.0) for k, a, b in rows], "lift long, alat double, alon double, blat double, blon double")


def on(df):
    return sorted(r.seq for r in df.collect())


START = (0.0, 0.0, 0.0, None)


def test_straight_climbs_of_uneven_speed_count():
    n = 200
    dt, dz, speed = np.ones(n), np.full(n, 0.5), np.where(np.arange(n) % 2, 2.0, 31.0)
    dist, lat = np.full(n, 4.0), 50 + np.arange(n) * 4 * M
    winding = 50 + np.arange(n) * 2 * M
    assert K.steady(dt, dist, dz, speed, lat, np.full(n, -116.0))[1:].all()
    assert not K.steady(dt, dist, dz, speed, winding, np.full(n, -116.0)).any()
    assert not K.steady(dt, dist, dz, speed, np.full(n, np.nan), np.full(n, np.nan)).any()


def test_windows_may_end_with_the_track():
    n = 46
    dt = np.full(n, 3.0)
    assert K.steady(dt, np.full(n, 9.0), np.ones(n), np.full(n, 11.0), np.full(n, np.nan), np.full(n, np.nan))[1:].all()
    assert K.shuttle(np.full(61, 1.0), np.ones(61), np.full(61, 30.0))[1:].all()
    assert not K.shuttle(np.full(41, 1.0), np.full(41, 2.0), np.full(41, 30.0)).any()


def test_segments_begin_with_the_point_before():
    assert K.flagged_segments(np.array([0, 0, 1, 1, 0, 1], bool)) == [(1, 3), (4, 5)]
    assert K.flagged_segments(np.array([1, 1, 0, 0], bool)) == [(0, 1)]
    assert K.flagged_segments(np.zeros(3, bool)) == [] and K.flagged_segments(np.zeros(1, bool)) == []


def test_lift_needs_net_gain_and_snaps_or_trims(spark):
    flat = [(1.0, 3.0, -1.0, 10.0)] * 100
    low = track(spark, [START, *flat, *[(1.0, 4.0, 0.43, 14.0)] * 100, *flat])
    assert any(r.elevation_rate for r in K.detect(low, ["elevation_rate"]).collect())
    assert on(L.detected(low, lift(spark), ["lift"])) == []
    up = [(1.0, 4.0, 1.0, 14.0)] * 200
    rows = [START, *flat, *up, *flat]
    rows[110] = (1.0, 4.0, 1.0, 1.0)
    high = track(spark, rows)
    got = on(L.detected(high, lift(spark), ["lift"]))
    assert got[0] == 110 and got == list(range(got[0], got[-1] + 1))
    # the lift goes from point 90 to point 310: 270 m and 1130 m north
    snapped = on(L.detected(high, lift(spark, (7, 270, 1130)), ["lift"]))
    assert snapped == list(range(90, 311))


def test_station_rides_start_first_and_sum_deltas(spark):
    # waits for 50 s near the bottom, then rides 80 s; last bottom and first top points are 40 s apart
    rows = [START, *[(10.0, 1.0, 0.0, 1.0)] * 5, *[(10.0, 75.0, 20.0, 27.0)] * 8, *[(10.0, 1.0, 0.0, 1.0)] * 3]
    t = track(spark, rows)
    assert on(L.station_flags(t, lift(spark, (7, 0, 605)))) == list(range(0, 13))
    # those two are neighbours here; 200 m up between them, of which one delta is unknown
    assert on(L.station_flags(t, lift(spark, (7, 605, 0)))) == list(range(0, 13))
    assert on(L.station_flags(t, lift(spark, (7, 0, 605)), gain=200.0)) == []
    assert on(L.detected(t, lift(spark, (7, 0, 605)), ["osm"])) == list(range(0, 13))
    assert on(L.detected(t, lift(spark, (7, 0, 605)), ["bike"]))


def test_rides_between_pair_first_points():
    def rides(rows, **k):
        import pandas as pd

        class One:
            def groupBy(self, *a):
                return self

            def applyInPandas(self, f, schema):
                return f(pd.DataFrame(rows, columns=["activity_id", "lift", "seq", "t_s", "up", "stop"]))

        return K.rides_between(One(), **k)[["start", "end"]].values.tolist()

    wait = [(1, 7, 0, 0, 0.0, "a"), (1, 7, 1, 50, 0.0, "a"), (1, 7, 2, 90, 60.0, "b")]
    assert rides(wait) == [[0, 2]]
    assert rides([*wait, (1, 7, 3, 100, 60.0, "a"), (1, 7, 4, 200, 120.0, "b")]) == [[0, 2], [3, 4]]
    assert rides([(1, 7, 0, 0, 0.0, "a"), (1, 7, 1, 2000, 90.0, "b")]) == []


def test_both_ends_are_trimmed_to_cable_speed(spark):
    from wayfold.operators import lifts

    speed = [1.0] * 3 + [None, 7.0] + [9.0] * 10 + [6.0, 5.9, 2.0, 1.0, 0.0]
    p = spark.createDataFrame([(1, k, v) for k, v in enumerate(speed)] + [(2, k, 1.0) for k in range(20)], "activity_id long, seq long, speed double")
    spans = spark.createDataFrame([(1, 0, 19), (2, 3, 15)], "activity_id long, start long, end long")
    # a quarter of 19 points is 4: the head 0 to 3 has none of 6 km/h, the tail 16 to 19 neither
    rows = {(r.activity_id, r["from"], r["to"]) for r in lifts.trimmed_to_cable_speed(p, spans).collect()}
    assert rows == {(1, 0, 19), (2, 3, 15)}
    spans = spark.createDataFrame([(1, 1, 18)], "activity_id long, start long, end long")
    assert [(r["from"], r["to"]) for r in lifts.trimmed_to_cable_speed(p, spans).collect()] == [(4, 15)]
