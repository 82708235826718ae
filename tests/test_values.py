"""Operators against values computed by hand, and snapping against every pair."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import network, reports, routes, spatial
from wayfold.operators import overview as O
from wayfold.operators import tracks as T


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_difficulty(spark):
    climbs = {(5, 50): 1, (10, 100): 2, (19, 400): 5, (18, 868): 8, (30, 1000): 8, (50, 2000): 15, (10, 1000): 11, (80, 3000): 21}
    descents = {(16, 1450): 3, (37, 4600): 9, (44, 5650): 10, (35, 6750): 13}
    score = lambda km, m, down: reports.difficulty(F.lit(float(km)), F.lit(float(m)), F.lit(float(m)), F.lit(down))
    r = one(spark, **{f"c{i}": score(*k, False) for i, k in enumerate(climbs)}, **{f"d{i}": score(*k, True) for i, k in enumerate(descents)}, none=reports.difficulty(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(False)))
    assert [r[f"c{i}"] for i in range(len(climbs))] == list(climbs.values())
    assert [r[f"d{i}"] for i in range(len(descents))] == list(descents.values()) and r.none is None


def test_verdicts(spark):
    c = lambda v: F.lit(None).cast("double") if v is None else F.lit(float(v))
    load = {None: "unknown", 1.51: "ramping_hard", 1.5: "safe", 0.8: "safe", 0.79: "detraining"}
    mix = {None: "unknown", 0.26: "too_hard", 0.25: "balanced", 0.08: "balanced", 0.07: "too_easy"}
    fit = {(None, None, None): "unknown", (-0.03, None, None): "rising", (-0.03, 0.03, 0.0): "steady", (0.03, 0.03, 0.06): "falling", (-0.02, 0.02, 0.05): "steady"}
    ready = {(None,) * 5: "unknown", (20, 60, 53, None, None): "easy", (70, 51, 53, 8, 0): "go_hard", (20, 51, 53, 8, -2): "steady", (40, None, None, None, None): "steady"}
    r = one(spark, **{f"l{i}": reports.load_verdict(c(k)) for i, k in enumerate(load)}, **{f"m{i}": reports.mix_verdict(c(k)) for i, k in enumerate(mix)}, **{f"f{i}": reports.fitness_verdict(*map(c, k)) for i, k in enumerate(fit)}, **{f"r{i}": reports.readiness_verdict(*map(c, k)) for i, k in enumerate(ready)})
    for tag, want in (("l", load), ("m", mix), ("f", fit), ("r", ready)):
        assert [r[f"{tag}{i}"] for i in range(len(want))] == list(want.values())


@pytest.mark.parametrize("values,change", [([1.0], None), ([2.0, 1.0], -0.25), ([1.0] * 4 + [2.0] * 4, 1.0), ([4.0, 1.0, 1.0, 1.0, 1.0], -0.75), ([0.0, 1.0], None), ([-2.0] * 4 + [-1.0] * 4, 0.5), ([9.0, None, 1.0, None], (5.0 - 9.0) / 9.0)])
def test_trend(spark, values, change):
    df = spark.createDataFrame(list(enumerate(values)), "t int, v double")
    got = reports.trend(df, 4).first().change
    assert got is None if change is None else got == pytest.approx(change)


def test_weighted_means_last_for_decades(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(20 * 365) < 0.4, rng.random(20 * 365) * 100, 0.0)
    days = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "t int, v double")
    got = {r.t: (r.fitness, r.fatigue) for r in reports.fitness(days).collect()}
    want = [0.0, 0.0]
    for i, x in enumerate(v):
        want = [s + (x - s) * (1 - math.exp(-1 / tau)) for s, tau in zip(want, (42, 7), strict=True)]
        assert got[i] == pytest.approx(tuple(want), rel=1e-9, abs=1e-12)


def test_distance_from_nowhere_is_null(spark):
    nowhere = F.lit(None).cast("double")
    r = one(spark, a=geo.haversine(nowhere, F.lit(1.0), F.lit(2.0), F.lit(3.0)), b=geo.haversine_of_differences(F.lit(2.0), F.lit(1.0), F.lit(2.0), nowhere))
    assert r.a is None and r.b is None
    p = spark.createDataFrame([(1, 0, 0, 50.0, 0.0, 1.0), (1, 1, 5, 50.001, 0.0, 2.0)], "activity_id long, seq long, t_s long, lat double, lon double, ele double")
    assert [r.dist for r in T.legs(p).orderBy("seq").collect()] == [0.0, pytest.approx(111.19, abs=0.01)]


@pytest.mark.parametrize("north", [0.0, 50.0, 68.0, -80.0])
def test_snapping_equals_all_pairs(spark, north):
    rng = np.random.default_rng(11)
    k = math.cos(math.radians(north))
    at = lambda n: np.stack([north + rng.random(n) * 0.01, -116 + rng.random(n) * 0.01 / k], 1)
    p, a = at(400), at(60)
    b = np.where(rng.random((60, 1)) < 0.2, a, at(60))
    b[::7, 0] = a[::7, 0]  # along a parallel
    points = spark.createDataFrame([(1, i, float(x), float(y), False) for i, (x, y) in enumerate(p)], "activity_id long, seq long, lat double, lon double, assisted boolean")
    ways = spark.createDataFrame([(j, f"n{j}", 0, *map(float, (*a[j], *b[j]))) for j in range(60)], "way_pos long, name string, i long, alat double, alon double, blat double, blon double")
    m = math.pi * 6371000 / 180
    want = {}
    for i, (lat, lon) in enumerate(p):
        c = math.cos(math.radians(lat))
        s, e = (a - (lat, lon)) * (m, m * c), (b - (lat, lon)) * (m, m * c)
        d = e - s
        size = (d**2).sum(1)
        t = np.where(size > 0, np.clip(-(s * d).sum(1) / np.where(size > 0, size, 1), 0, 1), 0)
        far = np.hypot(*(s + t[:, None] * d).T)
        if far.min() < 40:
            want[i] = (f"n{far.argmin()}", far.min())
    got = {r.seq: (r.name, r.d) for r in spatial.snap(points, ways, 40.0).where("name IS NOT NULL").collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)


def test_pairs_of_a_point_stay_near_it(spark):
    """What a point meets on its cell doesn't grow with the lengths of ways elsewhere."""
    rng = np.random.default_rng(12)
    points = spark.createDataFrame([(i, 50 + float(x), -116 + float(y)) for i, (x, y) in enumerate(rng.random((500, 2)) * 0.05)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(j, *(50 + float(v[0]), -116 + float(v[1]), 50 + float(v[2]), -116 + float(v[3]))) for j, v in enumerate(rng.random((300, 4)) * 0.05)], "j long, alat double, alon double, blat double, blon double")
    pairs = spatial.segment_pairs(points, ways, 8.0)
    assert pairs.where("d <= 8").count() <= pairs.count() <= 1.2 * pairs.where("d <= 8").count() + 5
    # registered along its course a way has about as many cells as it has length
    cells = spatial.registered(ways, 8.0).count()
    assert cells < 300 * 6 * 0.05 * 111195 / 16


def test_completion_by_both_ends(spark):
    c = lambda cov, both: spatial.completion(F.lit(cov), F.lit(both))
    cases = {(90.0, False): (True, False), (70.0, True): (True, True), (70.0, False): (False, False), (59.0, True): (False, False), (85.0, True): (True, False)}
    r = one(spark, **{f"x{i}": F.struct(*(v.alias(f"f{j}") for j, v in enumerate(c(*k)))) for i, k in enumerate(cases)})
    assert [tuple(r[f"x{i}"]) for i in range(len(cases))] == list(cases.values())


def test_edges_of_a_preview_are_turned_and_joined(spark):
    d = 1 / 111195
    parts = [(1, 0, 0.0, 100.0), (1, 1, 200.0, 101.0), (1, 2, 230.0, 300.0), (1, 3, 900.0, 1000.0)]
    df = spark.createDataFrame([(r, p, a * d, 0.0, b * d, 0.0) for r, p, a, b in parts], "route_id long, pos long, alat double, alon double, blat double, blon double")
    got = [(r.back, r.joint) for r in routes.sewn(df).orderBy("pos").collect()]
    assert got == [(False, "joined"), (True, "joined"), (False, "bridged"), (False, "gap")]


def test_loops_and_lines(spark):
    d = 1 / 111195
    ring = [("ring", 0, 0, 0, 100, 0), ("ring", 1, 100, 0, 100, 100), ("ring", 2, 101, 100, 0, 2), ("line", 3, 0, 500, 50, 500), ("line", 4, 52, 500, 90, 500), ("messy", 5, 0, 900, 50, 900), ("messy", 6, 500, 900, 600, 900)]
    w = spark.createDataFrame([(n, p, a * d, b * d, x * d, y * d) for n, p, a, b, x, y in ring], "name string, way_pos long, alat double, alon double, blat double, blon double")
    assert {r.name: r.topology for r in network.degrees(w).collect()} == {"ring": "loop", "line": "linear", "messy": "messy"}
    assert {r.name: (r.p0, r.p1) for r in network.termini(w).collect()}["line"] == (6, 9)


# ---------------------------------------------------------------- files


def test_wellness_of_some_dates(spark, tmp_path):
    from wayfold.sources import readers

    full = {"date": "2024-01-02", "status": {"vo2": {"value": 48.26, "age": 30}, "devices": {"a": {"timestamp": 5, "training_status": 1, "load": 10}, "b": {"timestamp": 9, "training_status": 2, "load": 20}}}, "battery": {"charged": 50, "drained": 40, "levels": [[1, 30], [2, None], [3, 80], [4, 55]]}, "resting": [51], "sleep": {"total": 100, "deep": 20, "light": 70, "rem": 10}, "stress": {"avg": 30, "most": 90}}
    for k, row in enumerate([full, {"date": "2024-01-03", "status": {"devices": {}}, "sleep": {"deep": 5}}, {"date": "2024-01-04"}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(row))
    dates = spark.createDataFrame([("2024-01-02",), ("2024-01-03",)], "date string").select(F.to_date("date").alias("date"))
    rows = {str(r.date): r for r in O.wellness(readers.of_dates(spark, str(tmp_path), dates, readers.WELLNESS)).collect()}
    assert sorted(rows) == ["2024-01-02", "2024-01-03"]
    r = rows["2024-01-02"]
    assert (r.vo2max, r.fitness_age, r.training_status, r.weekly_load, r.level_high, r.level_low, r.level_end, r.resting_hr, r.sleep_deep, r.stress_max) == (48.3, 30, 2, 20, 80, 30, 55, 51, 20, 90)
    r = rows["2024-01-03"]
    assert all(v is None for k, v in r.asDict().items() if k != "date")
    assert readers.lookups(spark, str(tmp_path / "none"), "id string, name string", [("ride", "Ride")]).collect()[0].id == "ride"


def test_backups_of_a_week(spark, tmp_path):
    from wayfold.sources import writers

    rows, path = spark.range(3), str(tmp_path / "t")
    for day in range(1, 11):
        writers.backed_up(rows, path, f"2024-01-{day:02}")
    writers.backed_up(rows.limit(1), path, "2024-01-10")
    got = {str(r.backup_date): r["count"] for r in spark.read.parquet(path).groupBy("backup_date").count().collect()}
    assert got == {f"2024-01-{d:02}": 1 if d == 10 else 3 for d in range(4, 11)}


def test_uploads(spark):
    from wayfold.sources import writers

    files = spark.createDataFrame([("f1", "ride.gpx", 10), ("f2", "ride.gpx", 10), ("f3", "big.gpx", 31 << 20), ("f4", "empty.gpx", 10), ("f5", "new.gpx", 10), ("f6", "old.gpx", 10)], "file string, name string, length long")
    points = spark.createDataFrame([("f1",), ("f2",), ("f3",), ("f5",), ("f6",), ("f6",)], "file string")
    taken = spark.createDataFrame([("ride.gpx",), ("ride_1.gpx",), ("old.gpx",)], "name string")
    got = {r.file: (r.status, r.stored_as) for r in writers.accepted(files, points, taken).collect()}
    assert got == {"f1": ("accepted", "ride_2.gpx"), "f2": ("accepted", "ride_3.gpx"), "f3": ("too large", None), "f4": ("unreadable", None), "f5": ("accepted", "new.gpx"), "f6": ("accepted", "old_1.gpx")}


def test_sparkline_strides_over_all_points(spark):
    """100 points: every second one; those without elevation are left out, and don't move the stride."""
    rows = [(1, k, None if k in (2, 3, 50) else float(k)) for k in range(100)] + [(2, 0, 5.0), (2, 1, None)]
    got = {r.activity_id: r.spark for r in T.sparklines(spark.createDataFrame(rows, "activity_id long, seq long, ele double")).collect()}
    assert got == {1: [float(k) for k in range(0, 100, 2) if k not in (2, 50)], 2: None}
