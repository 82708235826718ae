"""What must not grow faster than its input: groups of pairs, sorts of pairs, work done twice."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from wayfold.operators import kernels, lifts, network, overview, route_scan, similarity
from wayfold.plans import catalog
from wayfold.streaming import stateful, tracks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rides_alike_meet_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 5)
    rng = random.Random(3)
    rides = []
    for k in range(60):
        y, x = rng.random(), rng.random()
        rides.append((k, rng.choice([0.5, 8.0, 9.5, 10.0, 12.4, 12.5]), rng.choice([[], ["u"], ["u", "v"], ["v", "u", "v"]]), y, x, y + 1, x + 1))
    df = spark.createDataFrame(rides, "activity_id long, km double, regions array<string>, min_lat double, min_lon double, max_lat double, max_lon double")
    want = set()
    for p, q in itertools.combinations(rides, 2):
        h, w = min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])
        both = max(0, h) * max(0, w)
        if min(p[1], q[1]) >= 1 and set(p[2] or [""]) & set(q[2] or [""]) and abs(p[1] - q[1]) <= 0.2 * max(p[1], q[1]) and both / (2 - both) >= 0.3:
            want.add((p[0], q[0]))
    out = similarity.candidates(df)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
    assert "_j" in plan(out) and "keys=[a#" not in plan(out)  # bounded groups, and pairs are not shuffled once more


def test_nearest_vertices_sort_no_pairs(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 0.0, 1.0), (2, 5, None, 3.0)], "line_id long, i long, vlat double, vlon double")
    q = spark.createDataFrame([(1, 10, 0.0, 0.9), (1, 11, 0.1, 0.1), (2, 12, 0.0, 3.0), (3, 13, 0.0, 0.0)], "line_id long, id long, lat double, lon double")
    out = network.nearest_vertex(q, v)
    assert {(r.line_id, r.id, r.i, r.d is None) for r in out.collect()} == {(1, 10, 1, False), (1, 11, 0, False), (2, 12, 5, True)}
    assert "SortAggregate" not in plan(out)


def test_routes_are_dealt_by_their_rows(spark):
    assert "REPARTITION_BY_NUM" in plan(catalog._route(spark, SF))


def test_able_routes_are_those_whose_edges_were_all_met(spark):
    rng = random.Random(5)
    near = {a: set(rng.sample(range(12), rng.randint(1, 8))) for a in range(20)}
    runs = {r: [rng.randrange(13) for _ in range(rng.randint(1, 5))] for r in range(60)}
    met = spark.createDataFrame([(a, e) for a, s in near.items() for e in s], "activity_id long, edge long")
    got = [tuple(r) for r in route_scan.able_routes(met, spark.createDataFrame(list(runs.items()), "route_id long, run array<long>")).collect()]
    want = [(a, r) for a, s in near.items() for r, run in runs.items() if set(run) <= s]
    assert sorted(got) == sorted(want) and want


def test_state_comes_with_the_rows_and_arrivals_have_several_files(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(9), k, rng.randrange(4000)) for k in range(400)]
    e = spark.createDataFrame(rows, "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(s) ts")
    src = stateful.arrivals(e, "event_id", 2, str(tmp_path / "in"), each=3)
    assert len(spark.read.parquet(src).inputFiles()) == 6 and stateful.files_each(e, 2, 50) == 4 and stateful.files_each(e, 2) == 1
    with stateful.rocks(spark):
        legs = stateful.ordered_legs(tracks.read(spark, src, e.schema, 3), "400 days", 400 * 86400)
        assert "TransformWithState" not in legs._jdf.queryExecution().analyzed().toString()  # whose calls for each key outweigh its few rows
        got = {r.event_id: r.dt for r in stateful.settled(legs, str(tmp_path / "out")).collect()}
    latest, want = {}, {}
    for u, k, s in rows:
        want[k] = float(max(0, s - latest.get(u, s)))
        latest[u] = max(s, latest.get(u, s))
    assert got == want


def test_candidates_for_lifts_are_scanned_once(spark):
    out = lifts.detected(catalog.legs(spark, SF), catalog._lifts(spark, SF), ["smart"])
    assert "FlatMapGroups" not in plan(out)  # its two readers share what the scan gave


def test_sines_are_left_to_pairs_that_are_near_on_the_flat(spark):
    rng = random.Random(11)
    rows = [(k, lat + rng.uniform(-0.004, 0.004), -116 + rng.uniform(-0.004, 0.004) / math.cos(math.radians(lat))) for lat in (0, 50, -80, 89.5) for k in range(60)]
    a, b = ([(i, *r[1:]) for i, r in enumerate(rows) if i % 2 == side] for side in (0, 1))
    df = lambda x, k: spark.createDataFrame(x, f"id{k} long, lat{k} double, lon{k} double")
    out = network.close_pairs(df(a, "a"), df(b, "b"), 250.0)
    assert "_ka" in plan(out)

    def metres(p, q):
        y, x = math.radians(q[1] - p[1]), math.radians(q[2] - p[2])
        return 12742000 * math.asin(math.sqrt(math.sin(y / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(x / 2) ** 2))

    want = sorted((p[0], q[0]) for p in a for q in b if metres(p, q) <= 250)
    assert sorted((r.ida, r.idb) for r in out.collect()) == want and len(want) > 100


def test_climbs_begin_where_a_scan_leg_by_leg_finds_them():
    rng = np.random.default_rng(2)
    found = 0
    for k in range(60):
        n = int(rng.integers(0, 200))
        dt, dz = rng.choice([1.0, 4.0, 9.0, -20.0], n, p=[0.4, 0.3, 0.28, 0.02]), rng.normal(0.7, 1.5, n)
        t, z = (np.concatenate([[0], np.cumsum(x)]) for x in (dt, dz))
        want, i = np.zeros(n, bool), 1
        while i < n and (j := int(np.searchsorted(t, t[i] + 60))) <= n:
            if z[j] - z[i] >= 25 and t[j] > t[i] and (z[j] - z[i]) / ((t[j] - t[i]) / 60) >= 5:
                while j < n and (m := min(n, int(np.searchsorted(t, t[j] + 30)))) > j and t[m] > t[j] and (z[m] - z[j]) / ((t[m] - t[j]) / 60) >= 2.5:
                    j = m
                want[i:j] = True
                i = j
            else:
                i += 1
        assert (kernels.rising(dt, dz, 5.0, 25.0) == want).all()
        found += want.any()
    assert found > 10


def test_clusters_take_their_rounds_in_one_task_as_by_joins(spark, monkeypatch):
    """equal scores go to the smaller ids, a pair a round; what is small enough needs no job for each."""
    rng = random.Random(13)
    rows = [(i + 100 * g, j + 100 * g, rng.choice([0.3, 0.4, 0.5])) for g in range(3) for i in range(9) for j in range(i + 1, 9) if rng.random() < 0.8]
    star = [(300, 300 + k, 0.5) for k in range(1, 30)] + [(300 + k, 300 + k + 1, 0.5) for k in range(1, 29)]
    df = lambda x: spark.createDataFrame(x, "a long, b long, score double")
    rides = spark.range(340).withColumnRenamed("id", "v")
    found = lambda x: {r.v: r.cluster for r in overview.clusters_of_rides(df(x), rides, 0.35).collect()}
    calls, cut = [], overview.cut
    monkeypatch.setattr(overview, "cut", lambda d: calls.append(1) or cut(d))
    whole = found(rows + star)
    assert len(calls) <= 6
    monkeypatch.setattr(overview, "DENSE", 0)
    assert found(rows) == {v: c if v < 300 else v for v, c in whole.items()} and len(set(whole.values())) < 320
    monkeypatch.setattr(overview, "DENSE", 20)  # the star goes by joins until so few are left
    assert found(rows + star) == whole


def test_lifts_near_both_ends_settle_a_span(spark, monkeypatch):
    """what a search near the ends finds is what one as far as it may go finds; spans without it go on."""
    rng = random.Random(19)
    place = lambda: (50 + rng.random() * 0.008, -116 + rng.random() * 0.012)
    points = spark.createDataFrame([(a, k, *place()) for a in range(6) for k in range(40)] + [(6, k, 50.0 + 0.00001 * k, -116.0) for k in range(40)], "activity_id long, seq long, lat double, lon double")
    spans = spark.createDataFrame([(a, s, e) for a in range(7) for s, e in ((4, 12), (10, 30), (20, 22))], "activity_id long, start long, end long")
    stations = spark.createDataFrame([(k, *place(), *place()) for k in range(25)] + [(25, 50.00005, -116.0, 50.0003, -116.0)], "lift long, alat double, alon double, blat double, blon double")
    far, snapped = [], lifts._snapped
    want = sorted(map(tuple, snapped(points, spans, stations, 5, 250.0).drop("_d").collect()))
    monkeypatch.setattr(lifts, "_snapped", lambda p, s, x, n, m: far.append((m, s.count())) or snapped(p, s, x, n, m))
    got = sorted(map(tuple, lifts.snapped_spans(points, spans, stations, samples=5).collect()))
    assert got == want and len(want) > 10
    assert [m for m, _ in far] == [62.5, 125.0, 250.0] and far[0][1] == 21 > far[1][1] >= far[2][1] > 0
