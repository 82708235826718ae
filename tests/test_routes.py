"""Attempts at many routes at once against one scan for each route; merging of timeline entries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wayfold.operators import route_scan, routes, spatial
from wayfold.operators.route_scan import Automaton, _close, _satisfied
from wayfold.plans import catalog


def one_by_one(entries, route):
    """Attempts at one route by a state of its own: what the automaton has to find for each."""
    found, at, first, last, k = [], 0, None, None, 0
    while k < len(entries):
        e, stop = entries[k], _satisfied(entries, k, route[at])
        trails = {(route[i]["name"], route[i]["kind"]) for i in ((at - 1, at) if at else (at,))}
        if stop is not None:
            first, last, at, k = k if first is None else first, stop - 1, at + 1, stop
            if at == len(route):
                found.append((first, last))
                at, first = 0, None
        elif first is None or e["noise"] or ((e["name"], e["kind"]) in trails and _close(entries[last], e)):
            k += 1
        else:
            at, first = 0, None
    return found


def made(rng, edges, n):
    """A timeline whose entries satisfy, or half satisfy, edges of their own trail."""
    rows, idx, t = [], 0, 0
    for k in range(n):
        name = "ABCD"[rng.integers(0, 4)]
        marks = {}
        for e in edges:
            if e["name"] == name and rng.random() < 0.7:
                marks[e["pos"], "own"] = tuple(bool(x) for x in rng.random(2) < 0.8) + (tuple(range(int(rng.integers(0, 5)))),)
            if e["name"] == name and rng.random() < 0.2:
                marks[e["pos"], "gap"] = (True, bool(rng.random() < 0.5), ())
        gap, pause = (20, 30) if rng.random() < 0.8 else (400, 2000)
        rows.append({"name": name, "kind": "trail", "entry": k, "start_idx": idx, "end_idx": idx + 40, "start_t": t, "end_t": t + 100, "noise": bool(rng.random() < 0.15), "marks": marks})
        idx, t = idx + 40 + gap, t + 100 + pause
    return rows


def test_all_routes_equal_one_by_one():
    rng = np.random.default_rng(11)
    edges = [{"pos": k, "name": "ABCD"[k % 4], "kind": "trail", "vertices": int(rng.integers(0, 6))} for k in range(7)]
    total = 0
    for _ in range(150):
        table = {r: [edges[i] for i in rng.integers(0, 7, rng.integers(1, 4))] for r in range(25)}
        table[25] = table[3][:1]  # a beginning of another, and the same again
        table[26] = table[3]
        entries = made(rng, edges, 30)
        got = {}
        for r, a, z in Automaton(list(table.items())).attempts(entries):
            got.setdefault(r, []).append((a, z))
        want = {r: w for r, route in table.items() if (w := one_by_one(entries, route))}
        assert {r: sorted(v) for r, v in got.items()} == want
        total += sum(map(len, want.values()))
    assert total > 1000


def test_one_route_along_its_stops_equals_the_automaton():
    """stops are found once for each edge, and each route goes along them."""
    rng = np.random.default_rng(17)
    edges = [{"pos": k, "name": "ABCD"[k % 4], "kind": "trail", "vertices": int(rng.integers(0, 6))} for k in range(7)]
    total = 0
    for _ in range(100):
        entries = made(rng, edges, 30)
        stops = {e["pos"]: [_satisfied(entries, k, e) for k in range(30)] for e in edges}
        for _ in range(20):
            route = [edges[i] for i in rng.integers(0, 7, rng.integers(1, 5))]
            got = route_scan.attempts_at([e["pos"] for e in route], entries, stops, {e["pos"]: (e["name"], e["kind"]) for e in edges})
            assert got == [(a, z) for _, a, z in sorted(Automaton([(0, route)]).attempts(entries), key=lambda t: t[1])]
            total += len(got)
    assert total > 500


def test_edges_that_no_entries_satisfy_lead_to_no_routes(spark):
    """a touch of one end, or of too few vertices, over all entries is not enough to ask for a route."""
    marked = [(1, 0, 0, "own", True, False, []), (1, 1, 0, "gap", False, True, []), (1, 0, 1, "own", True, False, [0]), (1, 1, 1, "own", True, False, [0]), (1, 0, 2, "own", False, False, [0, 3]), (1, 1, 2, "own", False, False, [3, 6]), (2, 0, 3, "own", False, False, [])]
    marked = spark.createDataFrame(marked, "activity_id long, entry long, pos long, part string, a boolean, b boolean, covered array<long>")
    known = spark.createDataFrame([(0, 2), (1, 2), (2, 4), (3, 0)], "pos long, vertices long")
    assert sorted(map(tuple, route_scan.may_satisfy(marked, known).collect())) == [(1, 0), (1, 2)]


def test_scan_of_tables(spark):
    """One plan over timelines, marks and a table of routes; lists of two routes, so that a trail has several."""
    rng = np.random.default_rng(12)
    edges = [{"pos": k, "name": "ABCD"[k % 4], "kind": "trail", "vertices": int(rng.integers(0, 6))} for k in range(7)]
    table = {r: [edges[i] for i in rng.integers(0, 7, rng.integers(1, 4))] for r in range(30)}
    lines, marked, want = [], [], set()
    for activity in range(20):
        rows = made(rng, edges, 25)
        for e in rows:
            lines.append((activity, e["entry"], e["start_idx"], e["end_idx"], e["start_t"], e["end_t"], e["name"], e["kind"], e["noise"]))
            marked += [(activity, e["entry"], pos, part, a, b, [int(x) for x in c]) for (pos, part), (a, b, c) in e["marks"].items()]
        want |= {(r, activity, rows[a]["start_idx"], rows[z]["end_idx"], rows[z]["end_t"] - rows[a]["start_t"]) for r, route in table.items() for a, z in one_by_one(rows, route)}
    timeline = spark.createDataFrame(lines, "activity_id long, entry long, start_idx long, end_idx long, start_t long, end_t long, name string, kind string, noise boolean")
    marked = spark.createDataFrame(marked, "activity_id long, entry long, pos long, part string, a boolean, b boolean, covered array<long>")
    saved = spark.createDataFrame([(r, k, e["pos"]) for r, route in table.items() for k, e in enumerate(route)], "route_id long, pos long, edge long")
    known = spark.createDataFrame([(e["pos"], e["name"], e["kind"]) for e in edges], "edge long, name string, kind string")
    sizes = spark.createDataFrame([(e["pos"], e["vertices"]) for e in edges], "edge long, n long")
    got = [tuple(r) for r in route_scan.scan_all(timeline, marked, saved, known, sizes, per_part=2).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert route_scan.scan_all(timeline, marked, saved.where("false"), known, sizes).count() == 0


def test_attempts_on_the_ground(spark):
    """Two edges of one straight trail and one across, ridden there; distances and climbs by hand."""
    step = 0.0001  # 11.1 m of latitude
    points = [(1, i, 50 + step * i, -116.0, 100.0 + i, 0.0111195 * i) for i in range(61)]
    points = spark.createDataFrame(points, "activity_id long, seq long, lat double, lon double, ele double, dist_km double")
    timeline = spark.createDataFrame([(1, 0, 0, 29, 0, 290, "A", "trail", False), (1, 30, 30, 60, 300, 600, "B", "trail", False)], "activity_id long, entry long, start_idx long, end_idx long, start_t long, end_t long, name string, kind string, noise boolean")
    edges = [(0, "A", "trail", 50.0, -116.0, 50 + 29 * step, -116.0), (1, "B", "trail", 50 + 30 * step, -116.0, 50 + 60 * step, -116.0), (2, "B", "trail", 50.0, -116.0, 50.0, -115.9)]
    vertices = [(e, i, a + (c - a) * i / 4, b + (d - b) * i / 4) for e, _, _, a, b, c, d in edges for i in range(5)]
    edges = spark.createDataFrame(edges, "edge long, name string, kind string, alat double, alon double, blat double, blon double")
    vertices = spark.createDataFrame(vertices, "edge long, i long, lat double, lon double")
    saved = spark.createDataFrame([(10, 0, 0), (10, 1, 1), (11, 0, 1), (12, 0, 1), (12, 1, 0), (13, 0, 0), (13, 1, 2)], "route_id long, pos long, edge long")
    got = {r.route_id: r for r in routes.attempts_of_routes(timeline, points, saved, edges, vertices).collect()}
    assert set(got) == {10, 11}
    assert (got[10].first_idx, got[10].last_idx, got[10].duration) == (0, 60, 600) and abs(got[10].dist_km - 0.667) < 0.001
    assert (got[11].first_idx, got[11].duration) == (30, 300)
    # elevations rise by one a point; smoothed over seven, the ends lose one and a half each
    assert abs(got[10].gain_m - 57.0) < 1e-9 and got[10].loss_m == 0
    one = routes.attempts(timeline, points, edges.where("edge < 2").withColumnRenamed("edge", "pos"), vertices.where("edge < 2").withColumnRenamed("edge", "pos")).collect()
    assert [(r.first_idx, r.last_idx, r.duration) for r in one] == [(0, 60, 600)]


ENTRY = "activity_id long, name string, kind string, direction string, start_idx long, end_idx long, start_t long, end_t long"


def merged(spark, rows):
    return [(r.name, r.direction, r.start_idx, r.end_idx, r.start_t, r.end_t, r.parts) for r in spatial.coalesced(spark.createDataFrame([(1, *r) for r in rows], ENTRY)).orderBy("start_idx").collect()]


def test_an_out_and_back_stays_two_entries(spark):
    rows = [("A", "trail", "up", 0, 50, 0, 100), ("A", "trail", "up", 60, 90, 120, 200), ("A", "trail", "down", 95, 150, 210, 300), ("A", "lift", "down", 160, 170, 310, 330)]
    assert merged(spark, rows) == [("A", "up", 0, 90, 0, 200, 2), ("A", "down", 95, 150, 210, 300, 1), ("A", "down", 160, 170, 310, 330, 1)]


def test_without_times_the_gap_in_points_decides(spark):
    rows = [("A", "trail", None, 0, 50, None, None), ("A", "trail", None, 60, 90, None, None), ("A", "trail", None, 341, 350, None, None)]
    assert merged(spark, rows) == [("A", None, 0, 90, None, None, 2), ("A", None, 341, 350, None, None, 1)]
    # an entry without an end keeps the end before; one that begins late starts anew, and has no end of its own to be measured against
    rows = [("A", "trail", "up", 0, 50, 0, 100), ("A", "trail", "up", 60, 90, 120, None), ("A", "trail", "up", 95, 99, 1001, None), ("A", "trail", "up", 100, 120, 9000, 9100)]
    assert merged(spark, rows) == [("A", "up", 0, 90, 0, 100, 2), ("A", "up", 95, 120, 1001, 9100, 2)]
    # overlapping entries are no fragments; a gap of 900 seconds is the longest
    rows = [("A", "trail", "up", 0, 50, 0, 100), ("A", "trail", "up", 49, 90, 120, 200), ("A", "trail", "up", 90, 99, 1100, 1200), ("A", "trail", "up", 99, 120, 2101, 2200)]
    assert merged(spark, rows) == [("A", "up", 0, 50, 0, 100, 1), ("A", "up", 49, 99, 120, 1200, 2), ("A", "up", 99, 120, 2101, 2200, 1)]


def test_merging_equals_a_scan(spark):
    rng = np.random.default_rng(13)
    rows, want = [], []
    for activity in range(60):
        idx, t, own = 0, 0, []
        for _ in range(30):
            idx, t = idx + int(rng.integers(-2, 300)), t + int(rng.integers(0, 1500))
            e = {"activity": activity, "name": "AB"[rng.integers(0, 5) // 4], "kind": "trail", "direction": [None, "up", "down"][rng.integers(0, 3) // 2], "s": idx, "e": idx + 40, "st": None if rng.random() < 0.2 else t, "et": None if rng.random() < 0.3 else t + 60}
            idx, t = idx + 40, t + 60
            rows.append((activity, e["name"], e["kind"], e["direction"], e["s"], e["e"], e["st"], e["et"]))
            p = own[-1] if own else None
            near = p and (p["name"], p["kind"], p["direction"]) == (e["name"], e["kind"], e["direction"]) and 0 <= e["s"] - p["e"] <= 250
            if near and (p["et"] is None or e["st"] is None or e["st"] - p["et"] <= 900):
                p["e"], p["n"] = e["e"], p["n"] + 1
                p["et"] = e["et"] if e["et"] is not None else p["et"]
            else:
                own.append(e | {"n": 1})
        want += [(o["activity"], o["name"], o["s"], o["e"], o["st"], o["et"], o["n"]) for o in own]
    got = spatial.coalesced(spark.createDataFrame(rows, ENTRY)).select("activity_id", "name", "start_idx", "end_idx", "start_t", "end_t", "parts").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert spatial.coalesced(spark.createDataFrame(rows, ENTRY).where(F.lit(False))).count() == 0


def test_every_point_and_vertex_counts(spark):
    """a way is followed where points come near to enough of all its vertices, and points between every third ones count."""
    timeline = spark.createDataFrame([(1, 0, "A"), (2, 0, "A")], "activity_id long, entry long, name string")
    at = [50 + 0.001 * i for i in range(5)]  # vertices 111 m apart
    near = [(1, 1, at[0]), (1, 2, at[1]), (1, 4, at[2]), (1, 5, at[3]), (2, 0, at[0]), (2, 3, at[3])]
    entries = timeline.join(spark.createDataFrame([(*r, -116.0, "trail", "own") for r in near], "activity_id long, seq long, lat double, lon double, kind string, part string"), "activity_id")
    segment = spark.createDataFrame([(7, "A", "trail", 49.0, -116.0, 51.0, -116.0)], "pos long, name string, kind string, alat double, alon double, blat double, blon double")
    vertices = spark.createDataFrame([(7, "A", "trail", i, lat, -116.0) for i, lat in enumerate(at)], "pos long, name string, kind string, i long, lat double, lon double")
    hit, _ = routes.satisfied_edges(entries, segment, vertices, stride=1)
    assert [(r.activity_id, r.touched, r.followed) for r in hit.collect()] == [(1, False, True)]
    sql = catalog.ORACLES["rte_03"]
    assert "v.i % 3" not in sql and "e.seq % 3" not in sql
