"""Lines, lifts and places that occur several times, and points that lie on lines to the last bits."""

from __future__ import annotations

import duckdb

from wayfold.operators import lifts, network, routes, spatial
from wayfold.plans.catalog import _SNAP, _WAYS


def test_points_on_lines_take_the_same_way_as_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW supplier AS SELECT range AS s_suppkey FROM range(1, 1001)")
    con.execute("CREATE TABLE legs AS SELECT r // 40 AS activity_id, r % 40 AS seq, CAST(50 AS DOUBLE) + CAST(r // 40 - 12 AS DOUBLE) / 10000 AS lat, CAST(-116 AS DOUBLE) + CAST(r % 40 AS DOUBLE) / 10000 AS lon, false AS assisted FROM (SELECT range AS r FROM range(1000))")
    want = con.execute(f"WITH {_WAYS}, {_SNAP} SELECT activity_id, seq, way_pos FROM snapped ORDER BY ALL").fetchall()
    ways = [r for r in con.execute(f"WITH {_WAYS} SELECT way_pos, name, kind, i, alat, alon, blat, blon FROM way").fetchall()]
    w = spark.createDataFrame(ways, "way_pos long, name string, kind string, i long, alat double, alon double, blat double, blon double")
    p = spark.createDataFrame(con.execute("SELECT * FROM legs").fetchall(), "activity_id long, seq long, lat double, lon double, assisted boolean")
    assert sorted(map(tuple, spatial.snap(p, w, 25.0).select("activity_id", "seq", "way_pos").collect())) == want


def test_copies_of_a_line_are_met_once(spark):
    s = spark.range(12).selectExpr("id way_pos", "'W' name", "id i", "50D + id % 3 alat", "7D alon", "51D blat", "8D blon")
    assert sorted(r.way_pos for r in spatial.first_of_line(s, "way_pos", "i", "name").collect()) == [0, 1, 2]
    v = s.selectExpr("way_pos pos", "i * 0 i", "alat lat", "alon lon")
    of = routes.shapes(s.selectExpr("way_pos pos", "name", "'t' kind", "alat", "alon", "blat", "blon"), v)
    assert {r.pos: r.shape for r in of.collect()} == {k: k % 3 for k in range(12)}


def test_copies_of_a_lift_have_its_rides(spark):
    legs = spark.createDataFrame([(1, k, 30 * k, 50 + 0.0005 * k, 7.0, 5.0) for k in range(30)], "activity_id long, seq long, t_s long, lat double, lon double, ele_delta double")
    one = [(50.0, 7.0, 50.014, 7.0), (50.0, 7.0, 50.01, 7.0)]
    up = spark.createDataFrame([(10 - k, *one[k % 2]) for k in range(6)], "lift long, alat double, alon double, blat double, blon double")
    rides = {}
    for r in lifts.station_rides(legs, up).collect():
        rides.setdefault((r.start, r.end), []).append(r.lift)
    assert sorted(map(sorted, rides.values())) == [[5, 7, 9], [6, 8, 10]]
    assert sorted(r.lift for r in lifts.station_rides(legs, up, every=False).collect()) == [5, 6]
    spans = spark.createDataFrame([(1, 0, 28)], "activity_id long, start long, end long")
    assert [tuple(r) for r in lifts.snapped_spans(legs, spans, up).collect()] == [(1, 0, 28, 5, 0, 20)]


def test_copies_of_a_place_have_one_leader(spark):
    rows = [(k, 50.0 + 0.0001 * (k % 4), 7.0) for k in range(16)] + [(99, None, None), (98, None, None)]
    p = spark.createDataFrame(rows, "id long, lat double, lon double")
    led = {r.id: r.leader for r in network.leaders(p, 15.0).collect()}
    assert led == {k: (0, 0, 2, 2)[k % 4] for k in range(16)} | {98: 98, 99: 99}
