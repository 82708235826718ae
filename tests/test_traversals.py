"""Traversals on networks: two chains of one name, a line ridden out and back, laps around a loop."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import kernels, routes, spatial

WAYS = "way_pos long, name string, alat double, alon double, blat double, blon double"
S = 0.001


@pytest.fixture(scope="module")
def ways(spark):
    line = [(0, "L", 50.0, -116.0, 50 + 5 * S, -116.0), (1, "L", 50 + 10 * S, -116.0, 50 + 5 * S, -116.0)]  # two ways, the second drawn backwards
    far = [(2, "L", 50.1, -116.0, 50.1 + 4 * S, -116.0)]  # a chain of its own
    corners = [(50.2, -116.0), (50.2, -116 + 5 * S), (50.2 + 3 * S, -116 + 5 * S), (50.2 + 3 * S, -116.0)]
    loop = [(10 + k, "O", *corners[k], *corners[(k + 1) % 4]) for k in range(4)]
    return spark.createDataFrame(line + far + loop, WAYS)


def chain(ways):
    return routes.chain_segments(routes.linked_ways(ways, 50.0, -116.0), ways)


def test_every_chain_has_its_own_length(spark, ways):
    got = {(r.name, r.chain): r.total_m for r in chain(ways).collect()}
    assert got["L", 0] == pytest.approx(1112, rel=0.01) and got["L", 2] == pytest.approx(445, rel=0.01)
    p = spark.createDataFrame([(1, "L", 0, 50 + 5 * S, -116.0), (1, "L", 1, 50 + 10 * S, -116.0), (1, "L", 2, 50.05, -116.0), (1, "L", 3, 50.1 + S, -116.0), (1, "L", 4, 50.1 + 4 * S, -116.0), (2, "L", 0, 49.0, -116.0)], "activity_id long, name string, seq long, lat double, lon double")
    rows = {(r.activity_id, r.seq): (r.chain, round(r.progress, 3)) for r in spatial.progress(p, chain(ways), 50.0).collect()}
    assert rows == {(1, 0): (0, 0.5), (1, 1): (0, 1.0), (1, 2): (0, 1.0), (1, 3): (2, 0.25), (1, 4): (2, 1.0), (2, 0): (-1, 0.0)}


def test_out_and_back_and_laps(spark, ways):
    out = [50 + 10 * S * k / 40 for k in range(41)]
    rows = [(1, "L", k, lat, -116.0) for k, lat in enumerate(out + out[-2::-1])]
    angle = np.linspace(0, 2 * 2 * np.pi, 161)
    rows += [(2, "O", k, 50.2 + 1.5 * S + 1.5 * S * float(np.sin(a)), -116 + 2.5 * S + 2.5 * S * float(np.cos(a))) for k, a in enumerate(angle)]
    rows += [(3, "O", k, 50.2 + 1.5 * S - 1.5 * S * float(np.sin(a)), -116 + 2.5 * S + 2.5 * S * float(np.cos(a))) for k, a in enumerate(angle[:40])]
    p = spark.createDataFrame(rows, "activity_id long, name string, seq long, lat double, lon double")
    got = {}
    for r in routes.ridden(p, ways, chain(ways), 50.0, window=1).orderBy("part").collect():
        got.setdefault(r.activity_id, []).append((r.loop, r.start, r.end, r.along))
    assert got[1] == [(False, 0, 40, True), (False, 40, 80, False)]
    assert [g[0] for g in got[2]] == [True, True] and all(g[3] for g in got[2]) and got[2][0][2] == got[2][1][1] in (80, 81)
    assert got[3] == [(True, 0, 39, False)]


def test_pairs_of_a_point_are_not_sorted(spark):
    """the least distance is a minimum of numbers, and only the segments at it are put in order; as one by one."""
    rng = np.random.default_rng(4)
    lines = [(k, "AB"[k % 2], *(50 + rng.integers(0, 20, 2) * 0.0005).tolist(), *(-116 + rng.integers(0, 20, 2) * 0.0005).tolist()) for k in range(60)]
    lines += [(60 + k, "A", *lines[2 * k][2:]) for k in range(5)]  # as far as another from any point
    places = [(k, "AB"[k % 2], float(50 + rng.integers(0, 40) * 0.0003), float(-116 + rng.integers(0, 40) * 0.0003)) for k in range(300)]
    points = spark.createDataFrame([*places, (300, "A", None, -116.0)], "id long, name string, lat double, lon double")
    segments = spark.createDataFrame([(k, n, a, c, b, d) for k, n, a, b, c, d in lines], "way long, name string, alat double, alon double, blat double, blon double")
    got = {r.id: r.best.way for r in spatial.nearest_segment(points, segments, 150.0, ["id", "name"], ["way"], "name").where("best.d <= 150").collect()}
    best = {}
    for r in spatial.segment_pairs(points, segments, 150.0, "name").where("d <= 150").collect():
        best[r.id] = min(best.get(r.id, (9e9, 0)), (r.d, r.way))
    assert got == {k: w for k, (_, w) in best.items()} and len(got) > 100
    metres = 6371000 * np.pi / 180
    for k, name, lat, lon in places:
        kx, least = np.cos(np.radians(lat)) * metres, 9e9
        for _, n, a, b, c, d in lines:
            if n == name:
                p, q = np.array([(c - lon) * kx, (a - lat) * metres]), np.array([(d - c) * kx, (b - a) * metres])
                t = np.clip(-(p @ q) / (q @ q), 0, 1) if q @ q else 0.0
                least = min(least, float(np.hypot(*(p + t * q))))
        assert (k in got) == (least <= 150) or abs(least - 150) < 1e-6
        assert k not in got or abs(best[k][0] - least) < 1e-6
    plan = spatial.nearest_segment(points, segments, 150.0, ["id", "name"], ["way"], "name")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[id" in plan.replace("ObjectHashAggregate", "")


def test_runs_share_calls_and_go_on_over_batches(spark):
    """runs of all tracks of a partition come in batches, as each by itself; one may be longer than a batch."""
    rng = np.random.default_rng(9)
    rows = []
    for a in range(30):
        for name in ("A", "B")[: 1 + a % 2]:
            x = np.clip(np.cumsum(rng.normal(0, 0.08, int(rng.integers(1, 60)))) + 0.5, 0, 1)
            rows += [(a, name, 2 * k, float(v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "activity_id long, name string, seq long, progress double").orderBy(F.rand(1))
    want = set()
    for a, name in {r[:2] for r in rows}:
        own = sorted(r[2:] for r in rows if r[:2] == (a, name))
        x, seq = kernels._median(np.array([v for _, v in own]), 3), [s for s, _ in own]
        for k, (i, j, ahead) in enumerate(kernels._fold_short(kernels._split_linear(x, 0.1), 3)):
            want.add((a, name, k, seq[i], seq[j - 1], ahead, float(x[j - 1] - x[i])))
    out = kernels.traversals(df, least=3, turn=0.1, window=3)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {tuple(r) for r in kernels.traversals(df, least=3, turn=0.1, window=3).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
