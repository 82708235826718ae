"""Covers of regions by cells of several sizes, and points in regions against a ray for each pair."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from wayfold.operators import spatial


def rings():
    rng = np.random.default_rng(21)
    star = lambda lat, lon, r, n: [(lat + r * (1 if k % 2 else 0.4) * math.sin(2 * math.pi * k / n), lon + r * (1 if k % 2 else 0.4) * math.cos(2 * math.pi * k / n)) for k in range(n)]
    comb = [(0.0, 0.0), *((1.0 if k % 2 else 0.1, 0.05 * k) for k in range(1, 40)), (0.0, 2.0)]
    return {
        1: star(50, -116, 0.0005, 10), 2: star(50, -116, 0.02, 14), 3: star(50, -116, 1.0, 9), 4: star(48, -118, 20, 40), 5: [(49.0, -117.0), (51.0, -117.0), (51.0, -115.0), (49.0, -115.0)],
        6: [(la + 49.5, lo - 116.5) for la, lo in comb], 7: [(50 + 0.3 * math.sin(t) * (1 + 0.1 * rng.random()), -116 + 0.3 * math.cos(t)) for t in np.linspace(0, 2 * math.pi, 2000, endpoint=False)],
        8: [(50.0, -116.0)], 9: [(50.0, -116.0), (50.5, -116.0)], 10: [], 11: [(-0.2, -0.1), (0.3, 0.0), (0.0, 0.4)],
    }


def table(spark, of):
    return spark.createDataFrame([(k, [{"lat": float(a), "lon": float(b)} for a, b in ring]) for k, ring in of.items()], "region_id long, ring array<struct<lat double, lon double>>")


def inside(lat, lon, ring):
    n = 0
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        n += (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b
    return n % 2 == 1


def test_points_equal_a_ray_for_each_pair(spark):
    rng, of = np.random.default_rng(22), rings()
    spots = [(50 + s * a, -116 + s * b) for s in (0.0005, 0.02, 1.0, 20.0) for a, b in rng.uniform(-1.2, 1.2, (120, 2))]
    spots += [(49.0, -117.0), (50.0, -117.0), (51.0, -116.0), (50.0, -116.0), (0.0, 0.0), (0.01, 0.1), (-0.1, -0.05), (90.0, 0.0)]  # corners and edges, too
    spots += [p for ring in of.values() for p in ring[:20]]
    points = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(spots)] + [(2, 0, None, 1.0)], "activity_id long, seq long, lat double, lon double")
    got = [tuple(r) for r in spatial.points_in_regions(points, spatial.ring_edges(table(spark, of))).collect()]
    want = {(1, i, k) for i, (a, b) in enumerate(spots) for k, ring in of.items() if ring and inside(a, b, ring)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert spatial.points_in_regions(points, spatial.ring_edges(table(spark, {10: []}))).count() == 0
    assert spatial.points_in_regions(points.where("false"), spatial.ring_edges(table(spark, of))).count() == 0


def test_covers_are_bounded_and_of_several_sizes(spark):
    cover = spatial.region_cover(spatial.ring_edges(table(spark, rings())))
    by = {r.region_id: r for r in cover.groupBy("region_id").agg(F.count("*").alias("n"), F.count_distinct("level").alias("levels"), F.count_if("inner").alias("inner")).collect()}
    assert all(r.n <= 34 * 34 for r in by.values())
    assert by[5].levels >= 2 and by[5].n < 700  # a square of two degrees: 32 cells across, the inner ones merged
    # no two cells of a region lie within each other
    cells = {(r.region_id, r.level, r.ci, r.cj) for r in cover.collect()}
    for k, level, i, j in cells:
        for up in (1, 2):
            assert (k, level - up, i // 4**up, j // 4**up) not in cells
