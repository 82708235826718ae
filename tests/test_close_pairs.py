"""Pairs of close points at any latitude."""

from __future__ import annotations

import numpy as np

from wayfold.operators.network import close_pairs


def test_pairs_far_north(spark):
    rng = np.random.default_rng(3)
    metres, rows = 100.0, []
    for lat in (0.0, 50.0, 68.0, -80.0):
        lon = -116.0 + rng.random(300) * 0.02
        for k, x in enumerate(lon):
            east = 98.0 / (111194.9 * np.cos(np.radians(lat)))
            rows.append((int(lat) * 1000 + k, float(lat), float(x), float(x + east)))
    p = spark.createDataFrame(rows, "id long, lat double, x double, y double")
    got = close_pairs(p.selectExpr("id ida", "lat lata", "x lona"), p.selectExpr("id idb", "lat latb", "y lonb"), metres).where("ida = idb")
    assert got.count() == len(rows)
