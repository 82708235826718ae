from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, stats, tables


def test_medians(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    r = spark.range(1).select(stats.median_avg(a(4.0, 1.0, 3.0, 2.0)).alias("avg"), stats.median_upper(a(4.0, 1.0, 3.0, 2.0)).alias("up"), stats.median_avg(a(3.0)).alias("one"), stats.median_upper(F.array().cast("array<double>")).alias("none"), stats.percentile_index(F.lit(200), 0.995).alias("p")).first()
    assert (r.avg, r.up, r.one, r.none, r.p) == (2.5, 3.0, 3.0, None, 199)


def test_distances(spark):
    c = F.lit
    r = spark.range(1).select(geo.haversine(c(50.0), c(-116.0), c(50.0), c(-116.0)).alias("zero"), geo.haversine(c(0.0), c(0.0), c(0.0), c(1.0)).alias("degree"), geo.segment_distance(c(5.0), c(3.0), c(0.0), c(0.0), c(10.0), c(0.0)).alias("side"), geo.segment_distance(c(13.0), c(4.0), c(0.0), c(0.0), c(10.0), c(0.0)).alias("end"), geo.segment_distance(c(3.0), c(4.0), c(0.0), c(0.0), c(0.0), c(0.0)).alias("point"), geo.sinuosity(c(5.0), c(0.5)).alias("s")).first()
    assert (r.zero, r.side, r.end, r.point, r.s) == (0.0, 3.0, 5.0, 5.0, 1.0)
    assert r.degree == pytest.approx(math.pi * geo.EARTH_M / 180)


def test_table_function(spark):
    tables.register(spark)
    rows = spark.sql("SELECT * FROM detect('time_gap', array(1D, 300D, 1D), array(1D, 1D, 1D), array(0D, 150D, 0D), array(1D, NULL, 1D))").collect()
    assert [(r.seq, r.assisted) for r in rows] == [(0, False), (1, True), (2, False)]
    got = spark.sql("SELECT " + tables.EWMA.format(values="array(1D, 0D, 2D)", tau=7) + " AS e").first().e
    k, s, want = 1 - math.exp(-1 / 7), 0.0, []
    for v in (1.0, 0.0, 2.0):
        s += (v - s) * k
        want.append(s)
    assert got == pytest.approx(want)


def test_numbers_over_all_rows(spark):
    from pyspark.sql import functions as F

    from wayfold.functions.order import numbered

    rows = [(i, (i * 37) % 101, None if i % 50 == 0 else i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, a long, b long").repartition(7)
    got = {r.i: r.n for r in numbered(df, "n", F.desc("b"), F.col("a"), F.col("i")).collect()}
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1], r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}
    assert numbered(df.where("false"), "n", F.col("i")).count() == 0
