from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.streaming import tracks as S

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartitionByRange(3, "ts").write.parquet(src)
    return e, S.read(spark, src, e.schema, 1)


def test_thinned_stream_equals_batch(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    got = S.drained(S.thinned(s, ["purchase", "view"]), "thin", "append", str(tmp_path / "c"))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in S.thinned(e, ["purchase", "view"]).collect())


def test_hourly_stream_equals_batch(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    key = lambda df: sorted((str(r.hour), r.event_type, r.n) for r in df.collect())
    assert key(S.drained(S.hourly(s, "40 days"), "hours", "complete", str(tmp_path / "c"))) == key(S.hourly(e, "40 days"))


def test_sessions_in_batch(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    rows = S.sessions(e, "6 hours", "1 day").collect()
    assert sum(r.n for r in rows) == e.count() and len(rows) > e.select("user_id").distinct().count()


def test_out_of_order_points_count_nothing(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:00:10"), (3, 1, "2024-01-01 00:00:04"), (4, 1, "2024-01-01 00:00:12"), (5, 2, "2024-01-01 00:00:00")]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    out = S.drained(S.ordered_legs(S.read(spark, src, e.schema)), "legs", "append", str(tmp_path / "c"))
    assert {r.event_id: r.dt for r in out.collect()} == {1: 0.0, 2: 10.0, 3: 0.0, 4: 2.0, 5: 0.0}


def test_high_water_and_batches(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    half = e.where(F.dayofmonth("ts") <= 15)
    rest = S.after_high_water(e, half)
    assert rest.count() == e.where(F.dayofmonth("ts") > 15).count()
    assert S.after_high_water(e, e.where("false")).count() == e.count()
    seen = []
    S.for_each_batch(s, lambda df, k: seen.append((k, df.count())), str(tmp_path / "c"))
    assert len(seen) == 3 and sum(n for _, n in seen) == e.count()
