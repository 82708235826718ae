"""Results that follow uploads, state that ends, and joins of two streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.streaming import incremental as I
from wayfold.streaming import stateful as S
from wayfold.streaming.tracks import read

ROWS = "activity_id long, points long, last double"


def match(tracks):
    return tracks.groupBy("activity_id").agg(F.count("*").alias("points"), F.max("lat").alias("last")).where("points > 1")


def uploaded(spark, ids, at, n=4, lat=50.0):
    return spark.createDataFrame([(i, at, k, lat + i + k) for i in ids for k in range(n)], "activity_id long, uploaded long, seq long, lat double")


def found(spark, store):
    return {r.activity_id: (r.points, r.last) for r in I.current(spark, store, ROWS).collect()}


def batches(spark, store):
    return {r.batch: r.n for r in I.index(spark, store).groupBy("batch").agg(F.count("*").alias("n")).collect()}


def test_a_touched_track_alone_is_matched_anew(spark, tmp_path):
    store, src, at = (str(tmp_path / x) for x in ("store", "in", "at"))
    go = lambda: I.follow(read(spark, src, first.schema), store, 1, match, at)
    first = uploaded(spark, range(100), 1)
    first.coalesce(1).write.parquet(src)
    go()
    assert batches(spark, store) == {0: 100} and found(spark, store) == {i: (4, 53.0 + i) for i in range(100)}
    uploaded(spark, [7], 2, n=6).coalesce(1).write.mode("append").parquet(src)
    go()
    assert batches(spark, store) == {0: 100, 1: 1}
    want = {i: (4, 53.0 + i) for i in range(100)} | {7: (6, 62.0)}
    assert found(spark, store) == want
    # the batch once more, and once more after results were written but not indexed
    I.refresh(uploaded(spark, [7], 2, n=6), store, 1, 1, match)
    assert batches(spark, store) == {0: 100, 1: 1} and found(spark, store) == want
    match(uploaded(spark, [7, 8], 3)).withColumn("batch", F.lit(2).cast("long")).write.partitionBy("batch").mode("append").parquet(f"{store}/rows")
    assert found(spark, store) == want
    I.refresh(uploaded(spark, [8], 3, n=5), store, 2, 1, match)
    want[8] = (5, 62.0)
    assert found(spark, store) == want
    # an earlier upload, and the same again, change nothing; of two in a batch the later counts
    I.refresh(uploaded(spark, [7], 1, n=9).unionByName(uploaded(spark, [8], 3, n=5)), store, 3, 1, match)
    assert 3 not in batches(spark, store) and found(spark, store) == want
    I.refresh(uploaded(spark, [9], 5, n=3).unionByName(uploaded(spark, [9], 4, n=7)), store, 4, 1, match)
    want[9] = (3, 61.0)
    assert found(spark, store) == want
    # a track without results any more has none
    I.refresh(uploaded(spark, [10], 6, n=1), store, 5, 1, match)
    del want[10]
    assert found(spark, store) == want


def test_a_new_version_matches_all_that_an_earlier_one_has(spark, tmp_path):
    store = str(tmp_path / "store")
    tracks = uploaded(spark, range(5), 1)
    I.refresh(tracks, store, 0, 1, match)
    more = lambda t: match(t).withColumn("points", F.col("points") + 100)
    I.rematch(tracks.where("activity_id < 3"), store, 2, more)
    assert {i: n for i, (n, _) in found(spark, store).items()} == {0: 104, 1: 104, 2: 104, 3: 4, 4: 4}
    I.rematch(tracks, store, 2, more)  # the same partition again, now of all
    assert {n for n, _ in found(spark, store).values()} == {104} and batches(spark, store) == {0: 5, -2: 5}
    assert found(spark, str(tmp_path / "none")) == {}


EVENTS = "event_id long, user_id long, ts timestamp_ntz"


def moment(s):
    return f"2024-01-{1 + s // 86400:02d} {s % 86400 // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


def arrive(spark, src, rows):
    df = spark.createDataFrame([(i, u, moment(t)) for i, u, t in rows], "event_id long, user_id long, ts string")
    df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(src)


def test_state_lasts_over_restarts_and_ends(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def go():
        with S.rocks(spark):
            out = S.settled(S.ordered_legs(read(spark, src, EVENTS, 1), "1 hour", 7200), folder)
        return {r.event_id: r.dt for r in out.collect()}

    arrive(spark, src, [(1, 1, 0), (2, 1, 10), (3, 1, 4), (4, 2, 5)])
    assert go() == {1: 0.0, 2: 10.0, 3: 0.0, 4: 0.0}
    arrive(spark, src, [(5, 1, 12), (6, 1, 11)])  # a new query goes on with the state
    assert go() == {1: 0.0, 2: 10.0, 3: 0.0, 4: 0.0, 5: 2.0, 6: 0.0}
    arrive(spark, src, [(7, 2, 30_000)])  # the watermark passes user 1's time and two hours
    arrive(spark, src, [(8, 2, 30_010)])
    arrive(spark, src, [(9, 1, 29_990)])  # user 1 starts anew
    arrive(spark, src, [(10, 1, 100)])  # later than the watermark allows: left out
    got = go()
    assert got[7] == 29_995.0 and got[8] == 10.0 and got[9] == 0.0 and 10 not in got


def test_two_streams_meet_as_tables_do(spark, tmp_path):
    points, samples = [(k, k % 3, 20 * k) for k in range(60)], [(1000 + k, k % 3, 20 * k + (k % 7) * 9 - 20) for k in range(1, 60)]
    one, two = str(tmp_path / "p"), str(tmp_path / "s")
    for k in range(3):
        arrive(spark, one, points[20 * k : 20 * k + 20])
        arrive(spark, two, samples[20 * k : 20 * k + 20])
    side = lambda src: spark.read.schema(EVENTS).parquet(src)
    key = lambda df: sorted((r.event_id, r.s_event_id) for r in df.collect())
    want = sorted((i, j) for i, u, t in points for j, v, s in samples if u == v and abs(s - t) <= 30)
    assert key(S.with_samples(side(one), side(two))) == want
    both = S.with_samples(read(spark, one, EVENTS, 1), read(spark, two, EVENTS, 1), late="15 minutes")
    with S.rocks(spark):
        out = S.settled(both, str(tmp_path / "out"))
    assert key(out) == want and len(want) > 50
