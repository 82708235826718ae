from __future__ import annotations

import json

from pyspark.sql import functions as F

from wayfold.sources import readers, writers

GPX = """<?xml version="1.0"?><gpx creator="App 1.2"><trk><name>Morning</name><trkseg><trkpt lat="50.0" lon="-116.0"><ele>1000</ele><time>2024-01-01T10:00:00Z</time></trkpt><trkpt lat="50.001" lon="-116.0"/></trkseg><trkseg><trkpt lat="50.002" lon="-116.001"><ele>1005.5</ele><time>2024-01-01T10:01:00Z</time></trkpt></trkseg></trk></gpx>"""


def test_gpx(spark, tmp_path):
    d = tmp_path / "tracks"
    d.mkdir()
    (d / "a.gpx").write_text(GPX)
    (d / "b.gpx").write_text(GPX.split("<trkpt")[0] + '<trkpt lat="1" lon="2"/></trkseg></trk></gpx>')
    points = readers.gpx(spark, str(d))
    rows = points.orderBy("seq").collect()
    assert [(r.seq, r.lat, r.ele) for r in rows] == [(0, 50.0, 1000.0), (1, 50.001, None), (2, 50.002, 1005.5)]
    assert rows[0].name == "Morning" and rows[0].creator == "App 1.2" and rows[1].ts is None
    assert [r.file.rsplit("/", 1)[-1] for r in readers.unreadable(spark, str(d), points.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))).collect()] == ["b.gpx"]
    t = {r.file.rsplit("/", 1)[-1]: r for r in readers.first_last_times(spark, str(d)).collect()}
    assert t["a.gpx"].first == "2024-01-01T10:00:00Z" and t["a.gpx"].last == "2024-01-01T10:01:00Z" and t["b.gpx"].first is None


def test_ends_of_files_are_sought(spark, tmp_path):
    """Files of eight gigabytes, nearly all of it a hole: to read one whole would not fit into a row."""
    d = tmp_path / "big"
    d.mkdir()
    for k in range(3):
        with open(d / f"{k}.gpx", "wb") as f:
            f.write(f"<time>2024-01-0{k + 1}T00:00:00Z</time>".encode())
            f.truncate(8 << 30)
            f.seek(0, 2)
            f.write(f"<time>2024-02-0{k + 1}T00:00:00Z</time><trk/>".encode())
    (d / ".hidden").write_text("<time>x</time>")
    (d / "empty.gpx").write_text("")
    (d / "cut.gpx").write_text("<time>a</time>x" + "é" * 5000 + "<time>z</time>")  # the tail begins within a character
    (d / "short.gpx").write_text("é<time>a</time><time>b</time>")
    t = {r.file.rsplit("/", 1)[-1]: (r.first, r.last) for r in readers.first_last_times(spark, str(d)).collect()}
    assert t == {f"{k}.gpx": (f"2024-01-0{k + 1}T00:00:00Z", f"2024-02-0{k + 1}T00:00:00Z") for k in range(3)} | {"cut.gpx": ("a", "z"), "empty.gpx": (None, None), "short.gpx": ("a", "b")}
    ends = spark.read.format("ends").option("size", 10).load(f"file://{d}/*.gpx").collect()
    assert sorted((r.length > 8 << 30, len(r.head), len(r.tail)) for r in ends) == [(False, 0, 0), (False, 10, 10), (False, 10, 10), *[(True, 10, 10)] * 3]
    assert [r.length for r in spark.read.format("ends").load(str(d / "short.gpx")).collect()] == [30]


def test_gpx_writer_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 1, 50.5, -116.0, None, "2024-01-01T00:00:05Z"), (1, 0, 50.0, -116.5, 9.5, "2024-01-01T00:00:00Z")], "activity_id long, seq long, lat double, lon double, ele double, time string")
    writers.gpx(p, str(tmp_path / "out"))
    rows = readers.gpx(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.lat, r.lon, r.ele) for r in rows] == [(50.0, -116.5, 9.5), (50.5, -116.0, None)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "hr.json").write_text(json.dumps({"date": "2024-01-01", "samples": [[1000, 60], [2000, None]], "resting": 50}))
    assert [(r.ts_ms, r.bpm) for r in readers.sensor_days(spark, str(tmp_path / "hr.json")).orderBy("ts_ms").collect()] == [(1000, 60), (2000, None)]
    (tmp_path / "w.json").write_text(json.dumps([{"date": "2024-02-01", "weight_kg": 70.5}, {"date": "bad", "weight_kg": 1}, {"date": "2024-01-01", "weight_kg": 71}]))
    assert [r.weight_kg for r in readers.weights(spark, str(tmp_path / "w.json")).collect()] == [71.0, 70.5]
    (tmp_path / "r.json").write_text(json.dumps([{"id": "a", "name": "A", "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4]]]}}]))
    assert [tuple(p) for p in readers.regions(spark, str(tmp_path / "r.json")).collect()[0].ring] == [(2.0, 1.0), (4.0, 3.0)]


def test_network_and_lifts(spark):
    e = spark.createDataFrame([("node", 1, 1.0, 2.0, None, None), ("node", 2, 3.0, 4.0, None, None), ("way", 9, None, None, [2, 1], {"name": "Ridge", "highway": "path"}), ("way", 8, None, None, [1, 2], {}), ("way", 7, None, None, [1], {"name": "Short"})], "type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>")
    rows = readers.network(e).collect()
    assert [(r.name, [tuple(c) for c in r.coords]) for r in rows] == [("Ridge", [(3.0, 4.0), (1.0, 2.0)])]
    w = spark.createDataFrame([("L", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]), ("S", [(1.0, 2.0)])], "name string, geometry array<struct<lat:double,lon:double>>")
    assert [(r.name, tuple(r.a), tuple(r.b)) for r in readers.lifts(w).collect()] == [("L", (1.0, 2.0), (5.0, 6.0))]


def test_weather_and_changelog(spark, tmp_path):
    d = spark.createDataFrame([([0, 3600], [1.0, 2.0], [0.0, 0.1], [5.0, 6.0], [1, 2])], "time array<long>, temp array<double>, rain array<double>, wind array<double>, code array<int>")
    assert [r.temp for r in readers.weather(d).orderBy("time").collect()] == [1.0, 2.0]
    (tmp_path / "c.md").write_text("# Log\n\n## [1.1]\n- one\n  goes on\n- two\n\n## [1.0]\n- first\n")
    assert [(r.version, r.text) for r in readers.changelog(spark, str(tmp_path / "c.md")).orderBy("bullet").collect()] == [("1.1", "one goes on"), ("1.1", "two"), ("1.0", "first")]


def test_changes(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, t string, v long")
    assert sorted(writers.patched(rows, spark.createDataFrame([(1, None, 9)], "k long, t string, v long"), "k").collect()) == [(1, "a", 9), (2, "b", 6)]
    assert sorted(writers.upserted(rows, spark.createDataFrame([(2, "c", 7), (3, "d", 8)], "k long, t string, v long"), "k").collect()) == [(1, "a", 5), (2, "c", 7), (3, "d", 8)]
    assert sorted(writers.cascaded(rows, spark.createDataFrame([("a",)], "id string"), "t", "id").collect(), key=repr) == [(1, None, 5), (2, "b", 6)]
    f = writers.fingerprints(rows, ["v", "t"])
    assert len({r.fingerprint for r in f.collect()}) == 2 and f.collect() == writers.fingerprints(rows, ["t", "v"]).collect()


def test_table_overwrites_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.table(spark.createDataFrame([(1, "a"), (2, "b")], "v long, d string"), path, "d")
    writers.table(spark.createDataFrame([(3, "b")], "v long, d string"), path, "d")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3]
