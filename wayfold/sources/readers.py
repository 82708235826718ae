"""Readers of tracks, sensor days, weights, regions, line networks and weather; explicit schemas throughout."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranged import Ends

_POINT = T.StructType([T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("ele", T.DoubleType()), T.StructField("time", T.StringType())])
_TRACK = T.StructType([T.StructField("name", T.StringType()), T.StructField("trkseg", T.ArrayType(T.StructType([T.StructField("trkpt", T.ArrayType(_POINT))])))])
GPX = T.StructType([T.StructField("_creator", T.StringType()), T.StructField("trk", T.ArrayType(_TRACK))])


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """Points of GPX files, over tracks and segments in order; files of fewer than two points are left out, see ``unreadable``."""
    files = spark.read.format("xml").option("rowTag", "gpx").schema(GPX).load(path).withColumn("file", F.input_file_name())
    flat = F.flatten(F.flatten(F.transform("trk", lambda t: F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    points = files.withColumn("points", flat).where(F.size("points") >= 2)
    p = points.select("file", F.col("_creator").alias("creator"), F.col("trk")[0]["name"].alias("name"), F.posexplode("points").alias("seq", "p"))
    return p.select("file", "creator", "name", F.col("seq").cast("long").alias("seq"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele"), F.try_to_timestamp("p.time").alias("ts"))


def unreadable(spark: SparkSession, path: str, points: DataFrame) -> DataFrame:
    """Files that gave no track."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return files.join(points.select("file").distinct(), "file", "left_anti")


def first_last_times(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """First and last time of each file, from its first and last bytes; no more of it is read.  A character that is cut there does no harm."""
    spark.dataSource.register(Ends)
    files = spark.read.format("ends").option("size", size).load(path)
    times = lambda c: F.regexp_extract_all(F.col(c).cast("string"), F.lit("<time>([^<]+)</time>"), 1)
    return files.select("file", F.try_element_at(times("head"), F.lit(1)).alias("first"), F.try_element_at(times("tail"), F.lit(-1)).alias("last"))


def sensor_days(spark: SparkSession, path: str) -> DataFrame:
    """Samples of heart-rate files, one a day: (date, ts_ms, bpm)."""
    schema = "date string, samples array<array<bigint>>, resting int, max_day int, min_day int"
    days = spark.read.option("multiLine", True).schema(schema).json(path)
    return days.select("date", F.explode("samples").alias("s")).select(F.to_date("date").alias("date"), F.col("s")[0].alias("ts_ms"), F.col("s")[1].cast("int").alias("bpm"))


def of_dates(spark: SparkSession, path: str, dates: DataFrame, schema: str) -> DataFrame:
    """JSON rows, one file a day, of the dates of ``dates(date)``."""
    days = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("date", F.to_date("date"))
    return days.join(dates.select("date").distinct(), "date", "left_semi")


WELLNESS = "date string, status struct<vo2:struct<value:double,age:int>,devices:map<string,struct<timestamp:bigint,training_status:int,load:int>>>, battery struct<charged:int,drained:int,levels:array<array<int>>>, resting array<int>, sleep struct<total:int,deep:int,light:int,rem:int>, stress struct<avg:int,most:int>"


def lookups(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    """A JSON list of types or metadata; ``default`` where there is no such file or it is empty."""
    try:
        rows = spark.read.option("multiLine", True).schema(schema).json(path)
    except AnalysisException:  # no such path
        return spark.createDataFrame(default, schema)
    return rows if not rows.isEmpty() else spark.createDataFrame(default, schema)


def weights(spark: SparkSession, path: str) -> DataFrame:
    """Weights of well-formed dates, by date."""
    rows = spark.read.option("multiLine", True).schema("date string, weight_kg double").json(path)
    return rows.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).select(F.try_to_date("date").alias("date"), "weight_kg").where("date IS NOT NULL").orderBy("date")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions with their outer ring as (lat, lon); holes and further parts are left out."""
    rows = spark.read.option("multiLine", True).schema("id string, name string, default_type string, winter_default_type string, winter_months array<int>, assisted boolean, geometry struct<type:string,coordinates:array<array<array<double>>>>").json(path)
    ring = F.transform(F.col("geometry.coordinates")[0], lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    return rows.withColumn("ring", ring).drop("geometry")


def weather(days: DataFrame) -> DataFrame:
    """Hourly rows of columnar days: arrays of the same length, side by side."""
    return days.select(F.inline(F.arrays_zip("time", "temp", "rain", "wind", "code")))


def network(elements: DataFrame) -> DataFrame:
    """Ways of ``elements(type, id, lat, lon, nodes, tags)`` with their coordinates in order; unnamed ones and those of fewer than two go."""
    nodes = elements.where("type = 'node'").select(F.col("id").alias("node"), "lat", "lon")
    ways = elements.where("type = 'way'").select("id", F.try_element_at("tags", F.lit("name")).alias("name"), F.try_element_at("tags", F.lit("highway")).alias("highway"), F.posexplode("nodes").alias("i", "node"))
    found = ways.where("name IS NOT NULL AND name != ''").join(nodes, "node")
    out = found.groupBy("id", "name", "highway").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))), lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("coords"))
    return out.where(F.size("coords") >= 2)


def lifts(ways: DataFrame) -> DataFrame:
    """First and last place of each lift's line."""
    return ways.where(F.size("geometry") >= 2).select("name", F.element_at("geometry", 1).alias("a"), F.element_at("geometry", -1).alias("b"))


def changelog(spark: SparkSession, path: str) -> DataFrame:
    """Bullets of a changelog under the version above them; lines that continue a bullet are joined to it."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    w = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    version = F.nullif(F.regexp_extract("line", r"^## \[?([^\]\s]+)", 1), F.lit(""))
    rows = lines.withColumn("version", F.last(version, ignorenulls=True).over(w)).withColumn("bullet", F.sum(F.when(F.col("line").rlike(r"^[-*] "), 1).otherwise(0)).over(w))
    text = rows.where(F.col("line").rlike(r"^([-*] |  +\S)") & (F.col("bullet") > 0))
    out = text.groupBy("file", "version", "bullet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: F.trim(F.regexp_replace(s["line"], r"^[-*] ", ""))), " ").alias("text"))
    return out.select("version", F.col("bullet").cast("long").alias("bullet"), "text")
