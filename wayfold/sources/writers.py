"""Writers, and changes of stored rows as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gpx(points: DataFrame, path: str) -> None:
    """One GPX element for each activity of ``points(activity_id, seq, lat, lon, ele, time)``."""
    p = F.struct(F.col("seq"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "ele", "time")
    tracks = points.groupBy("activity_id").agg(F.transform(F.array_sort(F.collect_list(p)), lambda s: s.dropFields("seq")).alias("trkpt"))
    rows = tracks.select(F.struct(F.col("activity_id").cast("string").alias("name"), F.struct("trkpt").alias("trkseg")).alias("trk"))
    rows.write.format("xml").option("rootTag", "tracks").option("rowTag", "gpx").mode("overwrite").save(path)


def table(df: DataFrame, path: str, by: str | None = None) -> None:
    """A Parquet table, overwritten whole, or only the partitions that ``df`` has rows of."""
    w = df.write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(by) if by else w).parquet(path)


def backed_up(rows: DataFrame, path: str, today: str, keep: int = 7) -> None:
    """A table with a copy for each day: today's is written anew, those of ``keep`` days ago and before go.

    Copies are partitions of one folder, so that readers prune by date.
    """
    spark = rows.sparkSession
    rows.withColumn("backup_date", F.to_date(F.lit(today))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backup_date").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = spark.read.parquet(path).where(F.col("backup_date") <= F.date_sub(F.to_date(F.lit(today)), keep)).select("backup_date").distinct().collect()  # a row a day
    for r in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"backup_date={r[0]}"), True)


def accepted(files: DataFrame, points: DataFrame, taken: DataFrame, most_bytes: int = 30 << 20) -> DataFrame:
    """Uploads of ``files(file, name, length)`` with what becomes of them: too large, unreadable (no points), or accepted under a name that no other has.

    A name that is taken gets the first free number; of uploads of the same
    name the first by ``file`` keeps it.
    """
    good = points.select("file").distinct().withColumn("_ok", F.lit(True))
    f = files.join(good, "file", "left").withColumn("status", F.when(F.col("length") > most_bytes, "too large").when(F.col("_ok").isNull(), "unreadable").otherwise("accepted")).drop("_ok")
    stem, tail = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    # numbers that are taken: the name itself is 0
    used = taken.select(F.regexp_replace("name", r"_\d+(\.[^.]*)?$", "$1").alias("base"), F.coalesce(F.try_to_number(F.regexp_extract("name", r"_(\d+)(\.[^.]*)?$", 1), F.lit("999999999")).cast("int"), F.lit(0)).alias("k"))
    most = used.groupBy(F.col("base").alias("name")).agg(F.max("k").alias("most"))
    w = Window.partitionBy("name", "status").orderBy("file")
    n = f.join(most, "name", "left").withColumn("k", F.coalesce(F.col("most") + 1, F.lit(0)) + F.row_number().over(w) - 1)
    stored = F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("k").cast("string"), tail))
    return n.select("file", "name", "length", "status", F.when(F.col("status") == "accepted", stored).alias("stored_as"))


def without_archived(rows: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    return rows.join(archived.select(key).distinct(), key, "left_anti")


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the patch's values that aren't null."""
    cols = [c for c in patch.columns if c != key]
    p = patch.withColumnsRenamed({c: f"__{c}" for c in cols})
    return rows.join(p, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in rows.columns))


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with those of ``new`` in the place of those of the same key."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new")))).where("_r = 1").drop("_new", "_r")


def cascaded(rows: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Rows with ``column`` emptied where it refers to a key that is gone."""
    g = gone.select(F.col(key).alias(column), F.lit(True).alias("_gone")).distinct()
    return rows.join(g, column, "left").select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns))


def fingerprints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of the named columns, in the order of their names."""
    return rows.withColumn("fingerprint", F.md5(F.to_json(F.struct(*sorted(columns)))))
