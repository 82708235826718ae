"""Numbers over a whole result, without a task that has all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with the place of each row, from 1, in an order over all rows.

    Rows are dealt into ranges of the order and sorted there; each range's
    number of rows (a row for each partition) tells where the next one begins.
    Rows that tie in the whole order are numbered as they come.
    """
    at = F.monotonically_increasing_id()  # the partition, shifted by 33 bits, and the place in it
    d = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    placed = d.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_part", "_before", "_at")
