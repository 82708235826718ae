"""The three medians, percentiles by index, and helpers of rounding and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median_avg(values: Column) -> Column:
    """Median of an array; the two middle values of an even number are averaged; null if empty."""
    s, n = F.sort_array(values), F.size(values)
    low, high = F.try_element_at(s, F.floor((n + 1) / 2).cast("int")), F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, low).otherwise((low + high) / 2))


def median_upper(values: Column) -> Column:
    """Median of an array; the upper of the two middle values; null if empty."""
    return F.when(F.size(values) > 0, F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int")))


def percentile_index(n: Column, q: float) -> Column:
    """Place, from 0, of the percentile in n sorted values."""
    return F.least(n - 1, F.floor(n * F.lit(q)))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)
