"""Table functions that SQL can call: detectors over the arrays of one track, and the exponentially weighted mean."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="seq int, assisted boolean")
class Detect:
    """``detect(algorithm, dt, dist, ele_delta, speed)``: a flag for each leg; the arrays are in the order of the track."""

    def eval(self, algorithm: str, dt: list, dist: list, ele_delta: list, speed: list) -> Iterator[tuple[int, bool]]:
        from wayfold.operators.kernels import DETECTORS

        columns = [np.array([np.nan if v is None else v for v in x or []], float) for x in (dt, dist, ele_delta, speed)]
        nowhere = np.full(len(columns[0]), np.nan)  # without positions no climb is straight
        if len(columns[0]):
            for i, flag in enumerate(DETECTORS[algorithm](*columns, nowhere, nowhere)):
                yield i, bool(flag)


#: SQL of the weighted mean over an array of daily values, seed 0: a fold, for use where a window can't stand.
EWMA = "aggregate({values}, struct(cast(0 as double) as s, cast(array() as array<double>) as a), (x, v) -> struct(x.s + (v - x.s) * (1 - exp(-1D / {tau})) as s, concat(x.a, array(x.s + (v - x.s) * (1 - exp(-1D / {tau})))) as a), x -> x.a)"


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL by their names."""
    spark.udtf.register("detect", Detect)
