"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, summed in double precision."""
    def square(x: Column, y: Column) -> Column:
        difference = x.cast("double") - y.cast("double")
        return difference * difference

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda total, x: total + x)
