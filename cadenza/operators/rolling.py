"""Trailing windows over rows of a series, with a least number of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    # median() takes no ordered frame; percentile does and is as exact.
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def rolling(value: Column, how: str, rows: int, least: int, key: str = "repo_full", order: str = "week") -> Column:
    """`how` over this row and the rows - 1 before it; null with fewer than `least` non-null values.

    The frame counts rows, not time: missing weeks are not filled.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) >= least, AGGREGATES[how](value).over(w))


def smoothed(series: DataFrame, value: str, name: str, how: str, rows: int = 4, least: int = 2, order: str = "week") -> DataFrame:
    """`series` without null values and with their trailing aggregate."""
    return series.dropna(subset=[value]).withColumn(name, rolling(F.col(value), how, rows, least, order=order))
