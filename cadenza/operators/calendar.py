"""Snapshot calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = {"monthly": 1, "quarterly": 3}


def snapshot_dates(spark: SparkSession, start: str, end: str, frequency: str) -> DataFrame:
    """The first of each month, or of each third month, from the month of `start`; `end` is excluded."""
    if frequency not in STEPS:
        raise ValueError(f"frequency is {frequency}; it can be {sorted(STEPS)}")
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    dates = F.sequence(F.trunc(a, "MM"), F.greatest(b, F.trunc(a, "MM")), F.expr(f"INTERVAL {STEPS[frequency]} MONTH"))
    return spark.range(1).select(F.explode(dates).alias("snapshot_date")).where(F.col("snapshot_date") < b).withColumn("snapshot_date", F.col("snapshot_date").cast("timestamp_ntz"))


def dates_by_entity(rows: DataFrame, time: str, frequency: str, key: str = "repo_full") -> DataFrame:
    """(key, snapshot_date): each entity's own calendar, from the month of its first row up to its last one."""
    if frequency not in STEPS:
        raise ValueError(f"frequency is {frequency}; it can be {sorted(STEPS)}")
    spans = rows.dropna(subset=[key, time]).groupBy(key).agg(F.trunc(F.min(time), "MM").alias("first"), F.max(time).cast("date").alias("last"))
    days = F.sequence(F.col("first"), F.col("last"), F.expr(f"INTERVAL {STEPS[frequency]} MONTH"))
    return spans.select(key, F.explode(days).alias("day")).select(key, F.col("day").cast("timestamp_ntz").alias("snapshot_date"))
