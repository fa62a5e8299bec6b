"""The counting metrics as streams: weekly windows with a watermark.

Monday weeks are seven-day windows offset by four days from the epoch (a Thursday), Tuesday weeks by five.
Trailing windows over such weeks are in `trailing`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import exprs

OFFSETS = {"monday": "4 days", "tuesday": "5 days"}


def weekly(stream: DataFrame, time: str, aggregates: list[Column], bucket: str = "monday", late: str = "7 days", key: str = "repo_full") -> DataFrame:
    """`aggregates` by key and week; rows later than `late` behind the newest are dropped."""
    window = F.window(time, "7 days", "7 days", OFFSETS[bucket])
    # A watermark takes timestamps with a zone only; the session's zone is UTC.
    rows = stream.where(F.col(key).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(key, window.alias("w")).agg(*aggregates)
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("week"), *(c for c in out.columns if c not in (key, "w")))


def merge_frequency(prs: DataFrame, bucket: str = "monday", late: str = "7 days") -> DataFrame:
    merged = prs.where(exprs.equals(F.col("state"), "MERGED"))
    return weekly(merged, "merged_at_dt", [F.count("pr_number").alias("merge_frequency")], bucket, late)


def failure_rate(runs: DataFrame, bucket: str = "monday", late: str = "7 days") -> DataFrame:
    failed = exprs.rate(exprs.as_flag(F.col("is_failure"), True)).alias("failure_rate")
    return weekly(runs, "run_started_dt", [failed, F.count("*").alias("n")], bucket, late)


def delivery_runs(runs: DataFrame, bucket: str = "monday", late: str = "7 days") -> DataFrame:
    failed = exprs.rate(F.col("is_failure"))
    return weekly(runs.where("is_cd_workflow"), "run_started_dt", [F.count("run_id").alias("cd_runs"), failed.alias("cd_failure_rate"), (1 - failed).alias("cd_success_rate")], bucket, late)
