"""Typed and derived columns of the raw entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import exprs, time
from cadenza.operators.columns import pick_column


def prs(raw: DataFrame) -> DataFrame:
    """Parses the times that are still text, then adds durations, merged flag and churn."""
    times = {"created_at_dt": "created_at", "merged_at_dt": "merged_at", "closed_at_dt": "closed_at", "first_review_dt": "first_review_at"}
    df = raw.withColumns({new: time.parsed(F.col(old)) for new, old in times.items() if new not in raw.columns})
    df = df.withColumn("done_at_dt", F.coalesce("merged_at_dt", "closed_at_dt"))
    return df.withColumns({
        "is_merged": exprs.equals(F.col("state"), "MERGED"),
        "pr_cycle_hours": time.elapsed(F.col("created_at_dt"), F.col("done_at_dt"), "hours"),
        "review_latency_hours": time.elapsed(F.col("created_at_dt"), F.col("first_review_dt"), "hours"),
        "review_duration_hours": time.elapsed(F.col("first_review_dt"), F.col("done_at_dt"), "hours"),
        "pr_churn": exprs.churn(F.col("additions"), F.col("deletions")),
    })


def runs(raw: DataFrame, pattern: str = exprs.DELIVERY_BROAD) -> DataFrame:
    """Start and end, minutes (computed where missing), failure flag and delivery flag."""
    df = raw.withColumns({new: time.parsed(F.col(old)) for new, old in (("run_started_dt", "run_started_at"), ("updated_dt", "updated_at")) if new not in raw.columns})
    minutes = time.elapsed(F.col("run_started_dt"), F.col("updated_dt"), "minutes")
    name = pick_column(df, ["workflow_name", "name"])
    if name is None:
        raise ValueError("runs have neither workflow_name nor name")
    return df.withColumns({
        "ci_duration_min": F.coalesce("ci_duration_min", minutes) if "ci_duration_min" in df.columns else minutes,
        "is_failure": exprs.is_in(F.col("conclusion"), exprs.FAILED) if "is_failure" not in df.columns else F.col("is_failure"),
        "is_cd_workflow": exprs.matches(F.col(name), pattern),
    })


def releases(raw: DataFrame) -> DataFrame:
    """The release time: published, or else created."""
    df = raw.withColumns({new: time.parsed(F.col(old)) for new, old in (("published_at_dt", "published_at"), ("created_at_dt", "created_at")) if new not in raw.columns})
    return df.withColumn("release_time_dt", F.coalesce("published_at_dt", "created_at_dt"))
