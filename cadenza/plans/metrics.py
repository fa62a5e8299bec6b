"""The metrics: each takes enriched entities and returns a lazy DataFrame.

Rows with a null group key take part in no group. Percentiles are exact: of whole repositories and tables by counted ranks
(`stats.percentiles_of`), of a repository's week or month as aggregates, which keep a map of the group's distinct values
in a task. Where weeks are too large for that, `by_ranks` has these counted too, all of a table's measures in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import exprs, time
from cadenza.operators import calendar, stats
from cadenza.operators.asof import next_after
from cadenza.operators.columns import pick_column, require_columns, select_present
from cadenza.operators.rolling import rolling, smoothed

REPO = "repo_full"


def _bucketed(df: DataFrame, at: str, bucket: str, name: str = "week") -> DataFrame:
    return df.withColumn(name, time.BUCKETS[bucket](F.col(at))).dropna(subset=[REPO, name])


def _medians(df: DataFrame, keys: list[str], medians: dict[str, str], others: list[Column], by_ranks: bool) -> DataFrame:
    """(keys, medians (new name: column), other aggregates) in this order."""
    if not by_ranks:
        return df.groupBy(*keys).agg(*(F.median(stats.known(F.col(c))).alias(name) for name, c in medians.items()), *others)
    counted = df.groupBy(*keys).agg(*others)
    found = counted.join(stats.grouped_medians(df, medians, keys), keys, "left")
    return found.select(*keys, *medians, *(c for c in counted.columns if c not in keys))


def _p95(value: Column) -> Column:
    return F.percentile(value, F.lit(0.95))


# Change requests


def merge_frequency(prs: DataFrame, bucket: str = "monday", name: str = "merge_frequency") -> DataFrame:
    merged = _bucketed(prs.where(exprs.equals(F.col("state"), "MERGED")), "merged_at_dt", bucket)
    return merged.groupBy(REPO, "week").agg(F.count("pr_number").alias(name))


def review_overhead(prs: DataFrame, by_ranks: bool = False) -> DataFrame:
    medians = {
        "pr_cycle_med_h": "pr_cycle_hours", "review_latency_med_h": "review_latency_hours", "review_duration_med_h": "review_duration_hours",
        "review_count_med": "review_count", "pr_churn_med": "pr_churn",
    }
    counts = [F.count_if("is_merged").alias("merged_prs"), F.count("pr_number").alias("prs_total")]
    return _medians(_bucketed(prs, "created_at_dt", "monday"), [REPO, "week"], medians, counts, by_ranks)


def review_overhead_short(prs: DataFrame) -> DataFrame:
    return review_overhead(prs).select(REPO, "week", "review_count_med", "review_latency_med_h", "review_duration_med_h", "prs_total")


def churn_by_pr(prs: DataFrame) -> DataFrame:
    require_columns(prs, [REPO, "additions", "deletions"], "change requests")
    out = prs.withColumn("pr_churn", exprs.churn(F.col("additions"), F.col("deletions")))
    return out.select(REPO, "pr_number", "additions", "deletions", "pr_churn")


def review_duration_by_pr(prs: DataFrame) -> DataFrame:
    return prs.select(REPO, "pr_number", "created_at_dt", "first_review_dt", "done_at_dt", "review_duration_hours")


def cycle_weekly(prs: DataFrame, by_ranks: bool = False) -> DataFrame:
    """Median cycle hours by Tuesday week of creation, and their trailing median over four rows."""
    weekly = _medians(_bucketed(prs.dropna(subset=["pr_cycle_hours"]), "created_at_dt", "tuesday"), [REPO, "week"], {"pr_cycle_hours": "pr_cycle_hours"}, [F.count("*").alias("rows")], by_ranks).drop("rows")
    return smoothed(weekly, "pr_cycle_hours", "pr_cycle_smooth", "median")


def merge_smoothed(prs: DataFrame) -> DataFrame:
    return smoothed(merge_frequency(prs, "tuesday", "merge_count"), "merge_count", "merge_smooth", "mean")


def review_duration_smoothed(weekly: DataFrame) -> DataFrame:
    require_columns(weekly, [REPO, "week", "review_duration_med_h"], "weekly review overhead")
    return smoothed(weekly.select(REPO, "week", "review_duration_med_h"), "review_duration_med_h", "review_duration_smooth", "median")


def review_latency_smoothed(weekly: DataFrame) -> DataFrame:
    require_columns(weekly, [REPO, "week", "review_latency_med_h"], "weekly review overhead")
    return smoothed(weekly.select(REPO, "week", "review_latency_med_h"), "review_latency_med_h", "review_latency_smooth", "median")


def latency_box(prs: DataFrame) -> DataFrame:
    return stats.box(prs, pick_column(prs, ["review_latency_hours", "review_latency_h"]) or "review_latency_hours")


def churn_box(prs: DataFrame) -> DataFrame:
    return stats.box(prs.where("pr_churn > 0"), "pr_churn")


def churn_outliers(prs: DataFrame) -> DataFrame:
    """The single points that the box plot of churn draws beyond its whiskers."""
    return stats.outliers(prs.where("pr_churn > 0"), "pr_churn")


# Workflow runs


def ci_weekly(runs: DataFrame, by_ranks: bool = False) -> DataFrame:
    """All durations, however long; runs without one are left out."""
    rows = _bucketed(runs.dropna(subset=["ci_duration_min"]), "run_started_dt", "monday")
    others = [exprs.rate(F.col("is_failure")).alias("ci_failure_rate"), F.count("run_id").alias("ci_runs")]
    return _medians(rows, [REPO, "week"], {"ci_duration_med_min": "ci_duration_min"}, others, by_ranks)


def ci_capped_weekly(runs: DataFrame, most_minutes: float = 360, by_ranks: bool = False) -> DataFrame:
    """Runs of 0 to `most_minutes` minutes, by Tuesday week."""
    rows = _bucketed(runs.where(F.col("ci_duration_min").between(0, most_minutes)), "run_started_dt", "tuesday")
    others = [exprs.rate(exprs.as_flag(F.col("is_failure"), True)).alias("failure_rate"), F.count("*").alias("n")]
    return _medians(rows, [REPO, "week"], {"ci_duration_med": "ci_duration_min"}, others, by_ranks)


def ci_capped_p99(runs: DataFrame) -> DataFrame:
    """The other cap: durations up to the overall 99th percentile, by Tuesday week."""
    known = runs.dropna(subset=["ci_duration_min"])
    cap = stats.percentiles(known, F.col("ci_duration_min"), [0.99]).select(F.col("p")[0].alias("cap"))
    return ci_capped_weekly(known.join(F.broadcast(cap), F.col("ci_duration_min") <= F.col("cap")), float("inf"))  # cap has one row


def runs_per_sha_weekly(runs: DataFrame) -> DataFrame:
    per = _bucketed(runs.dropna(subset=["head_sha"]), "run_started_dt", "monday").groupBy(REPO, "week", "head_sha").agg(F.count("*").alias("runs_per_sha"))
    return per.groupBy(REPO, "week").agg(F.avg("runs_per_sha").alias("avg_runs_per_sha"), _p95(F.col("runs_per_sha")).alias("p95_runs_per_sha"))


def runs_per_key(runs: DataFrame, keys: list[str], name: str = "runs_per_key") -> DataFrame:
    """Runs of each (repo, Tuesday week, keys...); rows with a null key are left out."""
    return _bucketed(runs.dropna(subset=keys), "run_started_dt", "tuesday").groupBy(REPO, "week", *keys).agg(F.count("*").alias(name))


def _retry_weekly(runs: DataFrame, keys: list[str], share: str, unit: str, n: str) -> DataFrame:
    per = runs_per_key(runs, keys, "r")
    return per.groupBy(REPO, "week").agg(
        exprs.rate(F.col("r") > 1).alias(share), F.avg("r").alias(f"avg_runs_per_{unit}"), _p95(F.col("r")).alias(f"p95_runs_per_{unit}"), F.count("r").alias(n)
    )


def _retry_keys(runs: DataFrame) -> list[str]:
    name = pick_column(runs, ["workflow_name", "name"])
    if name is None:
        raise ValueError("runs have neither workflow_name nor name")
    return ["head_sha", name, "event"]


def true_retry_weekly(runs: DataFrame) -> DataFrame:
    """A retry is a further run of the same commit, workflow and event."""
    return _retry_weekly(runs, _retry_keys(runs), "share_with_retry", "key", "n_keys")


def sha_retry_weekly(runs: DataFrame) -> DataFrame:
    return _retry_weekly(runs, ["head_sha"], "share_shas_with_retry", "sha", "n_sha")


def retry_describe(runs: DataFrame) -> DataFrame:
    return stats.describe(runs_per_key(runs, _retry_keys(runs)), "runs_per_key")


def failure_volatility(runs: DataFrame) -> DataFrame:
    """Weekly failure rate and its trailing deviation over eight rows, from the fourth on."""
    weekly = _bucketed(runs, "run_started_dt", "monday")
    count = F.count("run_id" if "run_id" in runs.columns else "run_started_dt").alias("n")
    weekly = weekly.groupBy(REPO, "week").agg(exprs.rate(exprs.as_flag(F.col("is_failure"), True)).alias("failure_rate"), count)
    return weekly.withColumn("failure_volatility_8w", rolling(F.col("failure_rate"), "std", 8, 4))


def weekly_volatility(ci: DataFrame) -> DataFrame:
    """The same deviation over the rates of `ci_weekly`."""
    return ci.select(REPO, "week", "ci_failure_rate").withColumn("ci_failure_volatility_8w", rolling(F.col("ci_failure_rate"), "std", 8, 4))


def cd_weekly(runs: DataFrame) -> DataFrame:
    return _bucketed(runs.where("is_cd_workflow"), "run_started_dt", "monday").groupBy(REPO, "week").agg(
        F.count("run_id").alias("cd_runs"), exprs.rate(F.col("is_failure")).alias("cd_failure_rate"),
        (1 - exprs.rate(F.col("is_failure"))).alias("cd_success_rate"), F.median("ci_duration_min").alias("cd_duration_med_min"),
    )


def cd_success_iso_weekly(runs: DataFrame, pattern: str = exprs.DELIVERY_BOUNDED) -> DataFrame:
    """The same with the word-bounded pattern and a week that carries its zone."""
    name = _retry_keys(runs)[1]
    cd = _bucketed(runs.where(exprs.matches(F.col(name), pattern)), "run_started_dt", "iso_utc")
    out = cd.groupBy(REPO, "week").agg(
        F.count("*").alias("cd_runs"), exprs.rate(exprs.as_flag(F.col("is_failure"), True)).alias("cd_failure_rate"), F.median("ci_duration_min").alias("cd_duration_med_min")
    )
    return out.withColumn("cd_success_rate", 1 - F.col("cd_failure_rate"))


def flakiness_smoothed(weekly: DataFrame, least_keys: int = 20) -> DataFrame:
    """Weeks with enough keys, then the trailing mean of the retry share."""
    kept = weekly.where(F.col("n_keys") >= least_keys).select(REPO, "week", "share_with_retry", "n_keys")
    return smoothed(kept, "share_with_retry", "share_smooth", "mean")


# Releases


def release_frequency(releases: DataFrame) -> DataFrame:
    monthly = _bucketed(releases, "release_time_dt", "month", "month")
    return monthly.groupBy(REPO, "month").agg(F.count("release_id").alias("release_frequency"))


def time_to_release(prs: DataFrame, releases: DataFrame) -> DataFrame:
    """(…, release_time, time_to_release_days) of each merged change request that a release followed."""
    require_columns(prs, [REPO, "merged_at_dt", "state"], "change requests")
    require_columns(releases, [REPO, "release_time_dt"], "releases")
    merged = prs.where(exprs.equals(F.col("state"), "MERGED"))
    found = next_after(merged, releases, REPO, "merged_at_dt", "release_time_dt", "release_time")
    return found.withColumn("time_to_release_days", time.elapsed(F.col("merged_at_dt"), F.col("release_time"), "days"))


def time_to_release_monthly(prs: DataFrame, releases: DataFrame, by_ranks: bool = False) -> DataFrame:
    found = _bucketed(time_to_release(prs, releases), "merged_at_dt", "month", "month")
    return _medians(found, [REPO, "month"], {"time_to_release_med_days": "time_to_release_days"}, [F.count("time_to_release_days").alias("n")], by_ranks)


def time_to_release_series(monthly: DataFrame) -> DataFrame:
    """What the chart of time to release shows: months with a value, in order."""
    require_columns(monthly, [REPO, "month", "time_to_release_med_days"], "monthly time to release")
    return monthly.dropna(subset=["time_to_release_med_days"]).orderBy("month", REPO)


# Snapshots, tables and constants

SNAPSHOT_COLUMNS = ("repo_full", "snapshot_date", "commit", "code_smells", "sqale_debt_ratio", "complexity", "duplicated_lines_density", "sqale_rating", "sqale_index")


def snapshot_calendar(rows: DataFrame, time: str, frequency: str = "monthly") -> DataFrame:
    """Each repository's snapshot dates, as far as its rows reach."""
    return calendar.dates_by_entity(rows, time, frequency, REPO)


def snapshots_tidy(raw: DataFrame) -> DataFrame:
    """The known columns, with a parsed date and numbers where they can be read."""
    df = select_present(raw, SNAPSHOT_COLUMNS)
    numbers = [c for c in df.columns if c not in ("repo_full", "snapshot_date", "commit")]
    typed = {c: F.expr(f"try_cast(`{c}` AS double)") for c in numbers}
    if "snapshot_date" in df.columns:
        typed["snapshot_date"] = time.parsed(F.col("snapshot_date").cast("string"))
    return df.withColumns(typed)


def _by_repo(df: DataFrame, value: str, name: str, mean: bool = False) -> DataFrame:
    if not mean:
        return stats.medians(df, value, name)
    return df.dropna(subset=[REPO]).groupBy(REPO).agg(F.avg(F.col(value).cast("double")).alias(name))


def repo_comparison(ci: DataFrame, cycle_weekly: DataFrame | None = None, overhead: DataFrame | None = None, prs: DataFrame | None = None) -> DataFrame:
    """Medians of weekly medians. The cycle comes from the first of weekly cycles, weekly overhead with a cycle column, change requests."""
    minutes, failed = pick_column(ci, ["ci_duration_med_min", "ci_duration_med"]), pick_column(ci, ["ci_failure_rate", "failure_rate"])
    if minutes is None or failed is None:
        raise ValueError(f"weekly CI has no duration or failure column; it has {ci.columns}")
    left = ci.dropna(subset=[REPO]).groupBy(REPO).agg(F.median(minutes).alias("median_ci_duration_min"), F.median(failed).alias("median_failure_rate"))
    options = ((cycle_weekly, ["pr_cycle_hours", "pr_cycle_med_h"]), (overhead, ["pr_cycle_med_h", "pr_cycle_hours"]), (prs, ["pr_cycle_hours"]))
    found = next(((df, c) for df, names in options if df is not None and (c := pick_column(df, names))), None)
    if found is None:
        raise FileNotFoundError("no source of cycle times: weekly cycles, weekly overhead or change requests")
    return left.join(_by_repo(found[0].dropna(subset=[found[1]]), found[1], "median_pr_cycle_h"), REPO, "left")


def debt_overview(prs: DataFrame, flakiness: DataFrame, overhead: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """Churn, runs per commit, review overhead and debt ratio of every repo that any input has."""
    none = prs.limit(0).select(REPO)
    churned = prs if "pr_churn" in prs.columns else churn_by_pr(prs)
    flaky = pick_column(flakiness, ["avg_runs_per_sha", "runs_per_sha_avg", "avg_runs_sha"])
    if flaky is None:
        raise ValueError(f"flakiness has no column of runs per commit; it has {flakiness.columns}")
    review = overhead and pick_column(overhead, ["review_latency_med_h", "review_latency_median_h", "review_duration_med_h", "review_duration_median_h"])
    if review:
        reviewed = _by_repo(overhead, review, "review_overhead_med_h")
    elif "review_latency_hours" in prs.columns:
        reviewed = _by_repo(prs.dropna(subset=["review_latency_hours"]), "review_latency_hours", "review_overhead_med_h")
    else:
        reviewed = none.withColumn("review_overhead_med_h", F.lit(None).cast("double"))
    debt = snapshots and pick_column(snapshots, ["sqale_debt_ratio", "debt_ratio"])
    owed = _by_repo(snapshots, debt, "debt_ratio_med") if debt else none.withColumn("debt_ratio_med", F.lit(None).cast("double"))
    out = _by_repo(churned, "pr_churn", "pr_churn_med")
    for other in (_by_repo(flakiness, flaky, "ci_runs_per_sha", mean=True), reviewed, owed):
        out = out.join(other, REPO, "outer")
    return out


# The capabilities that each metric makes visible, and how observable each capability is, from 0 to 5.
CAPABILITIES_OF = {
    "PR Cycle Time": ["Fast Feedback"],
    "Review Latency": ["Fast Feedback", "Code Review"],
    "Merge Frequency": ["Trunk-based Dev"],
    "CI Duration": ["Continuous Integration"],
    "CI Failure Rate": ["Continuous Integration", "Automated Testing"],
}
OBSERVABILITY = {
    "Continuous Integration": 5,
    "Trunk-based Development": 4,
    "Fast Feedback": 5,
    "Automated Testing": 4,
    "Observability": 2,
    "Lean Management": 1,
    "Culture": 0,
}


def capability_matrix(spark: SparkSession) -> DataFrame:
    """(metric, capability, mapped): 1 where the metric makes the capability visible, else 0."""
    shown = dict.fromkeys(c for found in CAPABILITIES_OF.values() for c in found)
    rows = [(m, c, int(c in found)) for m, found in CAPABILITIES_OF.items() for c in shown]
    return spark.createDataFrame(rows, "metric string, capability string, mapped int")


def observability(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OBSERVABILITY.items()), "capability string, score int")
