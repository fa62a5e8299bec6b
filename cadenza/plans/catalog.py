"""All derived tables of one set of raw entities, and their files: from landed nodes or CSV to metrics in one run.

Entities are enriched once and kept as Parquet, by repository and week; every table is derived from these files. A refresh
brings whole weeks of some repositories and replaces those weeks only. CSV is what leaves: for each table a file for each repository
and one of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import exprs, time
from cadenza.operators import stats
from cadenza.plans import enrich, metrics
from cadenza.sources import files, landed, schemas
from cadenza.sources.named import write_named

#: The time that tells an entity's week, and how it is enriched.
ENTITIES = {
    "prs": ("created_at_dt", enrich.prs, schemas.PRS),
    "workflow_runs": ("run_started_dt", lambda raw: enrich.runs(raw, exprs.DELIVERY_BROAD), schemas.RUNS),
    "releases": ("release_time_dt", enrich.releases, schemas.RELEASES),
}


def derive(prs: DataFrame, runs: DataFrame, releases: DataFrame) -> dict[str, DataFrame]:
    """The weekly and monthly tables by name, from enriched entities. Nothing runs until a table is used."""
    ci, overhead, retries = metrics.ci_weekly(runs), metrics.review_overhead(prs), metrics.true_retry_weekly(runs)
    return {
        "review_overhead_weekly": overhead,
        "pr_cycle_weekly": metrics.cycle_weekly(prs),
        "ci_capped_weekly": metrics.ci_capped_weekly(runs),
        "merge_frequency_smoothed": metrics.merge_smoothed(prs),
        "review_duration_smoothed": metrics.review_duration_smoothed(overhead),
        "review_latency_smoothed": metrics.review_latency_smoothed(overhead),
        "ci_flakiness_smoothed": metrics.flakiness_smoothed(retries),
        "review_latency_box": metrics.latency_box(prs),
        "pr_churn_box": metrics.churn_box(prs),
        "pr_churn_outliers": metrics.churn_outliers(prs),
        "ci_retry_describe": metrics.retry_describe(runs),
        "run_time_range": stats.time_range(runs, "run_started_dt"),
        "ci_weekly": ci,
        "ci_failure_volatility_weekly": metrics.weekly_volatility(ci),
        "ci_flakiness_weekly": metrics.runs_per_sha_weekly(runs),
        "ci_flakiness_retry_weekly": metrics.sha_retry_weekly(runs),
        "ci_flakiness_true_retry_weekly": retries,
        "merge_frequency_weekly": metrics.merge_frequency(prs),
        "release_frequency_monthly": metrics.release_frequency(releases),
        "cd_workflow_weekly": metrics.cd_weekly(runs),
        "cd_workflow_success_weekly": metrics.cd_success_iso_weekly(runs),
        "time_to_release_monthly": metrics.time_to_release_monthly(prs, releases),
        "pr_churn_pr_level": metrics.churn_by_pr(prs),
        "review_duration_pr_level": metrics.review_duration_by_pr(prs),
    }


def summaries(derived: dict[str, DataFrame], prs: DataFrame, snapshots: DataFrame | None = None) -> dict[str, DataFrame]:
    """The comparison and the debt table from derived tables and enriched change requests."""
    overhead = derived.get("review_overhead_weekly")
    return {
        "repo_comparison": metrics.repo_comparison(derived["ci_weekly"], derived.get("pr_cycle_weekly"), overhead, prs),
        "debt_overview": metrics.debt_overview(prs, derived["ci_flakiness_retry_weekly"], overhead, snapshots),
    }


def store(raw: dict[str, DataFrame], path: str) -> None:
    """Enriches raw entities, each read once, and puts them in `path` by repository and week.

    A (repository, week) that has rows in `raw` is replaced by them whole; others stay. Rows without a repository or a time have a folder too.
    """
    for name, (at, enriched, _) in ENTITIES.items():
        if name in raw:
            found = enriched(raw[name]).withColumns({"slug": F.replace("repo_full", F.lit("/"), F.lit("__")), "week": F.date_format(time.week_monday(F.col(at)), "yyyy-MM-dd")})
            dealt = found.repartition("slug", "week")
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug", "week").parquet(f"{path}/{name}")


def stored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The enriched entities of `store`; one that was never stored is empty."""
    found = {}
    for name, (_, enriched, schema) in ENTITIES.items():
        columns = enriched(spark.createDataFrame([], schema)).schema
        whole = T.StructType([*columns, T.StructField("slug", T.StringType()), T.StructField("week", T.StringType())])
        there = files.exists(spark, f"{path}/{name}")
        found[name] = (spark.read.schema(whole).parquet(f"{path}/{name}") if there else spark.createDataFrame([], whole)).select(*columns.names)
    return found


def tables(entities: dict[str, DataFrame], snapshots: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every derived and summary table of enriched entities."""
    derived = derive(entities["prs"], entities["workflow_runs"], entities["releases"])
    return derived | summaries(derived, entities["prs"], snapshots)


def write(found: dict[str, DataFrame], out: str) -> list[str]:
    """Writes each table as `out`/table/owner__repo.csv for each repository, and all of it as `out`/table/all.csv."""
    for name, table in found.items():
        order = tuple(c for c in ("repo_full", "week", "month", "pr_number") if c in table.columns)
        write_named(table, f"{out}/{name}", F.col("repo_full"), order=order, combined="all")
    return list(found)


def collect(spark: SparkSession, raw: str, out: str) -> list[str]:
    """Reads prs.csv, workflow_runs.csv and releases.csv of folder `raw`, refreshes `out`/entities, writes each derived table under `out`; their names."""
    store({name: files.read_csv(spark, f"{raw}/{name}.csv", schema) for name, (_, _, schema) in ENTITIES.items()}, f"{out}/entities")
    return write(tables(stored(spark, f"{out}/entities")), out)


def entities(prs: DataFrame, runs: DataFrame, releases: DataFrame, since: str | None = None) -> dict[str, DataFrame]:
    """Raw entities of all repositories from what the connectors return: (owner, repo, node)."""
    return {
        "prs": landed.prs(landed.parsed(prs, schemas.PR_NODE), since=since),
        "workflow_runs": landed.runs(landed.parsed(runs, schemas.RUN_NODE), since=since),
        "releases": landed.releases(landed.parsed(releases, schemas.RELEASE_NODE), since=since),
    }


def collect_nodes(prs: DataFrame, runs: DataFrame, releases: DataFrame, out: str, since: str | None = None) -> list[str]:
    """From connector to metric: refreshes `out`/entities with what was fetched, and writes every derived table of all that is stored."""
    store(entities(prs, runs, releases, since), f"{out}/entities")
    return write(tables(stored(prs.sparkSession, f"{out}/entities")), out)
