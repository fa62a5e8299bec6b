"""The metrics' entities drawn from the generic test tables, as DataFrames and as the same tables in SQL.

Change requests come from orders and their lines, workflow runs from events (a month) or from orders (years,
for rolling windows), releases from partly filled orders. Some values are nulled to exercise null rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans import enrich


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_review_dt"), F.max("l_shipdate").alias("done"), F.sum("l_quantity").alias("additions"),
        F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("deletions"), F.count("*").alias("review_count"),
    )
    status = F.col("o_orderstatus")
    raw = _read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderpriority").alias("repo_full"), F.col("o_orderkey").alias("pr_number"), F.col("o_orderdate").alias("created_at_dt"),
        F.when(status == "F", F.col("done")).alias("merged_at_dt"), F.when(status.isin("F", "P"), F.col("done")).alias("closed_at_dt"),
        F.when(status == "F", "MERGED").when(status == "P", "CLOSED").otherwise("OPEN").alias("state"),
        "first_review_dt", "additions", "deletions", "review_count",
    )
    return enrich.prs(raw)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    raw = _read(spark, sf_dir, "events").select(
        F.concat(F.lit("repo"), F.col("user_id") % 3).alias("repo_full"), n.alias("run_id"), kind.alias("workflow_name"),
        F.when(n % 13 != 0, F.col("props")).alias("event"), F.col("user_id").cast("string").alias("head_sha"), F.col("ts").alias("run_started_dt"),
        F.col("ts").alias("updated_dt"), F.when(kind == "error", "failure").when(kind != "signup", "success").alias("conclusion"),
        F.when(n % 17 != 0, F.col("value")).otherwise(F.when(n % 2 == 0, 400.0)).alias("ci_duration_min"),
    )
    return enrich.runs(raw, "(?i)(purchase|sign)")


def long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("repo_full"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("run_started_dt"),
        F.when(F.col("o_orderkey") % 11 != 0, status == "F").alias("is_failure"),
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    raw = _read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P").select(
        F.when(n % 7 != 0, F.col("o_orderpriority")).alias("repo_full"), n.alias("release_id"),
        F.when(n % 5 != 0, F.col("o_orderdate")).alias("published_at_dt"), F.col("o_orderdate").alias("created_at_dt"),
    )
    return enrich.releases(raw)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text measures by customer, some of which are no numbers."""
    return _read(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("repo_full"), F.lit("2024-02-01T00:00:00Z").alias("snapshot_date"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("sqale_debt_ratio"), F.col("c_name").alias("other"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """(owner, repo, id, created, node): change requests, runs and releases as nodes in JSON, as a web interface returns them."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reviewed = F.struct(F.struct(F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("login")).alias("author"), F.when(F.col("l_linenumber") % 3 > 0, stamp("l_shipdate")).when(F.col("l_linenumber") == 3, F.lit("")).alias("createdAt"))
    reviews = read("lineitem").groupBy("l_orderkey").agg(F.collect_list(reviewed).alias("nodes"))
    n, customer = F.col("o_orderkey"), F.col("o_custkey")
    node = F.to_json(F.struct(
        n.alias("number"), F.col("o_orderpriority").alias("title"), F.lit("main").alias("baseRefName"), F.concat(F.lit("topic/"), n).alias("headRefName"), stamp("o_orderdate").alias("createdAt"), F.when(F.col("o_orderstatus") == "F", stamp("o_orderdate")).alias("mergedAt"),
        F.when(F.col("o_orderstatus") == "F", "MERGED").otherwise("OPEN").alias("state"), F.struct((n % 7).alias("totalCount")).alias("commits"),
        F.when(n % 5 > 0, F.struct(F.concat(F.lit("u"), customer).alias("login"))).alias("author"), F.when(F.col("nodes").isNotNull(), F.struct("nodes")).alias("reviews"),
    ))
    prs = read("orders").join(reviews, n == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("o"), customer % 2).alias("owner"), F.concat(F.lit("r/"), customer % 3).alias("repo"), n.alias("id"), stamp("o_orderdate").alias("created"), node.alias("node"))
    numbers = F.array(F.struct(F.col("user_id").alias("number")), F.struct(F.lit(None).cast("long").alias("number")), F.struct((F.col("event_id") + 1).alias("number")))
    runs = read("events").select(F.lit("o0").alias("owner"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("repo"), F.col("event_id").alias("id"), stamp("ts").alias("created"), F.to_json(F.struct(
        F.col("event_id").alias("id"), F.col("event_type").alias("name"), stamp("ts").alias("created_at"), F.when(F.col("event_id") % 4 > 0, numbers).alias("pull_requests"))).alias("node"))
    releases = read("orders").where("o_orderstatus = 'P'").select(F.lit("o0").alias("owner"), F.concat(F.lit("r"), customer % 3).alias("repo"), n.alias("id"), F.coalesce(F.when(n % 4 > 0, stamp("o_orderdate")), stamp("o_orderdate")).alias("created"), F.to_json(F.struct(
        n.alias("id"), F.col("o_orderpriority").alias("tag_name"), stamp("o_orderdate").alias("created_at"), F.when(n % 4 > 0, stamp("o_orderdate")).alias("published_at"))).alias("node"))
    return {"prs": prs, "workflow_runs": runs, "releases": releases}


#: The same entities for DuckDB; durations are fractional from microseconds.
SQL = r"""
lines AS (
  SELECT l_orderkey, min(l_shipdate) AS first_review_dt, max(l_shipdate) AS done, sum(l_quantity) AS additions,
         sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS deletions, count(*) AS review_count
  FROM lineitem GROUP BY l_orderkey),
raw_prs AS (
  SELECT o_orderpriority AS repo_full, o_orderkey AS pr_number, o_orderdate AS created_at_dt, CASE WHEN o_orderstatus = 'F' THEN done END AS merged_at_dt,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN done END AS done_at_dt, CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'P' THEN 'CLOSED' ELSE 'OPEN' END AS state,
         first_review_dt, additions, deletions, review_count
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey),
prs AS (
  SELECT *, (epoch_us(done_at_dt) - epoch_us(created_at_dt)) / 3.6e9 AS pr_cycle_hours, (epoch_us(first_review_dt) - epoch_us(created_at_dt)) / 3.6e9 AS review_latency_hours,
         (epoch_us(done_at_dt) - epoch_us(first_review_dt)) / 3.6e9 AS review_duration_hours, coalesce(additions, 0) + coalesce(deletions, 0) AS pr_churn
  FROM raw_prs),
runs AS (
  SELECT 'repo' || (user_id % 3) AS repo_full, event_id AS run_id, event_type AS workflow_name, CASE WHEN event_id % 13 <> 0 THEN props END AS event,
         CAST(user_id AS VARCHAR) AS head_sha, ts AS run_started_dt,
         coalesce(CASE WHEN event_id % 17 <> 0 THEN value WHEN event_id % 2 = 0 THEN 400.0 END, 0) AS ci_duration_min,
         event_type = 'error' AS is_failure, regexp_matches(event_type, '(?i)(purchase|sign)') AS is_cd_workflow
  FROM events),
long_runs AS (
  SELECT o_orderpriority AS repo_full, o_orderkey AS run_id, o_orderdate AS run_started_dt, coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus = 'F' END, true) AS is_failure
  FROM orders),
releases AS (
  SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS repo_full, o_orderkey AS release_id, o_orderdate AS release_time_dt FROM orders WHERE o_orderstatus = 'P')
"""
