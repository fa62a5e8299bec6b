"""The registered queries and their oracles, over the stand-in entities. Doubles are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import exprs
from cadenza.operators import calendar, stats
from cadenza.operators.asof import last_before, next_after
from cadenza.plans import connected, enrich, figures, metrics, standins
from cadenza.sources import files, landed, named, schemas
from cadenza.sources.shared import new_path
from cadenza.streaming import trailing

DIGITS = 6
QUERIES: dict = {}
ORACLES: dict = {}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def _add(name: str, query, sql: str) -> None:
    """Registers `query` and `sql`, which may use the stand-in tables."""
    QUERIES[name] = lambda spark, sf_dir: _rounded(query(spark, sf_dir))
    ORACLES[name] = f"WITH {standins.SQL}{sql}"


def _of(metric, *entities):
    """A query of a metric over stand-in entities."""
    return lambda spark, sf_dir: metric(*(e(spark, sf_dir) for e in entities))


MON, TUE = "date_trunc('week', {0})::TIMESTAMP", "(date_trunc('week', {0} - INTERVAL 1 DAY) + INTERVAL 1 DAY)::TIMESTAMP"
CREATED, MERGED, STARTED = (MON.format(c) for c in ("created_at_dt", "merged_at_dt", "run_started_dt"))
CREATED_TUE, MERGED_TUE, STARTED_TUE = (TUE.format(c) for c in ("created_at_dt", "merged_at_dt", "run_started_dt"))

_OVERHEAD = f""",
overhead AS (
  SELECT repo_full, {CREATED} AS wk, median(pr_cycle_hours) AS pr_cycle_med_h, median(review_latency_hours) AS review_latency_med_h,
         median(review_duration_hours) AS review_duration_med_h, median(review_count) AS review_count_med, median(pr_churn) AS pr_churn_med,
         count(*) FILTER (state = 'MERGED') AS merged_prs, count(pr_number) AS prs_total
  FROM prs WHERE created_at_dt IS NOT NULL AND repo_full IS NOT NULL GROUP BY ALL)"""
_CI = f""",
ci AS (
  SELECT repo_full, {STARTED} AS wk, median(ci_duration_min) AS ci_duration_med_min, avg(is_failure::INT) AS ci_failure_rate, count(run_id) AS ci_runs
  FROM runs WHERE run_started_dt IS NOT NULL AND ci_duration_min IS NOT NULL GROUP BY ALL)"""
_KEYS = f""",
keyed AS (
  SELECT repo_full, {STARTED_TUE} AS wk, count(*) AS r FROM runs WHERE event IS NOT NULL GROUP BY repo_full, wk, head_sha, workflow_name, event),
retries AS (
  SELECT repo_full, wk, avg((r > 1)::INT) AS share_with_retry, avg(r) AS avg_runs_per_key, quantile_cont(r, 0.95) AS p95_runs_per_key, count(r) AS n_keys FROM keyed GROUP BY ALL),
shas AS (
  SELECT repo_full, {STARTED_TUE} AS wk, count(*) AS r FROM runs GROUP BY repo_full, wk, head_sha),
sha_retries AS (
  SELECT repo_full, wk, avg((r > 1)::INT) AS share_shas_with_retry, avg(r) AS avg_runs_per_sha, quantile_cont(r, 0.95) AS p95_runs_per_sha, count(r) AS n_sha FROM shas GROUP BY ALL)"""


def _trailing(aggregate: str, value: str, rows: int = 4, least: int = 2) -> str:
    over = f"OVER (PARTITION BY repo_full ORDER BY wk ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count({value}) {over} >= {least} THEN {aggregate}({value}) {over} END, {DIGITS})"


def _box(table: str, value: str, where: str = "true") -> str:
    return f""",
vals AS (SELECT repo_full, CAST({value} AS DOUBLE) AS v FROM {table} WHERE {where} AND {value} IS NOT NULL AND repo_full IS NOT NULL),
cuts AS (SELECT repo_full, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM vals GROUP BY repo_full),
marked AS (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM vals JOIN cuts USING (repo_full))
SELECT repo_full, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(min(v) FILTER (inside), 6) AS whisker_low,
       round(max(v) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers, count(*) AS n
FROM marked GROUP BY repo_full, q1, med, q3"""


S = standins

_add("merge_frequency_weekly", _of(metrics.merge_frequency, S.prs), f"""
SELECT repo_full, {MERGED} AS week, count(pr_number) AS merge_frequency FROM prs WHERE state = 'MERGED' AND merged_at_dt IS NOT NULL GROUP BY ALL""")

_add("review_overhead_weekly", _of(metrics.review_overhead, S.prs), _OVERHEAD + """
SELECT repo_full, wk AS week, round(pr_cycle_med_h, 6) AS pr_cycle_med_h, round(review_latency_med_h, 6) AS review_latency_med_h,
       round(review_duration_med_h, 6) AS review_duration_med_h, round(review_count_med, 6) AS review_count_med, round(pr_churn_med, 6) AS pr_churn_med, merged_prs, prs_total
FROM overhead""")

_add("review_overhead_short_weekly", _of(metrics.review_overhead_short, S.prs), _OVERHEAD + """
SELECT repo_full, wk AS week, round(review_count_med, 6) AS review_count_med, round(review_latency_med_h, 6) AS review_latency_med_h,
       round(review_duration_med_h, 6) AS review_duration_med_h, prs_total FROM overhead""")

_add("ci_weekly", _of(metrics.ci_weekly, S.runs), _CI + """
SELECT repo_full, wk AS week, round(ci_duration_med_min, 6) AS ci_duration_med_min, round(ci_failure_rate, 6) AS ci_failure_rate, ci_runs FROM ci""")

_add("ci_capped_weekly", _of(metrics.ci_capped_weekly, S.runs), f"""
SELECT repo_full, {STARTED_TUE} AS week, round(median(ci_duration_min), 6) AS ci_duration_med, round(avg(is_failure::INT), 6) AS failure_rate, count(*) AS n
FROM runs WHERE ci_duration_min BETWEEN 0 AND 360 GROUP BY ALL""")

_add("ci_capped_p99_weekly", _of(metrics.ci_capped_p99, S.runs), f"""
SELECT repo_full, {STARTED_TUE} AS week, round(median(ci_duration_min), 6) AS ci_duration_med, round(avg(is_failure::INT), 6) AS failure_rate, count(*) AS n
FROM runs WHERE ci_duration_min BETWEEN 0 AND (SELECT quantile_cont(ci_duration_min, 0.99) FROM runs) GROUP BY ALL""")

_add("ci_flakiness_weekly", _of(metrics.runs_per_sha_weekly, S.runs), f""",
per AS (SELECT repo_full, {STARTED} AS wk, count(*) AS r FROM runs GROUP BY repo_full, wk, head_sha)
SELECT repo_full, wk AS week, round(avg(r), 6) AS avg_runs_per_sha, round(quantile_cont(r, 0.95), 6) AS p95_runs_per_sha FROM per GROUP BY ALL""")

_add("ci_true_retry_weekly", _of(metrics.true_retry_weekly, S.runs), _KEYS + """
SELECT repo_full, wk AS week, round(share_with_retry, 6) AS share_with_retry, round(avg_runs_per_key, 6) AS avg_runs_per_key,
       round(p95_runs_per_key, 6) AS p95_runs_per_key, n_keys FROM retries""")

_add("ci_sha_retry_weekly", _of(metrics.sha_retry_weekly, S.runs), _KEYS + """
SELECT repo_full, wk AS week, round(share_shas_with_retry, 6) AS share_shas_with_retry, round(avg_runs_per_sha, 6) AS avg_runs_per_sha,
       round(p95_runs_per_sha, 6) AS p95_runs_per_sha, n_sha FROM sha_retries""")

_add("ci_failure_volatility", _of(metrics.failure_volatility, S.long_runs), f""",
rates AS (SELECT repo_full, {STARTED} AS wk, avg(is_failure::INT) AS failure_rate, count(run_id) AS n FROM long_runs GROUP BY ALL)
SELECT repo_full, wk AS week, round(failure_rate, 6) AS failure_rate, n, {_trailing("stddev_samp", "failure_rate", 8, 4)} AS failure_volatility_8w FROM rates""")

_add("ci_weekly_volatility", _of(lambda r: metrics.weekly_volatility(metrics.ci_weekly(r)), S.runs), _CI + f"""
SELECT repo_full, wk AS week, round(ci_failure_rate, 6) AS ci_failure_rate, {_trailing("stddev_samp", "ci_failure_rate", 8, 4)} AS ci_failure_volatility_8w FROM ci""")

_add("release_frequency_monthly", _of(metrics.release_frequency, S.releases), """
SELECT repo_full, date_trunc('month', release_time_dt)::TIMESTAMP AS month, count(release_id) AS release_frequency FROM releases WHERE repo_full IS NOT NULL GROUP BY ALL""")

_CD = """round(avg(is_failure::INT), 6) AS cd_failure_rate, round(1 - avg(is_failure::INT), 6) AS cd_success_rate, round(median(ci_duration_min), 6) AS cd_duration_med_min"""
_add("cd_workflow_weekly", _of(metrics.cd_weekly, S.runs), f"""
SELECT repo_full, {STARTED} AS week, count(run_id) AS cd_runs, {_CD} FROM runs WHERE is_cd_workflow GROUP BY ALL""")


def _cd_iso(spark, sf_dir):
    found = metrics.cd_success_iso_weekly(standins.runs(spark, sf_dir), r"(?i)(\bpurchase\b|\bsign\b)")
    return found.withColumn("week", F.concat(F.date_format("week", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))


_add("cd_success_iso_weekly", _cd_iso, rf"""
SELECT repo_full, strftime(date_trunc('week', run_started_dt), '%Y-%m-%d %H:%M:%S+00:00') AS week, count(*) AS cd_runs, {_CD}
FROM runs WHERE regexp_matches(workflow_name, '(?i)(\bpurchase\b|\bsign\b)') GROUP BY ALL""")

_TTR = """,
ttr AS (
  SELECT p.repo_full, p.pr_number, p.merged_at_dt, r.release_time_dt AS release_time, (epoch_us(r.release_time_dt) - epoch_us(p.merged_at_dt)) / 8.64e10 AS d
  FROM (SELECT * FROM prs WHERE state = 'MERGED') p ASOF JOIN (SELECT DISTINCT repo_full, release_time_dt FROM releases WHERE repo_full IS NOT NULL) r
    ON p.repo_full = r.repo_full AND r.release_time_dt >= p.merged_at_dt)"""
_add("time_to_release_monthly", _of(metrics.time_to_release_monthly, S.prs, S.releases), _TTR + """
SELECT repo_full, date_trunc('month', merged_at_dt)::TIMESTAMP AS month, round(median(d), 6) AS time_to_release_med_days, count(d) AS n FROM ttr GROUP BY ALL""")

_add("time_to_release_series", lambda s, d: metrics.time_to_release_series(QUERIES["time_to_release_monthly"](s, d)), _TTR + """
SELECT repo_full, date_trunc('month', merged_at_dt)::TIMESTAMP AS month, round(median(d), 6) AS time_to_release_med_days, count(d) AS n FROM ttr GROUP BY ALL ORDER BY month, repo_full""")

_add("time_to_release_level", lambda s, d: metrics.time_to_release(S.prs(s, d), S.releases(s, d)).select("repo_full", "pr_number", "merged_at_dt", "release_time", "time_to_release_days"), _TTR + """
SELECT repo_full, pr_number, merged_at_dt, release_time, round(d, 6) AS time_to_release_days FROM ttr""")


def _events_asof(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return next_after(clicks, events.where("event_type = 'error'").select("user_id", "ts"), "user_id", "ts", "ts", "next_error")


_add("asof_next_event", _events_asof, """,
e AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error')
SELECT c.event_id, c.user_id, c.ts, e.ts AS next_error FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF JOIN e ON c.user_id = e.user_id AND e.ts >= c.ts""")

_add("churn_item_level", _of(metrics.churn_by_pr, S.prs), """
SELECT repo_full, pr_number, additions, deletions, pr_churn FROM prs""")

_add("review_duration_item_level", _of(metrics.review_duration_by_pr, S.prs), """
SELECT repo_full, pr_number, created_at_dt, first_review_dt, done_at_dt, round(review_duration_hours, 6) AS review_duration_hours FROM prs""")

_add("cycle_smoothed", _of(metrics.cycle_weekly, S.prs), f""",
w AS (SELECT repo_full, {CREATED_TUE} AS wk, median(pr_cycle_hours) AS h FROM prs WHERE pr_cycle_hours IS NOT NULL GROUP BY ALL)
SELECT repo_full, wk AS week, round(h, 6) AS pr_cycle_hours, {_trailing("median", "h")} AS pr_cycle_smooth FROM w""")

_add("merge_smoothed", _of(metrics.merge_smoothed, S.prs), f""",
w AS (SELECT repo_full, {MERGED_TUE} AS wk, count(pr_number) AS m FROM prs WHERE state = 'MERGED' AND merged_at_dt IS NOT NULL GROUP BY ALL)
SELECT repo_full, wk AS week, m AS merge_count, {_trailing("avg", "m")} AS merge_smooth FROM w""")

_add("flakiness_smoothed", _of(lambda r: metrics.flakiness_smoothed(metrics.true_retry_weekly(r)), S.runs), _KEYS + f"""
SELECT repo_full, wk AS week, round(share_with_retry, 6) AS share_with_retry, n_keys, {_trailing("avg", "share_with_retry")} AS share_smooth
FROM (SELECT * FROM retries WHERE n_keys >= 20)""")

for _name, _metric, _column, _smooth in (
    ("review_duration_smoothed", metrics.review_duration_smoothed, "review_duration_med_h", "review_duration_smooth"),
    ("review_latency_smoothed", metrics.review_latency_smoothed, "review_latency_med_h", "review_latency_smooth"),
):
    _add(_name, _of(lambda p, m=_metric: m(metrics.review_overhead(p)), S.prs), _OVERHEAD + f"""
SELECT repo_full, wk AS week, round({_column}, 6) AS {_column}, {_trailing("median", _column)} AS {_smooth} FROM (SELECT * FROM overhead WHERE {_column} IS NOT NULL)""")

_add("latency_box", _of(metrics.latency_box, S.prs), _box("prs", "review_latency_hours"))
_add("churn_outliers", _of(metrics.churn_outliers, S.prs), _box("prs", "pr_churn", "pr_churn > 0").split("SELECT repo_full, round(q1")[0] + """
SELECT repo_full, v, count(*) AS n FROM marked WHERE NOT inside GROUP BY ALL""")
_add("churn_box", _of(metrics.churn_box, S.prs), _box("prs", "pr_churn", "pr_churn > 0"))

_add("retry_describe", _of(metrics.retry_describe, S.runs), _KEYS + """
SELECT repo_full, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, CAST(min(r) AS DOUBLE) AS least, round(quantile_cont(r, 0.5), 6) AS p50,
       round(quantile_cont(r, 0.9), 6) AS p90, round(quantile_cont(r, 0.95), 6) AS p95, round(quantile_cont(r, 0.99), 6) AS p99, CAST(max(r) AS DOUBLE) AS most
FROM keyed GROUP BY repo_full""")

_add("run_time_range", _of(lambda r: stats.time_range(r, "run_started_dt"), S.runs), """
SELECT repo_full, min(run_started_dt) AS first_time, max(run_started_dt) AS last_time, round((epoch_us(max(run_started_dt)) - epoch_us(min(run_started_dt))) / 8.64e10, 6) AS range_days,
       count(*) AS n FROM runs GROUP BY repo_full""")

_add("entities", _of(stats.entities, S.runs), "SELECT DISTINCT repo_full FROM runs ORDER BY repo_full")

_add("table_repo_comparison", lambda s, d: metrics.repo_comparison(_orders_ci(s, d), cycle_weekly=metrics.cycle_weekly(S.prs(s, d))), f""",
oci AS (SELECT o_orderpriority AS repo_full, date_trunc('week', o_orderdate)::TIMESTAMP AS wk, median(o_totalprice) AS minutes, avg((o_orderstatus = 'F')::INT) AS failed FROM orders GROUP BY ALL),
cyc AS (SELECT repo_full, {CREATED_TUE} AS wk, median(pr_cycle_hours) AS h FROM prs WHERE pr_cycle_hours IS NOT NULL GROUP BY ALL)
SELECT a.repo_full, round(a.m, 6) AS median_ci_duration_min, round(a.f, 6) AS median_failure_rate, round(b.h, 6) AS median_pr_cycle_h
FROM (SELECT repo_full, median(minutes) AS m, median(failed) AS f FROM oci GROUP BY repo_full) a LEFT JOIN (SELECT repo_full, median(h) AS h FROM cyc GROUP BY repo_full) b USING (repo_full)""")


def _orders_ci(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = orders.select(
        F.col("o_orderpriority").alias("repo_full"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("run_started_dt"),
        F.col("o_totalprice").alias("ci_duration_min"), (F.col("o_orderstatus") == "F").alias("is_failure"),
    )
    return metrics.ci_weekly(runs)


def _debt(spark, sf_dir):
    prs = S.prs(spark, sf_dir)
    return metrics.debt_overview(prs, metrics.sha_retry_weekly(S.runs(spark, sf_dir)), metrics.review_overhead(prs), metrics.snapshots_tidy(S.snapshots(spark, sf_dir)))


_add("table_debt_overview", _debt, _OVERHEAD + _KEYS + """,
a AS (SELECT repo_full, median(pr_churn) AS pr_churn_med FROM prs GROUP BY repo_full),
b AS (SELECT repo_full, avg(avg_runs_per_sha) AS ci_runs_per_sha FROM sha_retries GROUP BY repo_full),
c AS (SELECT repo_full, median(review_latency_med_h) AS review_overhead_med_h FROM overhead GROUP BY repo_full),
d AS (SELECT c_mktsegment AS repo_full, median(CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END) AS debt_ratio_med FROM customer GROUP BY c_mktsegment)
SELECT repo_full, round(pr_churn_med, 6) AS pr_churn_med, round(ci_runs_per_sha, 6) AS ci_runs_per_sha, round(review_overhead_med_h, 6) AS review_overhead_med_h,
       round(debt_ratio_med, 6) AS debt_ratio_med
FROM a FULL JOIN b USING (repo_full) FULL JOIN c USING (repo_full) FULL JOIN d USING (repo_full)""")

_add("snapshots_tidy", lambda s, d: metrics.snapshots_tidy(S.snapshots(s, d)).withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd HH:mm:ss")), """
SELECT c_mktsegment AS repo_full, '2024-02-01 00:00:00' AS snapshot_date, round(CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END, 6) AS sqale_debt_ratio FROM customer""")

_add("snapshot_calendar", lambda s, d: calendar.snapshot_dates(s, "2024-01-15", "2026-01-01", "quarterly"), """
SELECT CAST(d AS TIMESTAMP) AS snapshot_date FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2025-12-31', INTERVAL 3 MONTH) t(d)""")

_add("capability_matrix", lambda s, d: metrics.capability_matrix(s), """
SELECT metric, capability, CAST(list_contains(found, capability) AS INT) AS mapped
FROM (VALUES ('PR Cycle Time', ['Fast Feedback']), ('Review Latency', ['Fast Feedback', 'Code Review']), ('Merge Frequency', ['Trunk-based Dev']),
             ('CI Duration', ['Continuous Integration']), ('CI Failure Rate', ['Continuous Integration', 'Automated Testing'])) m(metric, found),
     (VALUES ('Fast Feedback'), ('Code Review'), ('Trunk-based Dev'), ('Continuous Integration'), ('Automated Testing')) c(capability)""")

_add("capability_observability", lambda s, d: metrics.observability(s), """
SELECT * FROM (VALUES ('Continuous Integration', 5), ('Trunk-based Development', 4), ('Fast Feedback', 5), ('Automated Testing', 4), ('Observability', 2),
                      ('Lean Management', 1), ('Culture', 0)) t(capability, score)""")

_add("snapshot_calendar_monthly", lambda s, d: calendar.snapshot_dates(s, "2024-01-15", "2025-03-01", "monthly"), """
SELECT CAST(d AS TIMESTAMP) AS snapshot_date FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2025-02-28', INTERVAL 1 MONTH) t(d)""")

_add("first_entities", _of(lambda r: stats.entities(r, most=2), S.runs), "SELECT DISTINCT repo_full FROM runs ORDER BY repo_full LIMIT 2")

# Nodes as connectors return them, and what becomes of them.

_STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
_PR_ROWS = f""",
reviews AS (
  SELECT l_orderkey, count(*) AS n, min(CASE WHEN l_linenumber % 3 > 0 THEN {_STAMP.format("l_shipdate")} END) AS first_at FROM lineitem GROUP BY l_orderkey),
landed_prs AS (
  SELECT 'o' || (o_custkey % 2) AS owner, 'r/' || (o_custkey % 3) AS repo, owner || '/' || repo AS repo_full, o_orderkey AS pr_number, {_STAMP.format("o_orderdate")} AS created_at,
    CASE WHEN o_orderkey % 5 > 0 THEN 'u' || o_custkey END AS author, r.first_at AS first_review_at, coalesce(r.n, 0) AS review_count, o_orderkey % 7 AS commit_count
  FROM orders LEFT JOIN reviews r ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01')"""

_add("landed_prs", lambda s, d: _landed(s, d)["prs"].select("repo_full", "pr_number", "created_at", "author", "first_review_at", "review_count", "commit_count"), _PR_ROWS + """
SELECT repo_full, pr_number, created_at, author, first_review_at, review_count, commit_count FROM landed_prs""")

_add("landed_runs", lambda s, d: _landed(s, d)["workflow_runs"].select("repo_full", "run_id", "workflow_name", "created_at", F.array_join("pr_numbers", ",").alias("pr_numbers")), f"""
SELECT 'o0/r' || (user_id % 3) AS repo_full, event_id AS run_id, event_type AS workflow_name, {_STAMP.format("ts")} AS created_at,
  CASE WHEN event_id % 4 = 0 THEN '' WHEN user_id = 0 THEN CAST(event_id + 1 AS VARCHAR) ELSE user_id || ',' || (event_id + 1) END AS pr_numbers
FROM events""")

_add("landed_releases", lambda s, d: _landed(s, d)["releases"].select("repo_full", "release_id", "tag_name", "created_at", "published_at"), f"""
SELECT 'o0/r' || (o_custkey % 3) AS repo_full, o_orderkey AS release_id, o_orderpriority AS tag_name, {_STAMP.format("o_orderdate")} AS created_at,
  CASE WHEN o_orderkey % 4 > 0 THEN {_STAMP.format("o_orderdate")} END AS published_at
FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1995-01-01'""")

_add("landed_merge_frequency", lambda s, d: metrics.merge_frequency(enrich.prs(_landed(s, d)["prs"])), f""",
merged AS (SELECT 'o' || (o_custkey % 2) || '/r/' || (o_custkey % 3) AS repo_full, o_orderkey AS pr_number, date_trunc('second', o_orderdate) AS merged_at_dt
           FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01')
SELECT repo_full, {MERGED} AS week, count(pr_number) AS merge_frequency FROM merged GROUP BY ALL""")

_add("slugs", lambda s, d: _landed(s, d)["prs"].select(exprs.slug(F.col("owner"), F.col("repo")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n")), _PR_ROWS + """
SELECT replace(owner || '__' || repo, '/', '__') AS slug, count(*) AS n FROM landed_prs GROUP BY ALL""")

_add("combined_tables", lambda s, d: files.combined([S.runs(s, d).select("repo_full", F.col("run_id").cast("string")), S.releases(s, d).select("repo_full", F.col("release_id").cast("string"))]), """
SELECT repo_full, CAST(run_id AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS release_id FROM runs UNION ALL SELECT repo_full, NULL, CAST(release_id AS VARCHAR) FROM releases""")

_add("csv_round_trip", lambda s, d: _through_csv(s, d), """
SELECT n_nationkey, n_name, n_nationkey || ',' || n_regionkey AS numbers FROM nation""")


def _noted(spark, sf_dir):
    """Orders with a note of several lines, quotes and commas, written as CSV by the tasks that make them and read again by splits of the files."""
    lines = F.expr("repeat(concat('\"', o_orderpriority, '\", of:\n'), cast(o_orderkey % 7 as int))")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(lines, F.col("o_orderkey").cast("string")).alias("note"), "o_totalprice")
    path = new_path(spark, "csv-")
    files.write_csv(orders, path)
    found = files.read_csv(spark, path, orders.schema, split=True)
    return found.select("o_orderkey", F.md5(F.encode("note", "utf-8")).alias("note_md5"), F.length("note").cast("long").alias("note_chars"), "o_totalprice")


_add("csv_split_lines", _noted, """,
noted AS (SELECT *, repeat('"' || o_orderpriority || '", of:' || chr(10), CAST(o_orderkey % 7 AS BIGINT)) || o_orderkey AS note FROM orders)
SELECT o_orderkey, md5(note) AS note_md5, length(note) AS note_chars, round(o_totalprice, 6) AS o_totalprice FROM noted""")


def _landed(spark, sf_dir):
    """Raw entities by way of nodes in JSON; some runs come twice, as from two windows."""
    found = standins.nodes(spark, sf_dir)
    runs = found["workflow_runs"].unionByName(found["workflow_runs"].where("id % 10 = 0"))
    return {
        "prs": landed.prs(landed.parsed(found["prs"], schemas.PR_NODE), since="1995-01-01T00:00:00Z"),
        "workflow_runs": landed.runs(landed.parsed(runs, schemas.RUN_NODE)),
        "releases": landed.releases(landed.parsed(found["releases"], schemas.RELEASE_NODE), since="1995-01-01T00:00:00Z"),
    }


def _through_csv(spark, sf_dir):
    """Written to the shared folder as CSV, and read again as the first of two options that is there."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", F.array("n_nationkey", "n_regionkey").alias("numbers"))
    path = new_path(spark, "csv-")
    files.write_csv(nations, path)
    read = lambda p: files.read_csv(spark, p, nations.schema)
    found = files.first_available(spark, [(f"{path}-none", read), (path, read)])
    return found.select("n_nationkey", "n_name", F.array_join("numbers", ",").alias("numbers"))


def _through_named(spark, sf_dir):
    """Weekly runs as one file for each repository and one of all, read back by file."""
    weekly = metrics.failure_volatility(S.long_runs(spark, sf_dir))
    path = new_path(spark, "named-")
    named.write_named(weekly, path, F.col("repo_full"), order=("week",))
    named.write_single(weekly, path, "all", order=("repo_full", "week"))
    schema = T.StructType([f for f in weekly.schema if f.name != "failure_volatility_8w"])
    found = files.read_csv(spark, path, schema, with_file=True)
    name = F.regexp_extract("file", "([^/]*)[.]csv$", 1)
    return found.select(F.url_decode(name).alias("file"), "repo_full", "week", "failure_rate", "n")


def _drawn(spark, sf_dir):
    """Charts of the weekly failure rates, one SVG file for each repository, and the values read back from the files."""
    path = new_path(spark, "svg-")
    charts = figures.line_charts(metrics.failure_volatility(S.long_runs(spark, sf_dir)), "week", ["failure_rate", "failure_volatility_8w"], "CI failures", most=1.0)
    figures.write_charts(charts, path)
    read = spark.read.text(path, wholetext=True, pathGlobFilter="*.svg").select(F.regexp_extract("value", "<title>CI failures: ([^<]*)<", 1).alias("repo_full"), F.explode(figures.drawn_values(F.col("value"))).alias("d"))
    return read.select("repo_full", "d.measure", F.col("d.at").alias("week"), "d.value")


def _streamed(spark, sf_dir):
    """Runs as a stream that is stopped halfway and goes on from its checkpoint: the weeks that closed."""
    runs = S.long_runs(spark, sf_dir).select("repo_full", "run_id", "run_started_dt", "is_failure")
    bounds = runs.agg(F.min("run_started_dt").alias("a"), F.max("run_started_dt").alias("b")).first()
    source, out, checkpoint = (new_path(spark, f"stream-{name}-") for name in ("in", "out", "checkpoint"))
    middle = bounds.a + (bounds.b - bounds.a) / 2 if bounds.a else None
    later = F.col("run_started_dt") >= F.lit(middle).cast("timestamp_ntz")
    for part in (runs.where(~later), runs.where(later)):
        part.write.mode("append").parquet(source)
        trailing.drained(trailing.failure_volatility(spark.readStream.schema(runs.schema).parquet(source)), checkpoint, out)
    return spark.read.schema("repo_full string, week timestamp_ntz, failure_rate double, n bigint, failure_volatility_8w double").parquet(out)


_LONG = f""",
rates AS (SELECT repo_full, {STARTED} AS wk, avg(is_failure::INT) AS failure_rate, count(run_id) AS n FROM long_runs GROUP BY ALL)"""

_add("named_files", _through_named, _LONG + """
SELECT f AS file, repo_full, wk AS week, round(failure_rate, 6) AS failure_rate, n FROM rates, (VALUES (1), (2)) v(i), LATERAL (SELECT CASE WHEN i = 1 THEN repo_full ELSE 'all' END AS f)""")

_add("failure_charts", _drawn, _LONG + f""",
smooth AS (SELECT *, {_trailing("stddev_samp", "failure_rate", 8, 4)} AS failure_volatility_8w FROM rates)
SELECT repo_full, 'failure_rate' AS measure, wk AS week, round(failure_rate, 6) AS value FROM smooth
UNION ALL SELECT repo_full, 'failure_volatility_8w', wk, failure_volatility_8w FROM smooth WHERE failure_volatility_8w IS NOT NULL""")

_add("failure_volatility_stream", _streamed, _LONG + f""",
smooth AS (SELECT *, {_trailing("stddev_samp", "failure_rate", 8, 4)} AS failure_volatility_8w FROM rates)
SELECT repo_full, wk AS week, round(failure_rate, 6) AS failure_rate, n, failure_volatility_8w FROM smooth WHERE wk + INTERVAL 14 DAY <= (SELECT max(run_started_dt) FROM long_runs)""")

# The weekly medians by counted ranks.

_add("review_overhead_by_ranks", _of(lambda p: metrics.review_overhead(p, by_ranks=True), S.prs), ORACLES["review_overhead_weekly"].removeprefix(f"WITH {standins.SQL}"))
_add("ci_by_ranks", _of(lambda r: metrics.ci_weekly(r, by_ranks=True), S.runs), ORACLES["ci_weekly"].removeprefix(f"WITH {standins.SQL}"))
_add("cycle_by_ranks", _of(lambda p: metrics.cycle_weekly(p, by_ranks=True), S.prs), ORACLES["cycle_smoothed"].removeprefix(f"WITH {standins.SQL}"))
_add("time_to_release_by_ranks", lambda s, d: metrics.time_to_release_monthly(S.prs(s, d), S.releases(s, d), by_ranks=True), ORACLES["time_to_release_monthly"].removeprefix(f"WITH {standins.SQL}"))

# Connectors over recorded pages.

_add("connector_prs", lambda s, d: connected.parsed(connected.prs(s, d), "prs").select("repo_full", "pr_number", "created_at", "author", "first_review_at", "review_count", "commit_count"), _PR_ROWS + f"""
SELECT repo_full, pr_number, created_at, author, first_review_at, review_count, commit_count FROM landed_prs WHERE created_at >= '{connected.SINCE_PRS}'""")

_add("connector_pr_details", lambda s, d: connected.parsed(connected.prs(s, d), "details").withColumn("reviewers", F.array_join("reviewers", ",")), f"""
SELECT 'o' || (o_custkey % 2) || '/r/' || (o_custkey % 3) AS repo_full, o_orderkey AS pr_number, o_orderpriority AS title, 'main' AS base_ref, 'topic/' || o_orderkey AS head_ref,
       coalesce((SELECT string_agg(DISTINCT 's' || (l_suppkey % 5), ',' ORDER BY 's' || (l_suppkey % 5)) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS reviewers
FROM orders WHERE {_STAMP.format("o_orderdate")} >= '{connected.SINCE_PRS}'""")

_RUN_ROWS = f"SELECT 'o0/r' || (user_id % 3) AS repo_full, event_id AS run_id, event_type AS workflow_name, {_STAMP.format('ts')} AS created_at FROM events WHERE "
_RUN_COLUMNS = ("repo_full", "run_id", "workflow_name", "created_at")
_add("connector_runs_windowed", lambda s, d: connected.parsed(connected.windowed_runs(s, d), "runs").select(*_RUN_COLUMNS), f"""
{_RUN_ROWS} {_STAMP.format("ts")}[1:10] BETWEEN '{connected.SINCE_RUNS}' AND '{connected.UNTIL_RUNS}'""")

_add("connector_runs_paged", lambda s, d: connected.parsed(connected.paged_runs(s, d), "runs").select(*_RUN_COLUMNS), f"""
{_RUN_ROWS} {_STAMP.format("ts")} >= '{connected.SINCE_PAGED}'""")

_add("connector_releases", lambda s, d: connected.parsed(connected.releases(s, d), "releases").select("repo_full", "release_id", "tag_name", "created_at", "published_at"), f"""
SELECT 'o0/r' || (o_custkey % 3) AS repo_full, o_orderkey AS release_id, o_orderpriority AS tag_name, {_STAMP.format("o_orderdate")} AS created_at,
  CASE WHEN o_orderkey % 4 > 0 THEN {_STAMP.format("o_orderdate")} END AS published_at
FROM orders WHERE o_orderstatus = 'P' AND {_STAMP.format("o_orderdate")} >= '{connected.SINCE_RELEASES}'""")


def _calendar(months: int) -> str:
    return f""",
spans AS (SELECT o_orderpriority AS repo_full, date_trunc('month', min(o_orderdate))::TIMESTAMP AS a, date_trunc('day', max(o_orderdate))::TIMESTAMP AS b FROM orders GROUP BY ALL),
days AS (SELECT repo_full, unnest(generate_series(a, b, INTERVAL {months} MONTH)) AS snapshot_date FROM spans),
commits AS (SELECT o_orderpriority AS repo_full, o_orderdate AS at, min((CAST(o_orderkey AS VARCHAR), CAST(o_custkey % 1000 AS VARCHAR))) AS c FROM orders GROUP BY ALL)"""


_add("snapshot_dates_by_repo", lambda s, d: metrics.snapshot_calendar(connected.commits(s, d), "committed_at", "monthly"), _calendar(1) + """
SELECT repo_full, snapshot_date FROM days""")

_add("snapshot_commits", connected.snapshot_commits, _calendar(1) + """
SELECT d.repo_full, d.snapshot_date, c.c[1] AS "commit", c.c[2] AS smells FROM days d ASOF LEFT JOIN commits c ON d.repo_full = c.repo_full AND d.snapshot_date >= c.at""")

_add("connector_snapshots", lambda s, d: connected.measured_snapshots(s, d).select("repo_full", F.date_format("snapshot_date", "yyyy-MM-dd").alias("day"), "commit", "code_smells", "complexity"), _calendar(3) + """,
asked AS (SELECT s.repo_full, t.d AS snapshot_date FROM spans s, (SELECT unnest(generate_series(min(a), max(b), INTERVAL 3 MONTH)) AS d FROM spans) t)
SELECT d.repo_full, strftime(d.snapshot_date, '%Y-%m-%d') AS day, c.c[1] AS "commit", CAST(c.c[2] AS DOUBLE) AS code_smells, CAST(NULL AS DOUBLE) AS complexity
FROM asked d ASOF JOIN commits c ON d.repo_full = c.repo_full AND d.snapshot_date >= c.at""")

_add("last_event_before", lambda s, d: _events_before(s, d), """,
e AS (SELECT user_id, ts, min(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT c.event_id, c.user_id, c.ts, e.error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') c ASOF JOIN e ON c.user_id = e.user_id AND e.ts <= c.ts""")


def _events_before(spark, sf_dir):
    """The error that each purchase came after."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return last_before(bought, events.where("event_type = 'error'").select("event_id", "user_id", "ts"), "user_id", "ts", "ts", {"error_id": "event_id"})
