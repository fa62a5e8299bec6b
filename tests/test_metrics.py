from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import stats
from cadenza.plans import catalog, enrich, metrics
from cadenza.sources import files, schemas

FIXTURES = __file__.rsplit("/", 1)[0] + "/fixtures"


def golden(name):
    return pd.read_csv(f"{FIXTURES}/{name}.csv")


def weekly(spark, name, columns):
    known = golden(name)
    return spark.createDataFrame([(r.repo_full, datetime.fromisoformat(r.week[:10]), *(None if pd.isna(v) else v for v in r[columns])) for _, r in known.iterrows()], ["repo_full", "week", *columns])


def test_release_frequency_golden(spark):
    found = metrics.release_frequency(enrich.releases(files.read_csv(spark, f"{FIXTURES}/releases.csv", schemas.RELEASES)))
    known = golden("release_frequency_monthly")
    assert {(r.repo_full, r.month.date().isoformat(), r.release_frequency) for r in found.collect()} == {(r.repo_full, r.month[:10], r.release_frequency) for r in known.itertuples()}


def test_volatility_golden(spark):
    df = weekly(spark, "ci_failure_volatility_weekly", ["failure_rate"]).withColumnRenamed("failure_rate", "ci_failure_rate")
    found = {(r.repo_full, r.week.date().isoformat()): r.ci_failure_volatility_8w for r in metrics.weekly_volatility(df).collect()}
    for r in golden("ci_failure_volatility_weekly").itertuples():
        value = found[r.repo_full, r.week[:10]]
        assert (value is None) == pd.isna(r.failure_volatility_8w)
        assert value is None or value == pytest.approx(r.failure_volatility_8w, abs=1e-12)


def test_summary_tables_golden(spark):
    ci = weekly(spark, "ci_weekly", ["ci_duration_med_min", "ci_failure_rate"])
    flaky = weekly(spark, "ci_flakiness_retry_weekly", ["avg_runs_per_sha"])
    overhead = weekly(spark, "review_overhead_weekly", ["review_latency_med_h", "review_duration_med_h"])
    prs = spark.createDataFrame([(r, 1, 1.0, 2, 1) for r in ("docker/cli", "prometheus/prometheus")], "repo_full string, pr_number int, pr_cycle_hours double, additions long, deletions long")
    a = {r.repo_full: r for r in metrics.repo_comparison(ci, overhead=overhead, prs=prs).collect()}
    # The committed comparison and debt tables.
    for repo, minutes, failed, runs, hours in (
        ("docker/cli", 1.9333333333333331, 0.1513081165138011, 6.8490640012403565, 2.895),
        ("prometheus/prometheus", 0.9458333333333333, 0.1603180879574711, 3.834382033892431, 19.693402777777777),
    ):
        assert (a[repo].median_ci_duration_min, a[repo].median_failure_rate) == pytest.approx((minutes, failed), abs=1e-12)
        assert a[repo].median_pr_cycle_h == 1.0  # the overhead table has no cycle column, so change requests give it
        b = {r.repo_full: r for r in metrics.debt_overview(prs, flaky, overhead).collect()}[repo]
        assert (b.ci_runs_per_sha, b.review_overhead_med_h, b.pr_churn_med) == pytest.approx((runs, hours, 3.0), abs=1e-12)
        assert b.debt_ratio_med is None


def test_sources_of_the_tables_are_checked(spark):
    ci = spark.createDataFrame([("r", 1.0)], "repo_full string, other double")
    with pytest.raises(ValueError):
        metrics.repo_comparison(ci)
    with pytest.raises(FileNotFoundError):
        metrics.repo_comparison(spark.createDataFrame([("r", 1.0, 0.5)], "repo_full string, ci_duration_med double, failure_rate double"))
    with pytest.raises(ValueError):
        metrics.review_latency_smoothed(ci)


RUN = "repo_full string, run_id bigint, workflow_name string, event string, head_sha string, run_started_at string, updated_at string, conclusion string"


def test_runs_with_nulls(spark):
    t = "2024-01-{:02d}T00:00:00Z".format
    rows = [
        ("r", 1, "CD", "push", "s1", t(2), "2024-01-02T00:30:00Z", "failure"), ("r", 2, "CD", "push", "s1", t(2), None, None), ("r", 3, "CD", None, "s1", t(2), t(3), "success"),
        (None, 4, "CD", "push", "s2", t(2), t(3), "failure"), ("r", 5, "abcd", "push", None, t(8), "2024-01-08T00:10:00Z", "cancelled"), ("r", 6, "x", "push", "s3", None, None, "failure"),
    ]
    runs = enrich.runs(spark.createDataFrame(rows, RUN))
    ci = {r.week.day: r for r in metrics.ci_weekly(runs).collect()}
    assert (ci[1].ci_runs, ci[1].ci_failure_rate, ci[1].ci_duration_med_min) == (2, 0.5, 735.0)
    capped = {r.week.day: r for r in metrics.ci_capped_weekly(runs).collect()}
    assert {d: (r.n, r.ci_duration_med) for d, r in capped.items()} == {2: (2, 20.0)}  # the 8th is a Monday, the last day of its Tuesday week
    retry = metrics.true_retry_weekly(runs).collect()
    assert [(r.n_keys, r.share_with_retry, r.avg_runs_per_key) for r in retry] == [(1, 1.0, 2.0)]
    sha = metrics.sha_retry_weekly(runs).collect()
    assert [(r.n_sha, r.avg_runs_per_sha) for r in sha] == [(1, 3.0)]
    volatility = {r.week.day: r for r in metrics.failure_volatility(runs).collect()}
    assert (volatility[1].n, round(volatility[1].failure_rate, 6), volatility[1].failure_volatility_8w) == (3, 0.333333, None)
    assert {r.week.day: r.cd_runs for r in metrics.cd_weekly(runs).collect()} == {1: 3, 8: 1}
    assert [r.cd_runs for r in metrics.cd_success_iso_weekly(runs).collect()] == [3]
    with pytest.raises(ValueError):
        enrich.runs(spark.createDataFrame(rows, RUN).drop("workflow_name"))


def test_smoothing_drops_nulls_first(spark):
    weeks = [datetime(2024, 1, 1 + 7 * i) for i in range(4)]
    df = spark.createDataFrame([("r", w, v) for w, v in zip(weeks, [1.0, None, 3.0, 9.0], strict=True)], "repo_full string, week timestamp_ntz, review_latency_med_h double")
    assert [(r.week.day, r.review_latency_smooth) for r in metrics.review_latency_smoothed(df).orderBy("week").collect()] == [(1, None), (15, 2.0), (22, 3.0)]


def test_time_to_release_ties_and_missing(spark):
    prs = spark.createDataFrame([("r", 1, "MERGED", datetime(2024, 1, 5)), ("r", 2, "MERGED", datetime(2024, 3, 1)), ("q", 3, "MERGED", datetime(2024, 1, 1)), ("r", 4, "CLOSED", None)], "repo_full string, pr_number int, state string, merged_at_dt timestamp_ntz")
    releases = spark.createDataFrame([("r", datetime(2024, 1, 5)), ("r", datetime(2024, 2, 1))], "repo_full string, release_time_dt timestamp_ntz")
    assert [(r.pr_number, r.time_to_release_days) for r in metrics.time_to_release(prs, releases).collect()] == [(1, 0.0)]


def test_collect_writes_all_tables(spark, tmp_path):
    for name, schema in (("prs", schemas.PRS), ("workflow_runs", schemas.RUNS)):
        files.write_csv(spark.createDataFrame([], schema), str(tmp_path / f"raw/{name}.csv"), single=True)
    releases = files.read_csv(spark, f"{FIXTURES}/releases.csv", schemas.RELEASES)
    files.write_csv(releases, str(tmp_path / "raw/releases.csv"), single=True)
    names = catalog.collect(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert len(names) == 26 and {"repo_comparison", "debt_overview", "review_latency_box", "merge_frequency_smoothed"} <= {*names}
    read = lambda f: spark.read.option("header", True).csv(str(tmp_path / f"out/release_frequency_monthly/{f}"))
    found = read("all.csv")
    assert found.count() == 25 and found.columns == ["repo_full", "month", "release_frequency"]
    one = found.first()
    own = read(one.repo_full.replace("/", "__") + ".csv")
    assert own.count() == found.where(found.repo_full == one.repo_full).count() > 0
    plan = stats.describe(catalog.stored(spark, str(tmp_path / "out/entities"))["workflow_runs"], "ci_duration_min")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.count("FileScan parquet") == 1


def test_a_refresh_replaces_its_weeks_only(spark, tmp_path):
    import os
    import shutil

    run = lambda repo, i, day, ok=True: (repo, i, "ci", "push", "s", f"2024-01-{day:02d}T00:00:00Z", f"2024-01-{day:02d}T00:10:00Z", "success" if ok else "failure")
    raw = lambda rows: {"workflow_runs": spark.createDataFrame(rows, RUN)}
    first = [run("a/x", 1, 2), run("a/x", 2, 9), run("b/y", 3, 9)]
    again = [run("a/x", 2, 9, False), run("a/x", 4, 10), run("a/x", 5, 16)]
    parts = lambda out: {os.path.relpath(os.path.join(d, f), out): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(out) for f in fs if f.startswith("part")}
    out = str(tmp_path / "out")
    catalog.store(raw(first), out)
    before = parts(out)
    catalog.store(raw(again), out)
    after = parts(out)
    kept = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/part")[0] for f in kept} == {"workflow_runs/slug=a__x/week=2024-01-01", "workflow_runs/slug=b__y/week=2024-01-08"}
    catalog.store(raw([first[0], first[2], *again]), str(tmp_path / "full"))
    rows = lambda path: sorted(map(str, metrics.ci_weekly(catalog.stored(spark, path)["workflow_runs"]).collect()))
    assert rows(out) == rows(str(tmp_path / "full")) and len(rows(out)) == 4
    shutil.rmtree(out)
    assert catalog.stored(spark, out)["prs"].collect() == []


def test_from_connector_nodes_to_metrics(spark, tmp_path):
    """Nodes of two repositories, with a run that two windows returned, end as metrics of both."""
    json = __import__("json").dumps
    pr = lambda n, day: json({"number": n, "createdAt": f"2024-01-{day:02d}T00:00:00Z", "mergedAt": f"2024-01-{day + 1:02d}T00:00:00Z", "state": "MERGED", "additions": 3})
    run = lambda i: json({"id": i, "name": "ci", "event": "push", "conclusion": "success", "created_at": "2024-01-03T00:00:00Z", "run_started_at": "2024-01-03T00:00:00Z", "updated_at": "2024-01-03T00:05:00Z", "head_sha": "s"})
    frame = lambda rows: spark.createDataFrame(rows, "owner string, repo string, node string")
    prs = frame([("a", "x", pr(1, 2)), ("a", "x", pr(2, 3)), ("b", "y", pr(1, 4)), ("b", "y", json({"number": 9, "createdAt": "2020-01-01T00:00:00Z"}))])
    runs = frame([("a", "x", run(1)), ("a", "x", run(1)), ("a", "x", run(2))])
    releases = frame([("a", "x", json({"id": 5, "published_at": "2024-01-09T00:00:00Z", "created_at": "2024-01-08T00:00:00Z"}))])
    names = catalog.collect_nodes(prs, runs, releases, str(tmp_path / "out"), since="2023-01-01T00:00:00Z")
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / name / "all.csv"))
    assert {(r.repo_full, r.merge_frequency) for r in read("merge_frequency_weekly").collect()} == {("a/x", 2), ("b/y", 1)}
    assert {(r.repo_full, r.ci_runs) for r in read("ci_weekly").collect()} == {("a/x", 2)}
    assert {r.repo_full for r in read("time_to_release_monthly").collect()} == {"a/x"} and "repo_comparison" in names


def test_percentiles_by_counted_ranks(spark):
    import random

    import numpy as np

    rng = random.Random(4)
    rows = [(k, v) for k, n in (("a", 1), ("b", 2), ("c", 997), (None, 50)) for v in (rng.choice([rng.gauss(0, 1e4), float(rng.randint(-3, 3)), rng.random() * 1e-3]) for _ in range(n))]
    df = spark.createDataFrame([*rows, ("a", None), ("d", None)], "k string, v double")
    fractions = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    found = {r.k: r.p for r in stats.percentiles(df, df.v, fractions, ["k"]).collect()}
    assert {*found} == {"a", "b", "c", None}
    for k, p in found.items():
        assert p == pytest.approx(np.quantile([v for key, v in rows if key == k], fractions), rel=1e-12, abs=1e-12)
    assert stats.percentiles(df, df.v, [0.5]).first().p == pytest.approx([np.median([v for _, v in rows])])
    assert {r.k: r.m for r in stats.medians(df, "v", "m", "k").collect()}["d"] is None
    assert stats.percentiles(df.limit(0), df.v, [0.5], ["k"]).collect() == []


def test_percentiles_of_odd_values(spark):
    """NaN is missing; infinities, both zeros, subnormal and huge numbers keep their order."""
    import itertools
    import math

    import numpy as np

    odd = [math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1e300, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 2.0, math.nextafter(2.0, 0), 1e-5, 1023.9999999999999, 1024.0]
    rows = [("a", v) for v in odd] + [("n", math.nan), ("n", None), ("b", 1.0), ("b", math.nan), ("b", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r.k: r.p for r in stats.percentiles(df, df.v, [i / 16 for i in range(17)], ["k"]).collect()}
    assert {*found} == {"a", "b"}
    assert found["a"] == sorted(v for v in odd if not math.isnan(v)) and (found["b"][0], found["b"][8], found["b"][16]) == (1.0, 2.0, 3.0)
    places = [r.p for r in spark.createDataFrame([(v,) for v in sorted(v for v in odd if not math.isnan(v))], "v double").select(stats._place(F.col("v")).alias("p")).collect()]
    assert places == sorted(places)
    rng = np.random.default_rng(2)
    values = np.sort(np.concatenate([rng.normal(size=300), 2.0 ** rng.integers(-1000, 1000, 300), np.nextafter(2.0 ** rng.integers(-1000, 1000, 300), 0)]))
    places = [r.p for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(stats._place(F.col("v")).alias("p")).collect()]
    assert all(a <= b for a, b in itertools.pairwise(places))
    box = {r.repo_full: r for r in stats.box(df.withColumnRenamed("k", "repo_full"), "v").collect()}
    assert {*box} == {"a", "b"} and (box["b"].n, box["b"].n_outliers, box["b"].med) == (2, 0, 2.0)


def test_values_of_a_narrow_band_are_dealt_finely(spark):
    """A million distinct values within a thousandth of each other: no fine slot holds more than some of them."""
    df = spark.range(1_000_000).select((1000 + F.col("id") / 1e6).alias("v"))
    fullest = df.groupBy(F.shiftright(stats._place(F.col("v")), stats.SLOT_BITS[-1]).alias("slot")).count().agg(F.max("count")).first()[0]
    assert fullest < 10_000
    assert stats.percentiles(df, F.col("v"), [0.5, 0.999]).first().p == pytest.approx([1000.4999995, 1000.998999001], abs=1e-9)


def test_several_measures_at_once(spark):
    rows = [("a", 1, 1.0, None), ("a", 1, 3.0, 7.0), ("a", 2, None, None), ("b", 1, 2.0, float("nan"))]
    df = spark.createDataFrame(rows, "k string, w int, x double, y double")
    found = sorted(map(tuple, stats.grouped_medians(df, {"x_med": "x", "y_med": "y"}, ["k", "w"]).collect()))
    assert found == [("a", 1, 2.0, 7.0), ("b", 1, 2.0, None)]
