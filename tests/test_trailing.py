"""Streams of trailing windows against the batch metrics, over several runs of one query, with rows that come late."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadenza.plans import metrics
from cadenza.streaming import trailing

START = datetime(2024, 1, 1)
SCHEMA = "repo_full string, run_id long, pr_number long, state string, run_started_dt timestamp_ntz, merged_at_dt timestamp_ntz, created_at_dt timestamp_ntz, is_failure boolean, pr_cycle_hours double"


def made(hours, keys=("a", "b", None), shift=0):
    for i, h in enumerate(hours):
        at = START + timedelta(hours=h)
        key = keys[(i + shift) % len(keys)]
        failed = None if i % 11 == 3 else (i * 7 + h) % 5 < 2
        yield (key, i, None if i % 13 == 5 else i, "MERGED" if i % 3 else "OPEN", at, at, at, failed, None if i % 4 == 1 else float((i * 37) % 50))


BATCHES = [
    list(made(range(0, 1500, 13))),
    list(made([1490, 1400, 1460, 1380], shift=1)) + list(made(range(1500, 2600, 17))),  # late by less than a week
    list(made(range(3500, 4000, 19))),  # with weeks missing in between
    [("a", 9999, 9999, "MERGED", *[START + timedelta(days=900)] * 3, False, 1.0)],  # closes all weeks before
]

METRICS = {
    "failure_volatility": (trailing.failure_volatility, metrics.failure_volatility),
    "merge_smoothed": (trailing.merge_smoothed, metrics.merge_smoothed),
    "cycle": (trailing.cycle_weekly, metrics.cycle_weekly),
}


def by_week(df):
    columns = [c for c in df.columns if c not in ("repo_full", "week")]
    return {(r.repo_full, r.week): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(METRICS))
def test_stream_equals_batch(spark, tmp_path, name):
    streamed, batch = METRICS[name]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    counts = []
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        trailing.drained(streamed(spark.readStream.schema(SCHEMA).parquet(source)), str(tmp_path / "check"), out)
        counts.append(spark.read.parquet(out).count())
    assert 0 < counts[0] < counts[1] < counts[3]
    expected = by_week(batch(spark.createDataFrame([r for rows in BATCHES for r in rows], SCHEMA)).where(F.col("week") < START + timedelta(days=800)))
    found = by_week(spark.read.parquet(out))
    assert found.keys() == expected.keys() and counts[3] == len(found)
    for at, values in expected.items():
        assert found[at] == pytest.approx(values), at


def test_rows_after_their_week_has_closed_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (list(made(range(0, 3000, 13))), list(made([5, 6, 7, 8])), [("a", 1, 1, "MERGED", *[START + timedelta(days=300)] * 3, True, 1.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        trailing.drained(trailing.failure_volatility(spark.readStream.schema(SCHEMA).parquet(source)), str(tmp_path / "check"), out)
    expected = by_week(metrics.failure_volatility(spark.createDataFrame(list(made(range(0, 3000, 13))), SCHEMA)))
    found = by_week(spark.read.parquet(out))
    assert found.keys() == expected.keys() and all(found[at] == pytest.approx(v) for at, v in expected.items())


def test_an_empty_stream_and_the_store_s_setting(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(trailing._STORE, None)
    trailing.drained(trailing.merge_smoothed(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), str(tmp_path / "check"), str(tmp_path / "out"))
    assert spark.conf.get(trailing._STORE, None) == before
