from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cadenza.functions import exprs, time
from cadenza.operators import stats
from cadenza.operators.calendar import snapshot_dates
from cadenza.operators.columns import pick_column, require_columns, select_present
from cadenza.operators.rolling import rolling


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(expression).first()[0]


@pytest.mark.parametrize(
    ("day", "monday", "tuesday"),
    [("2024-11-18", "2024-11-18", "2024-11-12"), ("2024-11-19", "2024-11-18", "2024-11-19"), ("2024-11-24", "2024-11-18", "2024-11-19"), ("2024-11-25", "2024-11-25", "2024-11-19")],
)
def test_weeks(spark, day, monday, tuesday):
    t = F.lit(f"{day} 13:00:00").cast("timestamp_ntz")
    assert one(spark, time.week_monday(t)) == datetime.fromisoformat(monday)
    assert one(spark, time.week_tuesday(t)) == datetime.fromisoformat(tuesday)
    assert one(spark, time.month(t)) == datetime(2024, 11, 1)
    assert one(spark, F.date_format(time.week_utc(F.lit(f"{day} 13:00:00").cast("timestamp")), "yyyy-MM-dd HH")) == f"{monday} 00"


def test_bad_times_are_null_and_durations_keep_their_sign(spark):
    assert one(spark, time.parsed(F.lit("soon"))) is None
    assert one(spark, F.date_format(time.parsed(F.lit("2024-01-08T10:00:00Z")), "yyyy-MM-dd HH:mm")) == "2024-01-08 10:00"
    a, b = (F.lit(v).cast("timestamp_ntz") for v in ("2024-01-01 00:00:00", "2024-01-01 00:00:01.5"))
    assert one(spark, time.elapsed(a, b, "minutes")) == pytest.approx(0.025)
    assert one(spark, time.elapsed(b, a, "hours")) == pytest.approx(-1.5 / 3600)


def test_null_rules_of_flags(spark):
    null = F.lit(None).cast("string")
    assert one(spark, exprs.is_in(null, exprs.FAILED)) is False
    assert one(spark, exprs.is_in(F.lit("timed_out"), exprs.FAILED)) is True
    assert one(spark, exprs.equals(null, "MERGED")) is False
    assert one(spark, exprs.as_flag(null, True)) is True
    assert one(spark, exprs.as_flag(F.lit(False), True)) is False
    assert one(spark, exprs.churn(F.lit(None).cast("long"), F.lit(3))) == 3


def test_broad_and_bounded_delivery_names(spark):
    for name, broad, bounded in (("CD", True, True), ("abcde", True, False), ("My Release", True, True), ("tests", False, False), (None, False, False)):
        assert one(spark, exprs.matches(F.lit(name).cast("string"), exprs.DELIVERY_BROAD)) is broad
        assert one(spark, exprs.matches(F.lit(name).cast("string"), exprs.DELIVERY_BOUNDED)) is bounded


def test_slugs(spark):
    assert one(spark, exprs.slug(F.lit("a/b"), F.lit("c"))) == "a__b__c"


def test_rolling_counts_rows_and_non_null_values(spark):
    values = [1.0, None, 3.0, 5.0, 7.0, None]
    rows = [("r", datetime(2024, 1, 1 + 3 * i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "repo_full string, week timestamp_ntz, x double")
    got = df.select("week", *(rolling(F.col("x"), how, 3, 2).alias(how) for how in ("mean", "median", "std"))).orderBy("week").collect()
    assert [r["mean"] for r in got] == [None, None, 2.0, 4.0, 5.0, 6.0]
    assert [r["median"] for r in got] == [None, None, 2.0, 4.0, 5.0, 6.0]
    assert [r["std"] for r in got][2:] == pytest.approx([2**0.5, 2**0.5, 2.0, 2**0.5])


def test_box_and_describe(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", None), (None, 5.0)], "repo_full string, v double")
    row = stats.box(df, "v").collect()
    assert len(row) == 1
    assert (row[0].q1, row[0].med, row[0].q3, row[0].whisker_low, row[0].whisker_high, row[0].n_outliers, row[0].n) == (2, 3, 4, 1, 4, 1, 5)
    described = {r.repo_full: r for r in stats.describe(df, "v").collect()}
    assert described["a"].p50 == 3 and described["a"].n == 5 and described["b"].n == 0 and described["b"].std is None
    assert [r.repo_full for r in stats.entities(df, most=1).collect()] == ["a"]


def test_calendar_excludes_its_end(spark):
    days = lambda *a: [r[0].date().isoformat() for r in snapshot_dates(spark, *a).collect()]
    assert days("2024-01-15", "2024-04-01", "monthly") == ["2024-01-01", "2024-02-01", "2024-03-01"]
    assert days("2024-01-15", "2024-04-02", "quarterly") == ["2024-01-01", "2024-04-01"]
    assert days("2024-05-01", "2024-04-01", "monthly") == []
    with pytest.raises(ValueError):
        snapshot_dates(spark, "2024-01-01", "2024-02-01", "weekly")


def test_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert pick_column(df, ["x", "b", "a"]) == "b" and pick_column(df, ["x"]) is None
    assert select_present(df, ["b", "x"]).columns == ["b"]
    with pytest.raises(ValueError, match="x"):
        require_columns(df, ["a", "x"])
