from datetime import datetime, timedelta

from cadenza.plans import metrics
from cadenza.streaming import weekly

START = datetime(2024, 1, 1)


def drained(spark, stream, name):
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"r{i % 2}", i, "MERGED" if i % 3 else "OPEN", START + timedelta(hours=17 * i), i % 5 == 0, True) for i in range(60)] + [(None, 99, "MERGED", START, True, True)]
    df = spark.createDataFrame(rows, "repo_full string, pr_number long, state string, merged_at_dt timestamp_ntz, is_failure boolean, is_cd_workflow boolean")
    df = df.withColumns({"run_id": df.pr_number, "run_started_dt": df.merged_at_dt, "ci_duration_min": df.pr_number.cast("double")})
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for bucket in ("monday", "tuesday"):
        got = {tuple(r) for r in drained(spark, weekly.merge_frequency(stream, bucket), f"merges_{bucket}").collect()}
        assert got == {tuple(r) for r in metrics.merge_frequency(df, bucket).collect()}
    rates = {tuple(r) for r in drained(spark, weekly.failure_rate(stream), "rates").collect()}
    assert rates == {(r.repo_full, r.week, r.failure_rate, r.n) for r in metrics.failure_volatility(df).collect()}
    delivered = {(r.repo_full, r.week, r.cd_runs, r.cd_failure_rate) for r in drained(spark, weekly.delivery_runs(stream), "delivered").collect()}
    assert delivered == {(r.repo_full, r.week, r.cd_runs, r.cd_failure_rate) for r in metrics.cd_weekly(df).collect()}
