"""Trailing windows over weekly series as streams.

Weeks are summed by the windowed aggregates of `weekly`, partly before the shuffle, so a busy repository is no hot key. In
append mode they give out each week once, when the watermark has passed its end, and weeks of a later micro-batch are later weeks. What
follows keeps the last rows of each series as state, which the length of the window bounds, and adds the trailing
aggregate of `operators.rolling` to each row. Results equal the batch metrics for all weeks that have closed; rows that
come late, but before their week closes, count.

The state needs Spark's RocksDB store: start the query inside `stored_in_rocksdb`.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.functions import exprs
from cadenza.streaming.weekly import weekly

AGGREGATES = {
    "mean": statistics.fmean,
    "std": lambda values: statistics.stdev(values) if len(values) > 1 else None,
    "median": statistics.median,
}

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def stored_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; others of the session are as before."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class _Trailing(StatefulProcessor):
    def __init__(self, value: str, name: str, how: str, rows: int, least: int, order: str):
        self.value, self.name, self.how, self.rows, self.least, self.order = value, name, how, rows, least, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", T.StructType([T.StructField("values", T.ArrayType(T.DoubleType()))]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tail = list(self.tail.get()[0]) if self.tail.exists() else []
        for row in sorted(rows, key=lambda r: r[self.order]):
            value = row[self.value]
            tail = [*tail, None if value is None else float(value)][-self.rows :]
            known = [v for v in tail if v is not None]
            yield Row(**row.asDict(), **{self.name: AGGREGATES[self.how](known) if len(known) >= self.least else None})
        self.tail.update((tail,))

    def close(self) -> None:
        pass


def rolled(series: DataFrame, value: str, name: str, how: str, rows: int = 4, least: int = 2, key: str = "repo_full", order: str = "week") -> DataFrame:
    """`series`, a stream of closed weeks, with `how` over each row and the rows - 1 before it; null with fewer than `least` non-null values."""
    schema = T.StructType([*series.schema, T.StructField(name, T.DoubleType())])
    return series.groupBy(key).transformWithState(_Trailing(value, name, how, rows, least, order), schema, "Append", "None")


def failure_volatility(runs: DataFrame, late: str = "7 days") -> DataFrame:
    """`metrics.failure_volatility` of a stream of runs."""
    failed = exprs.rate(exprs.as_flag(F.col("is_failure"), True)).alias("failure_rate")
    return rolled(weekly(runs, "run_started_dt", [failed, F.count("run_id").alias("n")], "monday", late), "failure_rate", "failure_volatility_8w", "std", 8, 4)


def merge_smoothed(prs: DataFrame, late: str = "7 days") -> DataFrame:
    """`metrics.merge_smoothed` of a stream of change requests."""
    merged = prs.where(exprs.equals(F.col("state"), "MERGED"))
    return rolled(weekly(merged, "merged_at_dt", [F.count("pr_number").alias("merge_count")], "tuesday", late), "merge_count", "merge_smooth", "mean")


def cycle_weekly(prs: DataFrame, late: str = "7 days") -> DataFrame:
    """`metrics.cycle_weekly` of a stream of change requests. Open weeks hold a map of their distinct values as state."""
    known = prs.dropna(subset=["pr_cycle_hours"])
    weeks = weekly(known, "created_at_dt", [F.median("pr_cycle_hours").alias("pr_cycle_hours")], "tuesday", late)
    return rolled(weeks.dropna(subset=["pr_cycle_hours"]), "pr_cycle_hours", "pr_cycle_smooth", "median")


def drained(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Runs an append stream over all that is there now, from `checkpoint` on, into Parquet at `out`."""
    with stored_in_rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
