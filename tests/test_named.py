import os
import pickle
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.plans import figures
from cadenza.sources import files, named

ROWS = [("a/b", 1, None, 'x"y\n'), ("c", 2, "", None), ("a/b", 3, "q", "é, ü"), (None, 4, "lost", "")]
SCHEMA = "repo string, n long, e string, t string"


def test_one_file_for_each_repository(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = str(tmp_path / "out")
    named.write_named(df, out, F.col("repo"), order=("n",))
    named.write_single(df, out, "all", order=("n",))
    assert sorted(os.listdir(out)) == [".csv", "a__b.csv", "all.csv", "c.csv"]
    read = lambda f: sorted(map(tuple, files.read_csv(spark, f"{out}/{f}", df.schema).collect()), key=lambda r: r[1])
    empty = lambda rows: [tuple(v or None for v in r) for r in rows]  # noqa: E731  Spark reads an empty text as null
    assert read("a__b.csv") == [ROWS[0], ROWS[2]] and read("c.csv") == empty([ROWS[1]]) and read("all.csv") == empty(ROWS)
    assert open(f"{out}/c.csv").read().splitlines()[1] == '"c","2","",'
    # Again with other rows: files of the same name are replaced, others stay.
    named.write_named(spark.createDataFrame([("c", 9, "new", None)], SCHEMA), out, F.col("repo"))
    assert read("c.csv") == [("c", 9, "new", None)] and read("a__b.csv") == [ROWS[0], ROWS[2]]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS * 3, SCHEMA)
    bad = df.withColumn("e", F.when(F.col("repo") == "c", F.raise_error(F.lit("broken"))).otherwise(F.col("e")))
    named.write_named(df.where("n = 1"), out, F.col("repo"))
    before = open(f"{out}/a__b.csv").read()
    with pytest.raises(Exception, match="broken"):
        named.write_named(bad, out, F.col("repo"))
    assert os.listdir(out) == ["a__b.csv"] and open(f"{out}/a__b.csv").read() == before


def test_upstream_work_keeps_its_tasks(spark):
    """What makes the rows is not squeezed into the tasks that write them."""
    summed = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    dealt = summed.withColumn(named.NAME, F.lit("all.csv")).repartition(named.NAME)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.index("Exchange") < plan.index("HashAggregate")


def test_empty_table_and_nested_columns(spark, tmp_path):
    out = str(tmp_path / "out")
    named.write_named(spark.createDataFrame([], SCHEMA), out, F.col("repo"))
    assert not os.path.exists(out) or os.listdir(out) == []
    named.write_named(spark.createDataFrame([("r", [1, 2])], "repo string, ns array<bigint>"), out, F.col("repo"))
    assert open(f"{out}/r.csv").read() == '"repo","ns"\n"r","[1,2]"\n'


def test_charts_hold_their_values(spark, tmp_path):
    rows = [("a/b <1>", "2024-01-01", 1.0, None), ("a/b <1>", "2024-01-08", 3.0, 2.0), ("c", "2024-01-01", None, None), (None, "2024-01-01", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "repo_full string, week string, x double, y double").withColumn("week", F.col("week").cast("timestamp_ntz"))
    charts = figures.line_charts(df, "week", ["x", "y"], "T")
    figures.write_charts(charts, str(tmp_path / "svg"))
    assert sorted(os.listdir(tmp_path / "svg")) == ["a__b <1>.svg", "c.svg"]
    import xml.dom.minidom

    found = {n: xml.dom.minidom.parse(str(tmp_path / "svg" / n)) for n in os.listdir(tmp_path / "svg")}
    dots = [(c.getAttribute("data-measure"), c.getAttribute("data-value"), c.getAttribute("cx"), c.getAttribute("cy")) for c in found["a__b <1>.svg"].getElementsByTagName("circle")]
    assert dots == [("x", "1.0", "48.0", "264.0"), ("x", "3.0", "912.0", "48.0"), ("y", "2.0", "912.0", "156.0")]
    assert found["c.svg"].getElementsByTagName("circle") == [] and "a/b <1>" in found["a__b <1>.svg"].getElementsByTagName("title")[0].firstChild.data


def test_tasks_tell_the_driver_folders_not_files(tmp_path, monkeypatch):
    """What a task sends is as small for many files; another attempt's folder is left out."""
    writer = named._Writer({"path": str(tmp_path / "out"), "kind": "text"}, T.StructType().add("body", "string").add(named.NAME, "string"))
    messages = []
    for attempt, names in ((7, ["a.txt", "left.txt"]), (8, [f"{i:04d}.txt" for i in range(500)]), (9, [])):
        monkeypatch.setattr(named.TaskContext, "get", lambda a=attempt: SimpleNamespace(partitionId=lambda: 3, attemptNumber=lambda: 0, taskAttemptId=lambda: a))
        messages.append(writer.write(iter([pa.RecordBatch.from_pylist([{"body": n, named.NAME: n} for n in names])] if names else [])))
    assert max(len(pickle.dumps(m)) for m in messages) < 1000
    writer.commit([*messages[1:], None])
    assert {f: open(tmp_path / "out" / f).read() for f in os.listdir(tmp_path / "out")} == {n: n for n in (f"{i:04d}.txt" for i in range(500))}
