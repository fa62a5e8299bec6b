import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.plans import registry
from cadenza.sources import files, records

TEXT = T.StructType([T.StructField("id", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    """Splits of 256 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def written(path, n, ends="\n", seed=1, longest=40):
    draw = random.Random(seed)
    pieces = ["x", "word", '"', '""', ",", "\n", "\n\n", '",', '\n"', "\r\n", "", " ", "é", '","', '"\n']
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=ends)
        out.writerow(["id", "a", "b"])
        for i in range(n):
            out.writerow([i, *("".join(draw.choices(pieces, k=draw.choice([0, 1, 5, longest]))) for _ in "ab")])


def python_rows(path):
    with open(path, newline="", encoding="utf-8") as f:
        found = list(csv.reader(f))
    return sorted((tuple(v or None for v in r) for r in found[1:]), key=repr)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("held", [records.HELD, 0])
def test_splits_equal_whole_files(spark, tmp_path, small_splits, monkeypatch, ends, held):
    monkeypatch.setattr(records.records, "__defaults__", (held,))
    for i in range(2):
        written(tmp_path / f"{i}.csv", 60, ends, seed=i)
    written(tmp_path / "long.csv", 3, ends, longest=3000)  # one record over many splits
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    found = files.read_csv(spark, str(tmp_path), TEXT, split=True)
    expected = sorted((r for f in tmp_path.glob("*.csv") for r in python_rows(f)), key=repr)
    assert rows(found) == expected


def test_equals_one_task(spark, tmp_path, small_splits):
    df = spark.range(50).select(F.col("id").cast("string").alias("id"), F.expr("repeat(concat('a\"', id, ',\n\n\"'), cast(id % 9 as int))").alias("a"), F.expr("if(id % 3 = 0, null, 'q')").alias("b"))
    files.write_csv(df, str(tmp_path / "out"), single=True)
    whole = files.read_csv(spark, str(tmp_path / "out"), TEXT, with_file=True)
    assert rows(files.read_csv(spark, str(tmp_path / "out"), TEXT, with_file=True, split=True)) == rows(whole)
    assert rows(whole.drop("file")) == rows(df.withColumn("a", F.nullif("a", F.lit(""))))  # the reader takes an empty text as null


@pytest.mark.parametrize("body", ["", "id,a,b\n", "id,a,b", '\n\nid,a,b\n\n1,x,y\n\n\n2,"p\n\nq",r', "id,a,b\n1,5\" disk,y\n2,x", 'id,a\n1,"",z\n2\n'])
def test_odd_files(spark, tmp_path, body):
    (tmp_path / "f.csv").write_text(body)
    read = lambda split: rows(files.read_csv(spark, str(tmp_path / "f.csv"), TEXT, split=split))
    assert read(True) == read(False)


def test_quote_that_never_closes(spark, tmp_path, small_splits):
    (tmp_path / "f.csv").write_text('id,a,b\n1,x,"open\n' + "more\n" * 200)
    (found,) = files.read_csv(spark, str(tmp_path / "f.csv"), TEXT, split=True).collect()
    assert found.id == "1" and found.b.count("more") == 200


@pytest.mark.parametrize("held", [records.HELD, 0])
def test_other_splits_fail_loudly(spark, tmp_path, small_splits, monkeypatch, held):
    written(tmp_path / "f.csv", 60)
    known = records._splits(records._lines(spark, str(tmp_path / "f.csv")))
    assert known.count() > 5
    monkeypatch.setattr(records, "_splits", lambda lines: known.where("start <> 512"))
    with pytest.raises(Exception, match="split at other places"):
        records.records(spark, str(tmp_path / "f.csv"), held).count()


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    (tmp_path / "f.csv").write_text('id,a,b\n1,x,"' + 'a ""line"", of it\n' * 100 + '"\n2,y,z\n')
    splits = records._splits(records._lines(spark, str(tmp_path / "f.csv"))).orderBy("start").collect()
    assert len(splits) > 5 and {s.origin for s in splits[1:]} == {0} and all(s.inside for s in splits[1:])
    found = {r.id: r for r in files.read_csv(spark, str(tmp_path / "f.csv"), TEXT, split=True).collect()}
    assert found["1"].b == 'a "line", of it\n' * 100 and found["2"].b == "z"


def test_states_by_hand():
    draw = np.random.default_rng(3)
    for _ in range(50):
        out, inn = draw.random(20) < 0.5, draw.random(20) < 0.5
        for inside in (False, True):
            state, expected = inside, []
            for o, i in zip(out, inn):
                state = bool(i if state else o)
                expected.append(state)
            assert records._after(out, inn, inside).tolist() == expected


def test_the_query_writes_in_the_tasks_of_its_input(spark, tmp_path, monkeypatch):
    """No task gets all rows to write; the files are longer than a split."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    written, write = [], files.write_csv
    monkeypatch.setattr(registry.files, "write_csv", lambda df, path, *a, **b: (write(df, path, *a, **b), written.append(path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        found = registry.QUERIES["csv_split_lines"](spark, str(tmp_path)).collect()
        parts = spark.read.text(written[0], wholetext=True).select(F.length("value")).collect()
        splits = records._splits(records._lines(spark, written[0])).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) >= 4 and max(n for n, in parts) < 0.5 * sum(n for n, in parts)
    assert len(splits) > len(parts) and any(s.inside for s in splits)
    note = F.expr("concat(repeat(concat('\"', o_orderpriority, '\", of:\n'), cast(o_orderkey % 7 as int)), o_orderkey)")
    assert sorted(map(tuple, found)) == sorted(map(tuple, orders.select("o_orderkey", F.md5(note), F.length(note).cast("long"), "o_totalprice").collect()))
