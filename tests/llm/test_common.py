import pytest
from pyspark.sql import functions as F

from cadenza.llm import common


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_sifting_is_exact_however_full_the_map(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "MAP_BITS", bits)
    rows = spark.createDataFrame([(i % 500 if i else None, i, "x") for i in range(1000)], "id long, n long, map_hit string").drop("map_hit")
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)], "gone long")
    left = common.sifted(rows, "id", gone, lambda some: some.join(gone, F.col("id") == F.col("gone"), "left_anti"))
    assert sorted(r.n for r in left.collect()) == [i for i in range(1000) if not i or (i % 500) % 3]
    near = {r.id for r in common.maybe_wanted(rows, "id", gone).collect()}
    assert near >= set(range(0, 500, 3)) - {0} | {0}
    assert common.maybe_wanted(rows, "id", gone.limit(0)).collect() == []


def test_staged_tables_keep_types_and_follow_the_setting(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1}, None)], "a int, b array<int>, c map<string,int>, d timestamp_ntz")
    again = common.staged(df)
    assert again.schema == df.schema and again.collect() == df.collect()
    assert common.staged(df.limit(0)).collect() == []


def test_discarded_tables_are_gone(spark):
    df = common.staged(spark.range(3))
    common.discard(df)
    assert not __import__("os").path.exists(df._staged_path)


def test_word_counts(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n\x0b\x0c\r",), ("a b c  d",), ("\x1ca",)], "t string")
    assert [r.n for r in df.select(common.word_count(F.col("t")).alias("n")).collect()] == [0, 0, 0, 3, 1]
