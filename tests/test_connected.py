import json

import pytest
from pyspark.sql import functions as F

from cadenza.plans import connected, registry
from cadenza.sources import replay


@pytest.fixture
def own_tasks(spark):
    """Small shuffles keep their tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def nodes(spark, *repos):
    """(name, rows, distinct times) of each repository."""
    rows = [("o", name, i, f"2024-01-{1 + i % times:02d}", json.dumps({"id": i})) for name, n, times in repos for i in range(n)]
    return spark.createDataFrame(rows, "owner string, repo string, id long, created string, node string")


def expected(found, rows):
    out = {}
    for name in {r.repo for r in found}:
        own = sorted((r for r in found if r.repo == name), key=lambda r: r.id)
        own.sort(key=lambda r: r.created, reverse=True)  # stable
        cut = [own[i : i + rows] for i in range(0, len(own), rows)]
        out |= {(name, i + 1): (",".join(r.node for r in c), i + 1 >= len(cut)) for i, c in enumerate([*cut, []])}
    return out


@pytest.mark.parametrize("repos", [[("a", 1, 1)], [("a", 10, 1), ("b", 11, 28)], [("a", 1003, 1), ("b", 9, 4), ("c", 20, 3)]])
def test_pages_by_definition(spark, own_tasks, repos):
    made = nodes(spark, *repos)
    pages = connected._pages(made, 10, ["owner", "repo"]).collect()
    got = {(p.repo, p.page): (p.nodes, p.last) for p in pages}
    assert got == expected(made.collect(), 10) and len(got) == len(pages)


def test_no_nodes_no_pages(spark):
    assert connected._pages(nodes(spark, ("a", 1, 1)).where("id < 0"), 10, ["owner", "repo"]).collect() == []


@pytest.mark.parametrize("times", [1, 28])
def test_a_repository_is_in_several_tasks(spark, own_tasks, times):
    """Its nodes are numbered, and its pages made, in more than one."""
    pages = connected._pages(nodes(spark, ("a", 2000, times)), 10, ["owner", "repo"])
    shares = [r.n for r in pages.groupBy(F.spark_partition_id()).agg(F.sum(F.size(F.split("nodes", "},"))).alias("n")).collect()]
    assert max(shares) < 1200
    windows = [line for line in pages._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert not any("row_number" in w for w in windows)


def test_prs_of_one_repository(spark, own_tasks, tmp_path, monkeypatch):
    """`connector_prs` returns all of them, and no task makes all their pages."""
    many = spark.range(2000)
    many.selectExpr("id AS o_orderkey", "6L AS o_custkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority", "timestamp_ntz'1998-06-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    many.selectExpr("id AS l_orderkey", "id AS l_suppkey", "1 AS l_linenumber", "timestamp_ntz'1998-06-02 00:00:00' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    many.selectExpr("id AS event_id", "id AS user_id", "'view' AS event_type", "timestamp_ntz'2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    made, record = [], replay.record
    monkeypatch.setattr(replay, "record", lambda pages, path: (made.append(pages), record(pages, path)))
    found = registry.QUERIES["connector_prs"](spark, str(tmp_path)).collect()
    assert sorted(r.pr_number for r in found) == list(range(2000)) and {(r.repo_full, r.review_count) for r in found} == {("o0/r/0", 1)}
    shares = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 41 and max(shares) < 25
