"""The connectors end to end over recorded pages: Spark makes the pages of a web interface from the test tables, the data sources fetch them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.asof import last_before
from cadenza.plans import metrics, standins
from cadenza.sources import api, landed, replay, schemas, snapshots
from cadenza.sources.shared import new_path, staged

SINCE_PRS, SINCE_RUNS, UNTIL_RUNS, SINCE_RELEASES = "1998-01-01", "2024-01-05", "2024-01-27", "1999-01-01"
SINCE_PAGED = "2024-01-20"


def _pages(nodes: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """(keys, page, nodes, last): newest first, `rows` to a page, and an empty page after the last.

    Rows are dealt into ranges of (keys, time, id), so no task holds a group's rows: a row's place is its place in the range, and what earlier
    ranges hold of its group comes from a count for each range and group.
    """
    order = [*keys, F.desc("created"), "id"]
    # The ranges are written once, as dealing anew might part them elsewhere; a row's number grows along them.
    dealt = staged(nodes.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, "node", F.monotonically_increasing_id().alias("at")))
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    counts = staged(dealt.groupBy(*keys, "range").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    pages_of = counts.groupBy(*keys).agg(F.ceil(F.sum("n") / rows).alias("most"))
    placed = dealt.join(F.broadcast(starts), [*keys, "range"]).withColumn("place", F.col("at") + F.col("shift"))
    pages = placed.groupBy(*keys, F.floor(F.col("place") / rows).alias("page")).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("found"))
    pages = pages.select(*keys, (F.col("page") + 1).alias("page"), F.array_join(F.transform("found", lambda x: x.node), ",").alias("nodes"))
    after = pages_of.select(*keys, (F.col("most") + 1).alias("page"), F.lit("").alias("nodes"))
    return pages.unionByName(after).join(F.broadcast(pages_of), keys).withColumn("last", F.col("page") >= F.col("most")).drop("most")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _repos(nodes: DataFrame) -> str:
    """The repositories' names, of which the stand-ins have a few."""
    return ",".join(sorted(f"{r.owner}/{r.repo}" for r in nodes.select("owner", "repo").distinct().collect()))


def _fetched(spark: SparkSession, source, pages: DataFrame, **options: str) -> DataFrame:
    """What `source` returns of recorded pages (request, body)."""
    base = new_path(spark, "pages-")
    replay.record(pages, base)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(transport="cadenza.sources.replay:fetch", base=base, **options).load()


def prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = standins.nodes(spark, sf_dir)["prs"]
    pages = _pages(nodes, api.QUERY_ROWS, ["owner", "repo"])
    o, r, n = F.col("owner"), F.col("repo"), F.col("page")
    info = _text('{"data":{"repository":{"pullRequests":{"pageInfo":{"hasNextPage":', F.when(F.col("last"), "false").otherwise("true"), ',"endCursor":"', n + 1, '"},"nodes":[', F.col("nodes"), "]}}}}")
    cursor = F.when(n > 1, n.cast("string")).otherwise("")
    return _fetched(spark, api.PrSource, pages.select(_text("/graphql/", o, "/", r, "/", cursor).alias("request"), info.alias("body")), repos=_repos(nodes), since=SINCE_PRS)


def _run_body() -> Column:
    return _text('{"workflow_runs":[', F.col("nodes"), "]}")


def windowed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = standins.nodes(spark, sf_dir)["workflow_runs"]
    windows = api._RunReader({"since": SINCE_RUNS, "until": UNTIL_RUNS, "repos": ""}).windows()
    day = F.substring("created", 1, 10)
    spans = F.filter(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows)), lambda w: day.between(w.a, w.b))
    dealt = nodes.select("*", F.explode(spans).alias("w")).select("*", "w.a", "w.b")
    pages = _pages(dealt, api.PAGE_ROWS, ["owner", "repo", "a", "b"])
    request = _text("/repos/", F.col("owner"), "/", F.col("repo"), f"/actions/runs?per_page={api.PAGE_ROWS}&page=", F.col("page"), "&created=", F.col("a"), "..", F.col("b"))
    return _fetched(spark, api.RunSource, pages.select(request.alias("request"), _run_body().alias("body")), repos=_repos(nodes), since=SINCE_RUNS, until=UNTIL_RUNS)


def paged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = standins.nodes(spark, sf_dir)["workflow_runs"]
    pages = _pages(nodes, api.PAGE_ROWS, ["owner", "repo"])
    request = _text("/repos/", F.col("owner"), "/", F.col("repo"), f"/actions/runs?per_page={api.PAGE_ROWS}&page=", F.col("page"))
    return _fetched(spark, api.PagedRunSource, pages.select(request.alias("request"), _run_body().alias("body")), repos=_repos(nodes), since=SINCE_PAGED, max_pages="1000000")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = standins.nodes(spark, sf_dir)["releases"]
    pages = _pages(nodes, api.PAGE_ROWS, ["owner", "repo"])
    request = _text("/repos/", F.col("owner"), "/", F.col("repo"), f"/releases?per_page={api.PAGE_ROWS}&page=", F.col("page"))
    body = _text("[", F.col("nodes"), "]")
    return _fetched(spark, api.ReleaseSource, pages.select(request.alias("request"), body.alias("body")), repos=_repos(nodes), since=SINCE_RELEASES, max_pages="1000000")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_full, committed_at, commit, smells): orders as commits."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("repo_full"), F.col("o_orderdate").alias("committed_at"), F.col("o_orderkey").cast("string").alias("commit"), (F.col("o_custkey") % 1000).cast("string").alias("smells")
    )


def snapshot_commits(spark: SparkSession, sf_dir: str, frequency: str = "monthly") -> DataFrame:
    """Each repository's calendar with its last commit at or before each date; dates before the first commit stay, without one."""
    made = commits(spark, sf_dir)
    days = metrics.snapshot_calendar(made, "committed_at", frequency)
    return last_before(days, made, "repo_full", "snapshot_date", "committed_at", {"commit": "commit", "smells": "smells"}, keep_all=True)


def measured_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyser's data source over what it would have measured at each date's commit."""
    made = commits(spark, sf_dir)
    first, last = made.agg(F.date_format(F.min("committed_at"), "yyyy-MM-dd"), F.date_format(F.date_add(F.max("committed_at").cast("date"), 1), "yyyy-MM-dd")).first()
    days = [F.lit(d) for d in snapshots.dates(first, last, "quarterly")]
    asked = made.select("repo_full").distinct().select("repo_full", F.explode(F.array(*days)).alias("day")).withColumn("snapshot_date", F.col("day").cast("timestamp_ntz"))
    found = last_before(asked, made, "repo_full", "snapshot_date", "committed_at", {"commit": "commit", "smells": "smells"}, keep_all=True)
    body = F.to_json(F.struct("commit", F.struct(F.col("smells").alias("code_smells")).alias("measures")))
    base = new_path(spark, "measures-")
    replay.record(found.select(_text("/measures/", F.col("repo_full"), "/", F.col("day")).alias("request"), body.alias("body")), base)
    repos = ",".join(sorted(r[0] for r in made.select("repo_full").distinct().collect()))  # the stand-ins have five
    spark.dataSource.register(snapshots.SnapshotSource)
    raw = spark.read.format("snapshots").options(repos=repos, start=first, end=last, frequency="quarterly", runner="cadenza.sources.snapshots:recorded", base=base).load()
    return metrics.snapshots_tidy(raw)


def parsed(nodes: DataFrame, kind: str) -> DataFrame:
    """Entities of what a connector returned."""
    schema = {"prs": schemas.PR_NODE, "details": schemas.PR_NODE, "runs": schemas.RUN_NODE, "releases": schemas.RELEASE_NODE}[kind]
    return {"prs": landed.prs, "details": landed.pr_details, "runs": landed.runs, "releases": landed.releases}[kind](landed.parsed(nodes, schema))
