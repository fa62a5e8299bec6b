import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from cadenza.sources import api, files, landed, schemas

FIXTURES = __file__.rsplit("/", 1)[0] + "/fixtures"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\"b,\nc", [1, 2], 5, None), ("x", None, None, True)], "tag_name string, pr_numbers array<bigint>, release_id bigint, draft boolean")
    files.write_csv(df, str(tmp_path / "out"), single=True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out"), df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_csv_that_is_empty_or_lacks_columns(spark):
    assert files.read_csv(spark, f"{FIXTURES}/empty.csv", schemas.RELEASES).collect() == []
    found = files.read_csv(spark, f"{FIXTURES}/releases.csv", schemas.PRS)
    assert found.count() == 76 and found.where("pr_number IS NOT NULL").isEmpty()


def test_first_available(spark):
    read = lambda p: files.read_csv(spark, p, schemas.RELEASES)
    found = files.first_available(spark, [(f"{FIXTURES}/none.csv", read), (f"{FIXTURES}/releases.csv", read)])
    assert found.count() == 76
    with pytest.raises(FileNotFoundError):
        files.first_available(spark, [(f"{FIXTURES}/none.csv", read)])


def test_combined(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([("y", True)], "s string, flag boolean")
    assert sorted(map(tuple, files.combined([a, b]).collect()), key=str) == [(1, "x", None), (None, "y", True)]
    with pytest.raises(ValueError):
        files.combined([])


def node(n, created, reviews=None):
    return {"number": n, "createdAt": created, "state": "OPEN", "author": None, "commits": {"totalCount": 2}, "mergeCommit": None, "reviews": {"nodes": reviews} if reviews is not None else None}


def parsed(spark, nodes, schema):
    return spark.createDataFrame([(json.dumps(n),) for n in nodes], "node string").select(F.from_json("node", schema).alias("n")).select("n.*")


def test_nested_change_requests(spark):
    reviews = [{"createdAt": "2024-01-03T00:00:00Z"}, {"createdAt": None}, {"createdAt": ""}, {"createdAt": "2024-01-02T00:00:00Z"}]
    nodes = [node(1, "2024-01-01T00:00:00Z", reviews), node(2, "2024-02-01T00:00:00Z", []), node(3, "2023-01-01T00:00:00Z"), node(4, "2024-03-01T00:00:00Z")]
    got = {r.pr_number: r for r in landed.prs(parsed(spark, nodes, schemas.PR_NODE), "o", "r", "2024-01-01T00:00:00Z").collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].first_review_at, got[1].review_count, got[1].commit_count, got[1].author) == ("2024-01-02T00:00:00Z", 4, 2, None)
    assert (got[2].first_review_at, got[2].review_count, got[4].review_count) == (None, 0, 0)


def test_nested_runs(spark):
    base = {"created_at": "2024-01-01T00:00:00Z", "name": "ci"}
    nodes = [base | {"id": 1, "pull_requests": [{"number": 5}, {"number": None}, {"number": 0}]}, base | {"id": 2}, base | {"id": 2}]
    rows = parsed(spark, nodes, schemas.RUN_NODE)
    got = sorted((r.run_id, r.pr_numbers) for r in landed.runs(rows, "o", "r").collect())
    assert got == [(1, [5]), (2, [])]
    assert landed.runs(rows, "o", "r", dedupe=False).count() == 3


FAKE = '''
import json, re

def fetch(url, body, token):
    if body:
        cursor = body["variables"]["cursor"]
        name = body["variables"]["name"]
        if name == "broken":
            return {"errors": ["no"]}
        at = int(cursor or 0)
        nodes = [{"number": i, "createdAt": f"2024-01-{30 - i:02d}T00:00:00Z"} for i in range(at, at + 10)]
        return {"data": {"repository": {"pullRequests": {"pageInfo": {"hasNextPage": True, "endCursor": str(at + 10)}, "nodes": nodes}}}}
    if "/releases" in url:
        return [{"id": i, "published_at": f"2024-01-{30 - i:02d}"} for i in range(20)]
    m = re.search(r"page=(\\d+)(?:&created=(.*)\\.\\.(.*))?$", url)
    page = int(m[1])
    if m[2]:
        return {"workflow_runs": [{"id": page * 1000 + i, "created_at": m[2]} for i in range(100 if page == 1 else 3)]}
    return {"workflow_runs": [{"id": page * 1000 + i, "created_at": f"2024-01-{20 - page:02d}"} for i in range(4)]}
'''


@pytest.fixture
def fake(monkeypatch):
    module = types.ModuleType("fake_transport")
    exec(FAKE, module.__dict__)
    monkeypatch.setitem(sys.modules, "fake_transport", module)


def nodes_of(source, **options):
    reader = source({"transport": "fake_transport:fetch", "base": "http://x"} | options).reader(None)
    return [json.loads(n) for p in reader.partitions() for _, _, n in reader.read(p)], len(reader.partitions())


def test_connectors(fake):
    found, parts = nodes_of(api.PrSource, repos="o/a,o/b", since="2024-01-15")
    assert (len(found), parts) == (32, 2)  # the first older one ends each scan
    found, parts = nodes_of(api.RunSource, repos="o/a", since="2024-01-01", until="2024-01-30")
    assert (len(found), parts) == (3 * 103, 3)
    assert len(nodes_of(api.PagedRunSource, repos="o/a", since="2024-01-17")[0]) == 12
    assert len(nodes_of(api.ReleaseSource, repos="o/a", since="2024-01-25")[0]) == 6
    with pytest.raises(RuntimeError):
        nodes_of(api.PrSource, repos="o/broken", since="2024-01-15")


def test_retries():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return {}

    assert api.retried(flaky, sleep=slept.append) == {} and slept == [2, 4]
    with pytest.raises(TimeoutError):
        api.retried(lambda: (_ for _ in ()).throw(TimeoutError), attempts=2, sleep=slept.append)
    with pytest.raises(ValueError):
        api.retried(lambda: (_ for _ in ()).throw(ValueError), sleep=slept.append)


COUNTING = '''
import json, os

def fetch(url, body, token):
    with open(token, "a") as log:
        log.write(url + "\\n")
    if "/releases" in url:
        return [{"id": d, "published_at": f"2024-01-{d:02d}T10:00:00Z"} for d in range(28, 0, -1)] if "page=1" in url else []
    a, b = url.rsplit("created=", 1)[1].split("..")
    return {"workflow_runs": [{"id": int(d), "created_at": f"2024-01-{d:02d}T00:00:00Z"} for d in range(1, 29) if a <= f"2024-01-{d:02d}" <= b]}

def measured(repo, day, options):
    return None if day < "2024-02" else ("c-" + repo, {"code_smells": day[5:7], "complexity": "7"})
'''


@pytest.fixture
def counting(spark, tmp_path):
    """A module that executors' Python workers can import too."""
    (tmp_path / "counting_transport.py").write_text(COUNTING)
    spark.sparkContext.addPyFile(str(tmp_path / "counting_transport.py"))
    log = tmp_path / "requests.log"
    log.touch()
    return log


@pytest.mark.parametrize(("source", "path"), [(api.RunSource, "actions/runs"), (api.ReleaseSource, "releases")])
def test_streams_fetch_new_windows_only(spark, tmp_path, counting, source, path):
    spark.dataSource.register(source)

    def rerun(until):
        before = len(counting.read_text().splitlines())
        stream = spark.readStream.format(source.name()).options(transport="counting_transport:fetch", base="http://x", token=str(counting), repos="o/a,o/b", since="2024-01-01", until=until, window_days=7).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return [line for line in counting.read_text().splitlines()[before:] if path in line]

    found = lambda: sorted((r.repo, json.loads(r.node)["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(rerun("2024-01-15")) == 4  # two windows of two repositories
    assert found() == sorted((r, d) for r in "ab" for d in range(1, 15))
    assert rerun("2024-01-15") == []  # nothing new, nothing asked
    assert len(rerun("2024-01-25")) == 2  # one more whole window
    assert found() == sorted((r, d) for r in "ab" for d in range(1, 22))


def test_snapshots_by_repository_and_date(spark, counting):
    from cadenza.sources import snapshots

    spark.dataSource.register(snapshots.SnapshotSource)
    options = {"repos": "o/a, o/b", "start": "2024-01-15", "end": "2024-04-01", "frequency": "monthly"}
    df = spark.read.format("snapshots").options(runner="counting_transport:measured", **options).load()
    assert sorted((r.repo_full, r.snapshot_date, r.commit, r.code_smells, r.complexity, r.sqale_index) for r in df.collect()) == [
        (r, f"2024-{m}-01", f"c-{r}", m, "7", None) for r in ("o/a", "o/b") for m in ("02", "03")
    ]
    assert df.rdd.getNumPartitions() == 6
    assert spark.read.format("snapshots").options(**options).load().collect() == []  # neither a runner nor a server
    with pytest.raises(ValueError):
        snapshots.dates("2024-01-01", "2024-02-01", "weekly")


def test_the_default_runner_checks_out_by_date(tmp_path, monkeypatch):
    from cadenza.sources import snapshots

    commands = []

    def run(*command, cwd=None):
        commands.append(command)
        return "abc" if command[1] == "rev-list" else ""

    monkeypatch.setattr(snapshots, "run", run)
    monkeypatch.setattr(api, "http", lambda url, body, token: {"component": {"measures": [{"metric": "complexity", "value": "3"}, {"metric": "code_smells"}]}})
    assert snapshots.scan("o/a", "2024-02-01", {"server": "http://s"}) == ("abc", {"complexity": "3"})
    assert [c[:2] for c in commands[:3]] == [("git", "clone"), ("git", "rev-list"), ("git", "checkout")] and "--before=2024-02-01 23:59:59" in commands[1]
    monkeypatch.setattr(snapshots, "run", lambda *c, cwd=None: "")
    assert snapshots.scan("o/a", "2000-01-01", {"server": "http://s"}) is None
    with pytest.raises(RuntimeError):
        snapshots.__dict__["subprocess"] and __import__("importlib").reload(snapshots).run("git", "no-such-command")


def test_replays_refuse_what_was_not_recorded(spark, tmp_path):
    from cadenza.sources import replay

    replay.record(spark.createDataFrame([("/repos/o/a/releases?per_page=100&page=1", "[1]")], "request string, body string"), str(tmp_path / "p"))
    assert replay.fetch(f"{tmp_path}/p/repos/o/a/releases?per_page=100&page=1", None, "") == [1]
    with pytest.raises(FileNotFoundError):
        replay.fetch(f"{tmp_path}/p/repos/o/a/releases?per_page=100&page=2", None, "")
