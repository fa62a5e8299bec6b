"""Connectors for paged web interfaces, as Spark data sources.

Each source splits its work into partitions that executors fetch apart: one for each repository, and
for runs one for each repository and window of days. What they fetch are nodes as JSON text; landed.py
turns parsed nodes into entities. How a page is fetched is a parameter ("transport", an importable
`module:function`), so nothing here needs a network to be tested.

    spark.dataSource.register(RunSource)
    spark.read.format("windowed_runs").options(repos="a/b,c/d", since="2024-01-01", until="2024-03-01", transport="pkg.mod:fetch").load()

As streams the same sources fetch what is new: an offset is the end of a window of days, so a query that starts again from its
checkpoint asks for later windows only. A window [a, b) gives each node once.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

WINDOW_DAYS, PAGE_ROWS, QUERY_ROWS, ATTEMPTS, TIMEOUT = 14, 100, 50, 5, 30

#: The fields of a change request that landed.PR_NODE holds.
PR_QUERY = """
query($owner: String!, $name: String!, $cursor: String, $rows: Int!) {
  repository(owner: $owner, name: $name) {
    pullRequests(first: $rows, after: $cursor, orderBy: {field: CREATED_AT, direction: DESC}) {
      pageInfo { hasNextPage endCursor }
      nodes {
        number title createdAt mergedAt closedAt state isDraft additions deletions changedFiles baseRefName headRefName
        commits { totalCount } author { login } mergeCommit { oid }
        reviews(first: 100) { nodes { createdAt state author { login } } }
      }
    }
  }
}
"""


def http(url: str, body: dict | None, token: str) -> dict | list:
    """One request with a JSON answer; the default transport."""
    headers = {"Accept": "application/json", "Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, headers)
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return json.load(answer)


def retried(call: Callable[[], dict | list], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> dict | list:
    """`call`, again after a wait that doubles up to 30 s when the connection fails; other errors are raised at once."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except urllib.error.HTTPError:
            raise
        except (TimeoutError, ConnectionError, urllib.error.URLError):
            if n == attempts:
                raise
            sleep(min(2**n, 30))
    raise AssertionError


class _Work(InputPartition):
    def __init__(self, owner: str, repo: str, since: str, until: str):
        self.owner, self.repo, self.since, self.until = owner, repo, since, until


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.base = self.options.get("base", "").rstrip("/")

    def fetch(self, url: str, body: dict | None = None) -> dict | list:
        module, _, name = self.options.get("transport", f"{__name__}:http").partition(":")
        call = getattr(importlib.import_module(module), name)
        answer = retried(lambda: call(url, body, self.options.get("token", "")))
        if isinstance(answer, dict) and answer.get("errors"):
            raise RuntimeError(f"the query failed: {answer['errors']}")
        return answer

    def windows(self) -> list[tuple[str, str]]:
        return [(self.options.get("since", ""), self.options.get("until", ""))]

    def repos(self) -> list[list[str]]:
        return [r.strip().split("/", 1) for r in self.options["repos"].split(",") if r.strip()]

    def partitions(self) -> list[_Work]:
        return [_Work(owner, repo, a, b) for owner, repo in self.repos() for a, b in self.windows()]

    def read(self, partition: _Work) -> Iterator[tuple]:
        for node in self.nodes(partition):
            yield partition.owner, partition.repo, json.dumps(node)


class _Stream(DataSourceStreamReader):
    """Whole windows of days from `since` on, up to `until` or today; those between two offsets are one batch."""

    def __init__(self, reader: _Reader):
        self.reader = reader
        self.step = timedelta(days=int(reader.options.get("window_days", WINDOW_DAYS)))

    def initialOffset(self) -> dict:
        return {"end": date.fromisoformat(self.reader.options["since"][:10]).isoformat()}

    def latestOffset(self) -> dict:
        first = date.fromisoformat(self.initialOffset()["end"])
        until = self.reader.options.get("until")
        last = date.fromisoformat(until[:10]) if until else date.today()
        return {"end": (first + max(0, (last - first) // self.step) * self.step).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[_Work]:
        at, last, found = date.fromisoformat(start["end"]), date.fromisoformat(end["end"]), []
        while at < last:
            found += [_Work(owner, repo, at.isoformat(), (at + self.step).isoformat()) for owner, repo in self.reader.repos()]
            at += self.step
        return found

    def read(self, partition: _Work) -> Iterator[tuple]:
        for node in self.reader.nodes(partition):
            if partition.since <= self.reader.created(node)[:10] < partition.until:
                yield partition.owner, partition.repo, json.dumps(node)


class _PrReader(_Reader):
    def created(self, node: dict) -> str:
        return node["createdAt"]

    def nodes(self, p: _Work) -> Iterator[dict]:
        """Newest first, up to the first that is older than `since`."""
        cursor = None
        while True:
            variables = {"owner": p.owner, "name": p.repo, "cursor": cursor, "rows": QUERY_ROWS}
            page = self.fetch(f"{self.base}/graphql", {"query": PR_QUERY, "variables": variables})["data"]["repository"]["pullRequests"]
            for node in page["nodes"]:
                if p.since and node["createdAt"] < p.since:
                    return
                yield node
            if not page["pageInfo"]["hasNextPage"]:
                return
            cursor = page["pageInfo"]["endCursor"]


class _RunReader(_Reader):
    def created(self, node: dict) -> str:
        return node["created_at"]

    def windows(self) -> list[tuple[str, str]]:
        start, end = date.fromisoformat(self.options["since"][:10]), date.fromisoformat(self.options["until"][:10])
        step = timedelta(days=int(self.options.get("window_days", WINDOW_DAYS)))
        found = []
        while start < end:
            found.append((start.isoformat(), min(start + step, end).isoformat()))
            start += step
        return found

    def nodes(self, p: _Work) -> Iterator[dict]:
        """Neighbouring windows share a day, so a run may come twice; landed.runs drops the second."""
        page = 1
        while True:
            found = self.fetch(f"{self.base}/repos/{p.owner}/{p.repo}/actions/runs?per_page={PAGE_ROWS}&page={page}&created={p.since}..{p.until}")["workflow_runs"]
            yield from found
            if len(found) < PAGE_ROWS:
                return
            page += 1


class _PagedRunReader(_Reader):
    def created(self, node: dict) -> str:
        return node["created_at"]

    def nodes(self, p: _Work) -> Iterator[dict]:
        """The older form: page by page until a page holds nothing recent, or `max_pages`."""
        for page in range(1, int(self.options.get("max_pages", 20)) + 1):
            found = self.fetch(f"{self.base}/repos/{p.owner}/{p.repo}/actions/runs?per_page={PAGE_ROWS}&page={page}")["workflow_runs"]
            recent = [r for r in found if r["created_at"] >= p.since]
            yield from recent
            if not recent:
                return
        raise RuntimeError(f"{p.owner}/{p.repo}: max_pages ended the scan before the runs did; raise it or narrow `since`")


class _ReleaseReader(_Reader):
    def created(self, node: dict) -> str:
        return node.get("published_at") or node.get("created_at") or ""

    def nodes(self, p: _Work) -> Iterator[dict]:
        """The first release that is too old ends the scan."""
        for page in range(1, int(self.options.get("max_pages", 20)) + 1):
            found = self.fetch(f"{self.base}/repos/{p.owner}/{p.repo}/releases?per_page={PAGE_ROWS}&page={page}")
            for node in found:
                if self.created(node) < p.since:
                    return
                yield node
            if len(found) < PAGE_ROWS:
                return
        raise RuntimeError(f"{p.owner}/{p.repo}: max_pages ended the scan before the releases did; raise it or narrow `since`")


class _Source(DataSource):
    reading: type[_Reader]

    def schema(self) -> str:
        return "owner string, repo string, node string"

    def reader(self, schema) -> DataSourceReader:
        return self.reading(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.reading(dict(self.options)))


class PrSource(_Source):
    reading = _PrReader

    @classmethod
    def name(cls) -> str:
        return "paged_prs"


class RunSource(_Source):
    reading = _RunReader

    @classmethod
    def name(cls) -> str:
        return "windowed_runs"


class PagedRunSource(_Source):
    reading = _PagedRunReader

    @classmethod
    def name(cls) -> str:
        return "paged_runs"


class ReleaseSource(_Source):
    reading = _ReleaseReader

    @classmethod
    def name(cls) -> str:
        return "paged_releases"


SOURCES = (PrSource, RunSource, PagedRunSource, ReleaseSource)
