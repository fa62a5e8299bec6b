"""Static-analysis snapshots as a Spark data source: one partition for each repository and snapshot date.

What a partition does is a parameter ("runner", an importable `module:function` of a repository, a date and the options, which
returns the commit and its measures, or None where there is no commit yet). `scan` is the default: it clones the repository
into a folder of its own, checks out the last commit at or before the date, runs the analyser and asks its server for the measures. Without
a runner and without a server nothing can be measured, and there are no partitions.

    spark.dataSource.register(SnapshotSource)
    spark.read.format("snapshots").options(repos="a/b", start="2024-01-01", end="2025-01-01", frequency="monthly", server="http://...").load()
"""

from __future__ import annotations

import importlib
import subprocess
import tempfile
from collections.abc import Iterator
from datetime import date

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cadenza.operators.calendar import STEPS
from cadenza.sources import api, schemas

#: What is asked of the server, in the order of the columns after repository, date and commit.
MEASURES = tuple(schemas.SNAPSHOTS.fieldNames()[3:])


def dates(start: str, end: str, frequency: str) -> list[str]:
    """The first of each month, or of each third, from the month of `start`; `end` is excluded."""
    if frequency not in STEPS:
        raise ValueError(f"frequency is {frequency}; it can be {sorted(STEPS)}")
    at, last = date.fromisoformat(start).replace(day=1), date.fromisoformat(end)
    found = []
    while at < last:
        found.append(at.isoformat())
        months = at.year * 12 + at.month - 1 + STEPS[frequency]
        at = date(months // 12, months % 12 + 1, 1)
    return found


def run(*command: str, cwd: str | None = None) -> str:
    """The output of a command; an error with its messages if it fails."""
    done = subprocess.run(command, cwd=cwd, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{command[0]} failed: {done.stderr[-2000:]}")
    return done.stdout.strip()


def measured(repo: str, options: dict) -> dict[str, str]:
    """The measures that the server has of a repository now, as it gives them."""
    key = repo.replace("/", "__")
    url = f"{options['server'].rstrip('/')}/api/measures/component?component={key}&metricKeys={','.join(MEASURES)}"
    answer = api.retried(lambda: api.http(url, None, options.get("token", "")))
    return {m["metric"]: m["value"] for m in answer["component"]["measures"] if "value" in m}


def scan(repo: str, day: str, options: dict) -> tuple[str, dict[str, str]] | None:
    """Clone, check out, analyse, ask. The folder is the task's own and goes with it; nothing else reads it."""
    with tempfile.TemporaryDirectory(prefix="snapshot-") as folder:
        run("git", "clone", "--quiet", f"{options.get('git', 'https://github.com')}/{repo}", folder)
        commit = run("git", "rev-list", "-n", "1", f"--before={day} 23:59:59", "HEAD", cwd=folder)
        if not commit:
            return None
        run("git", "checkout", "--quiet", commit, cwd=folder)
        run(*options.get("scanner", "sonar-scanner").split(), f"-Dsonar.projectKey={repo.replace('/', '__')}", f"-Dsonar.host.url={options['server']}", cwd=folder)
        return commit, measured(repo, options)


def recorded(repo: str, day: str, options: dict) -> tuple[str, dict[str, str]] | None:
    """A runner over pages that replay.record wrote."""
    from cadenza.sources import replay

    body = replay.fetch(f"{options['base']}/measures/{repo}/{day}", None, "")
    return (body["commit"], body["measures"]) if body.get("commit") else None


class _Work(InputPartition):
    def __init__(self, repo: str, day: str):
        self.repo, self.day = repo, day


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Work]:
        if not {"runner", "server"} & {*self.options}:
            return []
        days = dates(self.options["start"][:10], self.options["end"][:10], self.options.get("frequency", "monthly"))
        return [_Work(repo.strip(), day) for repo in self.options["repos"].split(",") if repo.strip() for day in days]

    def read(self, partition: _Work) -> Iterator[tuple]:
        if partition is None:  # Spark asks for one task where there is no partition
            return
        module, _, name = self.options.get("runner", f"{__name__}:scan").partition(":")
        found = getattr(importlib.import_module(module), name)(partition.repo, partition.day, self.options)
        if found:
            commit, measures = found
            yield (partition.repo, partition.day, commit, *(measures.get(m) for m in MEASURES))


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self):
        return schemas.SNAPSHOTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
