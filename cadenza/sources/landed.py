"""Landed API answers as raw entities, of any number of repositories at once.

Nodes come as the connectors return them, (owner, repo, node as JSON), and `parsed` makes columns of them. Tables of one
repository without owner and repo columns take both as parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import exprs, time


def _since(created: Column, since: str | None) -> Column:
    return F.lit(True) if since is None else F.coalesce(time.parsed(created) >= time.parsed(F.lit(since)), F.lit(False))


def parsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """(owner, repo, node) with the node's fields as columns; fields that a node lacks are null."""
    return raw.select("owner", "repo", F.from_json("node", schema).alias("n")).select("owner", "repo", "n.*")


def _named(owner: str | None, repo: str | None) -> list[Column]:
    o = F.col("owner") if owner is None else F.lit(owner)
    r = F.col("repo") if repo is None else F.lit(repo)
    return [o.alias("owner"), r.alias("repo"), F.concat(o, F.lit("/"), r).alias("repo_full")]


def prs(nodes: DataFrame, owner: str | None = None, repo: str | None = None, since: str | None = None) -> DataFrame:
    """Change requests created at or after `since`; their first review and number of reviews from the nested list."""
    reviews = F.col("reviews.nodes")
    return nodes.where(_since(F.col("createdAt"), since)).select(
        *_named(owner, repo), F.col("number").alias("pr_number"), F.col("createdAt").alias("created_at"), F.col("mergedAt").alias("merged_at"),
        F.col("closedAt").alias("closed_at"), "state", F.col("isDraft").alias("is_draft"), "additions", "deletions", F.col("changedFiles").alias("changed_files"),
        F.col("commits.totalCount").alias("commit_count"), F.col("author.login").alias("author"), F.col("mergeCommit.oid").alias("merge_sha"),
        exprs.earliest(reviews, "createdAt").alias("first_review_at"), exprs.length(reviews).alias("review_count"),
    )


def runs(nodes: DataFrame, owner: str | None = None, repo: str | None = None, since: str | None = None, dedupe: bool = True) -> DataFrame:
    """Workflow runs; `dedupe` keeps one row of a run that two fetch windows returned, as neighbouring ones share a day."""
    out = nodes.where(_since(F.col("created_at"), since)).select(
        *_named(owner, repo), F.col("id").alias("run_id"), F.col("name").alias("workflow_name"), "event", "status", "conclusion", "created_at",
        "run_started_at", "updated_at", "head_sha", exprs.numbers(F.col("pull_requests")).alias("pr_numbers"),
    )
    return out.dropDuplicates(["repo_full", "run_id"]) if dedupe else out


def releases(nodes: DataFrame, owner: str | None = None, repo: str | None = None, since: str | None = None) -> DataFrame:
    """Releases published (or else created) at or after `since`."""
    return nodes.where(_since(F.coalesce("published_at", "created_at"), since)).select(
        *_named(owner, repo), F.col("id").alias("release_id"), "tag_name", "name", "draft", "prerelease", "created_at", "published_at"
    )


def pr_details(nodes: DataFrame, owner: str | None = None, repo: str | None = None) -> DataFrame:
    """What the wider query tells beside `prs`: title, branches, and who reviewed, each once and in order."""
    reviewers = F.filter(F.transform("reviews.nodes", lambda r: r.author.login), lambda login: login.isNotNull())
    return nodes.select(
        *_named(owner, repo)[2:], F.col("number").alias("pr_number"), "title", F.col("baseRefName").alias("base_ref"), F.col("headRefName").alias("head_ref"),
        F.array_sort(F.array_distinct(F.coalesce(reviewers, F.array().cast("array<string>")))).alias("reviewers"),
    )
