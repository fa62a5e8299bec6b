"""Schemas of the raw entities."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def _of(**columns) -> T.StructType:
    """A struct of column=type, each a type or the name of one."""
    return T.StructType([T.StructField(n, _TYPES.get(t, t) if isinstance(t, str) else t) for n, t in columns.items()])


S, N, B = "string", "bigint", "boolean"

PRS = _of(
    owner=S, repo=S, repo_full=S, pr_number=N, created_at=S, merged_at=S, closed_at=S, state=S, is_draft=B, additions=N, deletions=N, changed_files=N, commit_count=N,
    author=S, merge_sha=S, first_review_at=S, review_count=N,
)
RUNS = _of(
    owner=S, repo=S, repo_full=S, run_id=N, workflow_name=S, event=S, status=S, conclusion=S, created_at=S, run_started_at=S, updated_at=S, head_sha=S,
    pr_numbers=T.ArrayType(T.LongType()),
)
RELEASES = _of(owner=S, repo=S, repo_full=S, release_id=N, tag_name=S, name=S, draft=B, prerelease=B, created_at=S, published_at=S)
SNAPSHOTS = _of(
    repo_full=S, snapshot_date=S, commit=S, code_smells=S, sqale_debt_ratio=S, complexity=S, duplicated_lines_density=S, sqale_rating=S, sqale_index=S
)

#: A change request as the query interface returns it; a run and a release as the paged interface does.
_REVIEW = _of(createdAt=S, state=S, author=_of(login=S))
PR_NODE = _of(
    number=N, title=S, createdAt=S, mergedAt=S, closedAt=S, state=S, isDraft=B, additions=N, deletions=N, changedFiles=N, baseRefName=S, headRefName=S,
    commits=_of(totalCount=N), author=_of(login=S), mergeCommit=_of(oid=S), reviews=_of(nodes=T.ArrayType(_REVIEW)),
)
RUN_NODE = _of(
    id=N, name=S, event=S, status=S, conclusion=S, created_at=S, run_started_at=S, updated_at=S, head_sha=S, pull_requests=T.ArrayType(_of(number=N))
)
RELEASE_NODE = _of(id=N, tag_name=S, name=S, draft=B, prerelease=B, created_at=S, published_at=S)
