"""Scalar expressions shared by the metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conclusions that count as failures, and what marks a delivery workflow by its name.
FAILED = ("failure", "cancelled", "timed_out")
DELIVERY_BROAD = r"(?i)(deploy|release|publish|delivery|cd)"
DELIVERY_BOUNDED = r"(?i)(deploy|release|publish|delivery|\bcd\b)"


def is_in(value: Column, members: Sequence[str]) -> Column:
    """Membership; null is no member."""
    return F.coalesce(value.isin(*members), F.lit(False))


def equals(value: Column, other) -> Column:
    """Equality; null is unequal."""
    return F.coalesce(value == other, F.lit(False))


def as_flag(value: Column, missing: bool) -> Column:
    """A boolean from a flag that may be missing; `missing` says what that counts as."""
    return F.coalesce(value.cast("boolean"), F.lit(missing))


def matches(name: Column, pattern: str) -> Column:
    """Case as the pattern says; a null name is an empty one."""
    return F.coalesce(name, F.lit("")).rlike(pattern)


def churn(additions: Column, deletions: Column) -> Column:
    """Lines added and deleted; null counts as 0."""
    return F.coalesce(additions, F.lit(0)) + F.coalesce(deletions, F.lit(0))


def rate(flag: Column) -> Column:
    """The share of true among non-null flags (an aggregate)."""
    return F.avg(flag.cast("double"))


def earliest(items: Column, field: str) -> Column:
    """The least non-empty `field` of an array of structs; null if there is none."""
    return F.array_min(F.filter(F.transform(items, lambda x: x[field]), lambda v: v.isNotNull() & (v.cast("string") != "")))


def length(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)).cast("long")


def numbers(items: Column, field: str = "number") -> Column:
    """`field` of each struct, without null and 0; an empty array for null."""
    found = F.filter(F.transform(items, lambda x: x[field]), lambda v: v.isNotNull() & (v != 0))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def slug(owner: Column, repo: Column) -> Column:
    """owner__repo, with any "/" replaced too."""
    return F.replace(F.concat_ws("__", owner, repo), F.lit("/"), F.lit("__"))
