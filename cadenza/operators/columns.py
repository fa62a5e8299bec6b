"""Schema guards: they look at column names when a plan is built and run no job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, names: Sequence[str], what: str = "input") -> DataFrame:
    """`df`, or ValueError naming the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
    return df


def pick_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first of `candidates` that `df` has."""
    return next((c for c in candidates if c in df.columns), None)


def select_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of `names` that `df` has, in their order."""
    return df.select(*(n for n in names if n in df.columns))
