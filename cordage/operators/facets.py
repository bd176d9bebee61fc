"""Filters whose parts switch off by a sentinel, so that only active ones reach the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Distance options that filter; any other option filters nothing.
WITHIN = {"Within 5 km": 5, "Within 10 km": 10, "Within 20 km": 20}


def _not_over(column: Column, most: float) -> Column:
    return F.coalesce(~(column > most), F.lit(True))  # a null is over nothing


def facet_filter(df: DataFrame, exact: dict[str, str] | None = None, ceiling: tuple[str, float] | None = None, distance: tuple[str, str] | None = None) -> DataFrame:
    """Rows that pass every active facet.

    ``exact`` maps columns to wanted values; a value that begins with ``All ``
    is inactive. ``ceiling`` is a column of amounts and the most thousands of
    it; ``distance`` a column of kilometres and an option. Limits are
    inclusive, and nulls pass limits but no exact facet.
    """
    tests = [F.col(c) == v for c, v in (exact or {}).items() if not v.startswith("All ")]
    if ceiling:
        tests.append(_not_over(F.col(ceiling[0]) / 1000, ceiling[1]))
    if distance and distance[1] in WITHIN:
        tests.append(_not_over(F.col(distance[0]), WITHIN[distance[1]]))
    for test in tests:
        df = df.where(test)
    return df


def text_search(df: DataFrame, query: str, columns: Iterable[str]) -> DataFrame:
    """Rows of which any of ``columns`` holds ``query``, whatever the case; a blank query gives all rows.

    The query is not trimmed, and null columns hold nothing.
    """
    if not query.strip():
        return df
    wanted = F.lower(F.lit(query))
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False))
    return df.where(found)


def category_filter(df: DataFrame, column: str, choice: str, every: str = "All") -> DataFrame:
    """Rows of one category, or all rows for the sentinel."""
    return df if choice == every else df.where(F.col(column) == choice)


def status_gate(df: DataFrame, column: str = "status", good: str = "ok") -> DataFrame:
    """Rows of good status; null is not good."""
    return df.where(F.col(column).eqNullSafe(F.lit(good)))


def match_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count("*").alias("n_matches"))
