"""Lookups by key and by position, with and without a default row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key, none if it is absent."""
    return df.where(F.col(key) == F.lit(value))


def lookup_or_default(df: DataFrame, facts: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``df`` with the other columns of ``facts`` by ``key``; rows without a match take the first row of ``facts``.

    The first row is that of least ``order`` (by default the key): one row, so
    its values enter the plan as constants. Without facts all stay null. A null
    key matches nothing. ``facts`` has one row for each key.
    """
    others = [c for c in facts.columns if c != key]
    first = facts.orderBy(order or key).first()
    joined = df.join(facts.withColumn("__met", F.lit(True)), key, "left")
    for c in others:
        value = F.lit(first[c] if first else None).cast(facts.schema[c].dataType)
        joined = joined.withColumn(c, F.when(F.col("__met"), F.col(c)).otherwise(value))
    return joined.drop("__met")


def compared(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows whose key is among ``ids``; the order is that of the table, not of the list."""
    return df.where(F.col(key).isin(list(ids)))


def at_position(df: DataFrame, order: list[str], place: int) -> DataFrame:
    """The row at ``place`` (from 1) in the order of ``order``; none out of bounds."""
    if place < 1:
        return df.limit(0)
    return df.orderBy(*order).offset(place - 1).limit(1)


def navigate(posts: DataFrame, schools: DataFrame, post_key: str, school_key: str) -> DataFrame:
    """Posts with the columns of the school that they name."""
    return posts.join(schools, posts[post_key] == schools[school_key])
