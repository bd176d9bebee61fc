"""Rounding, defaults and matching with the semantics of the records' own application."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The nearest whole number, ties towards positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def filled(x: Column, empty: object = "") -> Column:
    """``x``, or null where it is ``empty``."""
    return F.nullif(x, F.lit(empty))


def stripped(x: Column) -> Column:
    """``x`` without white space of any kind at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def first_filled(*options: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(filled(o) for o in options))


def is_yes(x: Column) -> Column:
    """True where ``x`` is true; null counts as false."""
    return x.eqNullSafe(F.lit(True))


def lowered(text: Column) -> Column:
    """``text`` in lower case, null as empty."""
    return F.lower(F.coalesce(text, F.lit("")))


def holds_any(low: Column, words: Iterable[str]) -> Column:
    """Whether a text that is ``lowered`` holds any of the lower-case ``words``."""
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words), F.lit(False))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased ``text`` (null: empty) holds any of the lower-case ``words``."""
    return holds_any(lowered(text), words)


def first_match(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first element that passes ``test``, null without any."""
    return F.get(F.filter(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(0))


def count_of(items: Column) -> Column:
    """Elements of an array; a null array has none."""
    return F.coalesce(F.size(items), F.lit(0))


def bounds(items: Column, field: str) -> tuple[Column, Column]:
    """Least and greatest ``field`` of an array of structs; zeros and nulls don't count, and without others both are null."""
    found = F.transform(F.filter(items, lambda x: x[field] != 0), lambda x: x[field])
    return F.array_min(found), F.array_max(found)


def share_percent(part: Column, total: Column) -> Column:
    """Whole percent of ``total``, null unless the total is positive."""
    return F.when(total > 0, half_up(part.cast("double") / total * 100))
