"""Upsert by a key whose case does not matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(batch: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of greatest ``seq`` for each key in lower case; rows of a null key are all kept, as nothing tells them to be one."""
    rest = [c for c in batch.columns if c != seq]
    best = batch.where(F.col(key).isNotNull()).groupBy(F.lower(key).alias("__key")).agg(F.max_by(F.struct(*rest), F.struct(seq, *rest)).alias("__row"))
    return best.select("__row.*").unionByName(batch.where(F.col(key).isNull()).drop(seq))


def upsert(base: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """``base`` without the keys that ``batch`` has, and the batch's last row of each key.

    Rows of a null key are never replaced, and those of the batch are all added. ``batch`` has the columns of
    ``base`` and ``seq``, the order of its rows.
    """
    new = latest(batch, key, seq)
    gone = new.where(F.col(key).isNotNull()).select(F.lower(key).alias("__gone"))
    return base.join(gone, F.lower(base[key]) == F.col("__gone"), "left_anti").unionByName(new)
