"""Pieces that several operators need: written tables, bounded filters, components."""

from __future__ import annotations

import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made = threading.local()  # ``paths``: what this thread's stages have made, so that pipelines side by side keep theirs


def made_folder(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder for a table that is written in parts; it goes with those of ``passing_tables``."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if not hasattr(_made, "paths"):
        _made.paths = []
    _made.paths.append(path)
    return path


def written(df: DataFrame, what: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    The read starts a new lineage, so a lost executor costs a re-read and not
    a recomputation, and each reader loads only the columns that it uses.
    """
    path = made_folder(df.sparkSession, what)
    df.write.format(fmt).options(**options).save(path)
    table = df.sparkSession.read.schema(df.schema).format(fmt).load(path)
    _paths[table] = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for _ in range(3):
        files.delete(folder, True)
        if not files.exists(folder):
            break


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, _paths.pop(table))


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Remove at the end, after an error too, all tables that this thread has ``written`` inside: for work whose result has been stored by then."""
    outer, _made.paths = getattr(_made, "paths", []), []
    try:
        yield
    finally:
        inner, _made.paths = _made.paths, outer
        for path in inner:  # those discarded already too, if anything of them is left
            _remove(spark, path)


def small_side(table: DataFrame, most: int = 1 << 15) -> DataFrame:
    """A stored ``table`` with a broadcast hint if it has no more than ``most`` rows, as counted; a larger one joins as Spark sees fit."""
    return F.broadcast(table) if table.count() <= most else table


def bitmap(keys: DataFrame, column: str, most: int = 1 << 28) -> np.ndarray:
    """A bit for each residue that ``column`` (long) takes modulo the number of bits.

    There are 2**24 bits, or from 64 to 128 for each row of ``keys`` if those are more, but no more
    than ``most``: 32 MB by default, which can be sent to every task. It only
    lets a task drop rows that cannot join; the exact join follows. Over
    ``most / 4`` keys it drops few rows.
    """
    bits = min(most, 1 << max(24, (64 * keys.count()).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1).cast("long"))
    words = (
        keys.where(F.col(column).isNotNull())
        .select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("value"))
    )
    found = words.toArrow()  # bits / 64 rows at most
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["value"].to_numpy().astype(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (uint64 or int64) have their bit set."""
    at = keys.astype(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bases(counts: DataFrame, amount: str, kind: str, part: str, group: int = 1024) -> DataFrame:
    """``counts`` with ``base``: the sum of ``amount`` over all rows of greater ``kind``, and of equal kind and smaller ``part``.

    Both are whole numbers, and a pair of them has one row. Sums go over groups
    of ``group`` parts first, so no task holds all rows. The result comes as a ``small_side`` of up to a million rows.
    """
    cut = counts.withColumn("__group", F.expr(f"{part} div {group}"))
    before = lambda w: F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy(kind, "__group").agg(F.sum(amount).alias(amount))
    outer = sums.select(F.col(kind).alias("__kind"), F.col("__group").alias("__of"), before(Window.orderBy(F.desc(kind), "__group")).alias("__outer"))
    inner = cut.withColumn("__inner", before(Window.partitionBy(kind, "__group").orderBy(part)))
    joined = inner.join(outer, (F.col(kind) == F.col("__kind")) & (F.col("__group") == F.col("__of")))
    return small_side(written(joined.select(*counts.columns, (F.col("__outer") + F.col("__inner")).alias("base")), "bases"), 1 << 20)


def positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """A stored ``df`` with ``position``, the number of rows that come before in ``order``, which tells all rows apart.

    Rows are sorted by ranges, and a count for each range places it among all: no task holds more than a range.
    """
    at = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    at = at.withColumn("__part", F.shiftright("__at", 33))
    counts = at.groupBy(F.col("__part").alias("__range")).agg(F.count("*").alias("__count")).withColumn("__all", F.lit(0))
    base = bases(counts, "__count", "__all", "__range").select("__range", "base")
    inner = F.col("__at") - F.shiftleft("__part", 33)
    return at.join(base, F.col("__part") == F.col("__range")).select(*df.columns, (F.col("base") + inner).alias("position"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node``, ``root``.
    Large-star and small-star alternate: each is a minimum per node, which is
    aggregated before the shuffle, and a join by node, whose hot nodes adaptive
    execution splits. No neighbour list is ever gathered. Edges with a null end
    and loops are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now = written(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").selectExpr("b AS a", "m AS b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.expr("array(struct(a AS a, m AS b), struct(b AS a, m AS b))")).alias("e"))
        before, now = now, written(small.select("e.*").where("a <> b").distinct(), "edges")
        discard(before)
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(now.select("b", "b").distinct())
