"""Keyed tables whose batches are written beside the rows, and merged when they are read.

A table lies in hash buckets of its key. A batch adds a folder with its own rows, and
marks for keys that are gone, so it writes in proportion to itself; a reader merges it with only
the buckets that it touches. Compaction folds batches into those buckets alone. Every
change is a version, seen once a pointer has moved, so all of ``VersionedTable`` holds here too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import latest
from .versions import VersionedTable

BUCKET, GONE, SEEN = "__bucket", "__gone", "__version"


class MergeTable(VersionedTable):
    """A table at ``path`` with unique keys, which are compared in lower case.

    A version N is a folder ``v=N`` (all buckets), ``fold=N-P`` (some buckets whole, as of version P) or
    ``delta=N-P`` (changes to P), each with a folder for each bucket that it holds. Rows of a null key
    stay as they are: no batch replaces or removes them. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int = 256) -> None:
        super().__init__(spark, path)
        self.key, self.buckets = key, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lower(self.key)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Files by bucket. A bucket's rows come from one task, or from several if adaptive execution splits it."""
        rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")

    def next_version(self) -> int:
        return max((int(n.split("-")[0]) for start in ("v=", "fold=", "delta=") for n in self._names(start)), default=0) + 1

    def _layers(self, version: int) -> Iterator[tuple[str, int, set[int]]]:
        """Folders that make up ``version``, newest first: kind, number, and buckets."""
        of = {int(n.split("-")[0]): (kind, n) for kind in ("v", "fold", "delta") for n in self._names(f"{kind}=")}
        at: int | None = version
        while at is not None:
            if at not in of:
                raise FileNotFoundError(f"no version {at} of {self.path}")
            kind, name = of[at]
            there = self._of(f"{kind}={name}")
            found = {int(s.getPath().getName().removeprefix(f"{BUCKET}=")) for s in self._fs.listStatus(there) if s.getPath().getName().startswith(BUCKET)}
            yield kind, at, set(range(self.buckets)) if kind == "v" else found
            at = None if kind == "v" else int(name.split("-")[1])

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/" + next(f"{kind}={n}" for n in self._names(f"{kind}=") if int(n.split("-")[0]) == version)

    def _scan(self, kind: str, version: int, buckets: set[int], *more: T.StructField) -> DataFrame:
        schema = T.StructType([*self.schema, *more, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(self._folder(kind, version))
        return rows if len(buckets) == self.buckets else rows.where(F.col(BUCKET).isin(sorted(buckets)))  # of the folders, not of the rows

    def _merged(self, version: int, only: set[int] | None = None) -> tuple[DataFrame, set[int]]:
        """Rows of ``version`` in ``only`` these buckets, and the buckets that hold changes."""
        left, whole, changes, touched = set(range(self.buckets)) if only is None else set(only), [], [], set()
        for kind, at, there in self._layers(version):
            here = there & left
            if here and kind == "delta":
                changes.append(self._scan("delta", at, here, T.StructField(GONE, T.BooleanType())).withColumn(SEEN, F.lit(at)))
                touched |= here
            elif here:
                whole.append((self._scan(kind, at, here - touched), self._scan(kind, at, here & touched)) if here & touched else (self._scan(kind, at, here), None))
                left -= here
        names = self.schema.names
        out = [untouched.select(*names) for untouched, _ in whole]
        if changes:
            last = latest(reduce(DataFrame.union, changes), self.key, SEEN)
            keys = last.where(F.col(self.key).isNotNull()).select(F.lower(self.key).alias("__key"))
            for rows in (rows for _, rows in whole if rows is not None):
                out.append(rows.join(keys, F.lower(rows[self.key]) == F.col("__key"), "left_anti").select(*names))
            out.append(last.where(f"not {GONE}").select(*names))
        empty = self.spark.createDataFrame([], self.schema)
        return (reduce(DataFrame.union, out) if out else empty), touched

    def read(self, version: int | None = None) -> DataFrame:
        """The current or a given version. Buckets without changes are only scanned."""
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._merged(version)[0]

    def commit(self, rows: DataFrame) -> int:
        """Write ``rows``, with each key once, as the whole table."""
        version = self.next_version()
        self._write(rows.select(*self.schema.names), f"v={version}")
        self._point(version)
        return version

    def _change(self, rows: DataFrame) -> int:
        before, version = self.version(), self.next_version()
        if before is None:
            raise FileNotFoundError(f"no version of {self.path}")
        self._write(rows.select(*self.schema.names, GONE), f"delta={version}-{before}")
        self._point(version)
        return version

    def upsert(self, batch: DataFrame, seq: str) -> int:
        """Put in the last row by ``seq`` of each key of ``batch``; rows of a null key are all added."""
        return self._change(latest(batch.select(*self.schema.names, seq), self.key, seq).withColumn(GONE, F.lit(False)))

    def remove(self, keys: DataFrame) -> int:
        """Take out the rows whose key is in the key column of ``keys``; null keys remove nothing."""
        gone = keys.select(F.lower(self.key).alias("__key")).where("__key is not null").distinct()
        row = [F.col("__key").cast(f.dataType).alias(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        return self._change(gone.select(*row, F.lit(True).alias(GONE)))

    def compact(self) -> int:
        """Fold all changes into the buckets that they touch; the others are neither read nor written. Older versions stay readable."""
        before = self.version()
        if before is None:
            raise FileNotFoundError(f"no version of {self.path}")
        touched = self._merged(before)[1]
        if not touched:
            return before
        version = self.next_version()
        folder = f"fold={version}-{before}"
        self._write(self._merged(before, touched)[0], folder)
        for bucket in touched:  # also those that have become empty
            self._fs.mkdirs(self._of(f"{folder}/{BUCKET}={bucket}"))
            self._fs.createNewFile(self._of(f"{folder}/{BUCKET}={bucket}/_whole"))
        self._point(version)
        return version

    def rollback(self, version: int) -> None:
        """Make an older version the current one; nothing is deleted, and later batches build on it."""
        list(self._layers(version))
        self._point(version)
