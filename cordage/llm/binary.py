"""Token ids as ORC files in document order.

ORC stores the ids with integer run-length encoding. Each stripe carries row
indexes and a Bloom filter on ``doc_id``, so readers split files by stripe and
skip stripes and row groups by a document's id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import encode_column
from .shared import bases, shared_folder

SCHEMA = "part int, doc_id long, part_start long, n_tokens long, tokens array<int>"
FILE_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
}


def _encoder(path: str, end_id: int | None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_column = batch.column("doc_id")
            for at, ids, cuts in encode_column(batch.column("text"), path, end_id):
                n = len(cuts) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        ids_column.slice(at, n),
                        pa.array(done + cuts[:-1], pa.int64()),
                        pa.array(cuts[1:] - cuts[:-1], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())),
                    ],
                    names=["part", "doc_id", "part_start", "n_tokens", "tokens"],
                )
                done += int(cuts[-1])

    return encode


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write the ids to ``path`` in ascending ``doc_id`` order.

    One range partition becomes one file; within it a running count gives each
    document's place, so no row is shuffled after encoding. A null text is
    empty, and an empty text has the end id only. A null ``doc_id`` comes
    first. Rows that share a ``doc_id`` all stay, in the order of a hash of
    their texts. No row gives no file. Other columns are ignored.
    """
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_encoder(tokenizer, end_id), SCHEMA).write.format("orc").options(**FILE_OPTIONS).mode("overwrite").save(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``tokens`` from the files.

    ``start`` adds to the place within a file the ids of the files before it.
    There is a row for each written one, repeated and null ids included; a
    folder without files gives none.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy(F.col("part").alias("file")).agg(F.sum("n_tokens").alias("n")).withColumn("all", F.lit(0))  # a row for each file
    joined = rows.join(bases(totals, "n", "all", "file"), F.col("part") == F.col("file"))
    return joined.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def with_crc32(rows: DataFrame, column: str = "tokens", to: str = "ids_crc32") -> DataFrame:
    """``rows`` with the unsigned crc32 of an ``array<int>`` column as little-endian 32-bit integers in its place.

    An empty or null array has the sum 0; all rows and other columns stay.
    """
    kept = [c for c in rows.columns if c != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column) + f", `{to}` long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(column)
            data, at = ids.values.to_numpy(zero_copy_only=False).astype("<i4"), ids.offsets.to_pylist()
            sums = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, to])

    return rows.mapInArrow(digest, schema)


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the files, read them back, and return ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document.

    Null, empty and repeated texts and ids are as in ``write_token_ids``.
    """
    import uuid

    path = path or f"{shared_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, path, tokenizer, end_id)
    return with_crc32(read_token_ids(docs.sparkSession, path))
