"""Packing by powers of two: no sequence crosses documents and none is padded.

A document of n tokens becomes pieces of the lengths in n's binary form, with
as many of the longest length as fit. Every piece is a sequence of its own;
sequences are numbered by length, longest first, so those of one length are
neighbours and form even batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary import with_crc32
from .encode import encode_column
from .shared import bases, written

SCHEMA = "part int, doc_id long, doc_tokens long, start long, length long, rank long, ids array<int>"


def binary_pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and length of each piece, by document and then by falling length."""
    whole = sizes // longest
    docs, lengths = [np.repeat(np.arange(len(sizes)), whole)], [np.full(int(whole.sum()), longest)]
    bit = longest >> 1
    while bit:
        having = np.flatnonzero(sizes & bit)
        docs.append(having)
        lengths.append(np.full(len(having), bit))
        bit >>= 1
    docs, lengths = np.concatenate(docs), np.concatenate(lengths)
    order = np.argsort(docs, kind="stable")
    return docs[order], lengths[order]


def _packer(path: str, end_id: int | None, longest: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(longest.bit_length(), dtype=np.int64)
        for batch in batches:
            keys = batch.column("doc_id")
            for at, ids, cuts in encode_column(batch.column("text"), path, end_id):
                sizes = np.diff(cuts)
                docs, lengths = binary_pieces(sizes, longest)
                ends = np.cumsum(lengths)  # the pieces tile the ids
                rank = np.zeros(len(docs), dtype=np.int64)
                for bit in range(len(seen)):
                    of = np.flatnonzero(lengths == 1 << bit)
                    rank[of] = seen[bit] + np.arange(len(of))
                    seen[bit] += len(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(docs), part), pa.int32()),
                        keys.take(pa.array(at + docs, pa.int64())),
                        pa.array(sizes[docs], pa.int64()),
                        pa.array(ends - lengths - cuts[docs], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(rank, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())),
                    ],
                    names=["part", "doc_id", "doc_tokens", "start", "length", "rank", "ids"],
                )

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = None, longest: int = 2048) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``doc_tokens``, ``start``, ``length``, ``sequence_id``, ``offset``, ``ids``.

    ``longest`` is a power of two. Documents stay in their input partitions:
    each task ranks its pieces by length, and one row for each length and
    partition places them among all, so sequence ids are dense without a
    shuffle. A null text is empty; without ``end_id`` an empty text has no
    piece. Repeated rows are packed each time; a null ``doc_id`` stays null; no
    rows give none. Other columns are ignored.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    pieces = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packer(tokenizer, end_id, longest), SCHEMA), "pieces", compression="zstd")
    counts = pieces.groupBy(F.col("part").alias("of"), F.col("length").alias("size")).count()  # at most one row for each length and partition
    joined = pieces.join(bases(counts, "count", "size", "of"), (F.col("part") == F.col("of")) & (F.col("length") == F.col("size")))
    return joined.select("doc_id", "doc_tokens", "start", "length", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def packed_digest(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 2048) -> DataFrame:
    """The pieces of ``pack_documents`` with ``ids_crc32``, the crc32 of their ids, in place of ``ids``; all else as there."""
    return with_crc32(pack_documents(docs, tokenizer, end_id, longest), "ids")
