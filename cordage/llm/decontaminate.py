"""Benchmark decontamination by winnowed fingerprints.

Of each window of words the smallest hash of its k-grams is kept. Equal windows
keep equal hashes, so every shared span of at least a window's length shares a
fingerprint. Windows of documents whose fingerprint an item has, by a bitmap of the items' fingerprints in each task, are extended to
their words and joined with the items' windows, which confirms them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, in_bitmap, written
from .text import chunks, code_points, gram_hashes, lower_ascii, plain_words, span_hashes

_LOWER = {c: c + 32 for c in range(65, 91)}
_WINDOWS = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("words", pa.string())])
ITEM_SCHEMA = "item_id long, fingerprint long, n int, words string"
DOC_SCHEMA = "doc_id long, text_key long, n_words long, windows array<struct<at:int,n:int,words:string>>"


def _window_hashes(words: np.ndarray, window: int, k: int) -> np.ndarray:
    """The smallest hash of the k-grams in each window of words."""
    grams = gram_hashes(words, k)
    n = max(0, len(words) - window + 1)
    low = grams[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(low, grams[j : j + n], out=low)
    return low




def _segmented(texts: list[str]):
    points, offsets = code_points(texts)
    points = lower_ascii(points)
    starts, ends, first = plain_words(points, offsets)
    return offsets, starts, ends, first, span_hashes(points, starts, ends)


def _texts_of(text: str, base: int, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    low = text.translate(_LOWER)
    return [low[a:b] for a, b in zip((starts - base).tolist(), (ends - base).tolist())]


def _item_windows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("item_id").to_pylist()
            for at, texts in chunks(batch.column("text")):
                offsets, starts, ends, first, hashes = _segmented(texts)
                rows: list[tuple] = []
                low = _window_hashes(hashes, window, k)
                for i, text in enumerate(texts):
                    a, b = int(first[i]), int(first[i + 1])
                    if a == b or keys[at + i] is None:
                        continue
                    words = _texts_of(text, offsets[i], starts[a:b], ends[a:b])
                    n = min(window, b - a)
                    prints = low[a : b - n + 1] if n == window else gram_hashes(hashes[a:b], n)
                    rows += [(keys[at + i], p, n, " ".join(words[j : j + n])) for j, p in enumerate(prints.astype(np.int64).tolist())]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                    names=["item_id", "fingerprint", "n", "words"],
                )

    return run


def _doc_windows(prints: np.ndarray, lengths: list[int], window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                offsets, starts, ends, first, hashes = _segmented(texts)
                found: list[tuple[np.ndarray, int]] = []
                for n in lengths:
                    kept = _window_hashes(hashes, window, k) if n == window else gram_hashes(hashes, n)
                    hits = np.flatnonzero(in_bitmap(prints, kept))
                    doc = np.searchsorted(first, hits, "right") - 1
                    found.append((hits[hits + n <= first[doc + 1]], n))
                at_list = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.int64)
                sizes = np.concatenate([np.full(len(f), n) for f, n in found]) if found else at_list
                doc = np.searchsorted(first, at_list, "right") - 1
                order = np.argsort(doc, kind="stable")
                at_list, sizes, doc = at_list[order], sizes[order], doc[order]
                spelled: list[str] = []
                for i in np.unique(doc).tolist():
                    words = _texts_of(texts[i], offsets[i], starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])
                    mine = slice(*np.searchsorted(doc, [i, i + 1]))
                    spelled += [" ".join(words[j : j + n]) for j, n in zip((at_list[mine] - first[i]).tolist(), sizes[mine].tolist())]
                values = pa.StructArray.from_arrays(
                    [pa.array(at_list - first[doc], pa.int32()), pa.array(sizes, pa.int32()), pa.array(spelled, pa.string())], fields=list(_WINDOWS)
                )
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n),
                        batch.column("text_key").slice(at, n),
                        pa.array(np.diff(first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values),
                    ],
                    names=["doc_id", "text_key", "n_words", "windows"],
                )

    return run


def _hits(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """The columns of ``benchmark_hits`` and ``text_key``, a hash of the text."""
    item_rows = items.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_windows(window, k), ITEM_SCHEMA)
    item_rows = written(item_rows.distinct(), "benchmark")
    lengths = sorted(r.n for r in item_rows.select("n").distinct().collect())  # at most ``window`` values
    prints = bitmap(item_rows, "fingerprint")
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    found = written(source.mapInArrow(_doc_windows(prints, lengths, window, k), DOC_SCHEMA), "windows")

    key = ["doc_id", "text_key", "n_words"]
    spans = found.select(*key, F.explode("windows").alias("w")).select(*key, F.struct("w.at", "w.n").alias("span"), F.col("w.words").alias("words"))
    # windows of the same items are a class: a document meets its classes, not every item at every window, and a class's items once
    of_items = [F.bit_xor(F.xxhash64("item_id", F.lit(seed))).alias(f"items{seed}") for seed in (1, 2)]
    held = item_rows.groupBy("words").agg(F.count("*").alias("items0"), *of_items)
    held = held.select("words", F.struct("items0", "items1", "items2").alias("class"))
    classes = held.groupBy("class").agg(F.min("words").alias("words")).join(item_rows.select("words", "item_id"), "words").select("class", "item_id")
    matched = spans.join(held, "words").select(*key, "span", "class")
    blank = found.select(*key, F.lit(None).cast("struct<at:int,n:int>").alias("span"), F.lit(None).cast(held.schema["class"].dataType).alias("class"))
    met = written(blank.union(matched).groupBy(*key).agg(F.sort_array(F.collect_set("span")).alias("hits"), F.collect_set("class").alias("classes")), "met")
    named = met.where("size(classes) > 0").select(*key, F.explode("classes").alias("class")).join(classes, "class")
    named = named.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.collect_set("item_id").alias("items"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    # documents without a hit have nothing to join
    grouped = met.where("size(classes) > 0").join(named, same).select(*key, "hits", "items").unionByName(met.where("size(classes) = 0").select(*key, "hits", F.array().cast("array<bigint>").alias("items")))
    covered = """aggregate(hits, named_struct('upto', 0, 'n', 0L), (s, h) -> named_struct(
        'upto', greatest(s.upto, h.at + h.n), 'n', s.n + greatest(0, h.at + h.n - greatest(h.at, s.upto))), s -> s.n)"""
    return grouped.select(
        "doc_id",
        "text_key",
        "n_words",
        F.expr(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "hits",
    )


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Per document the words inside passages of benchmark items, and the items.

    ``docs`` has ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``.
    Words are runs of digits, letters and code points from 128 on, after A-Z
    become lower case. An item's windows are its runs of ``window`` words, or
    all its words where it has fewer. ``k`` of at most ``window`` sets the
    fingerprints; results do not depend on it.

    Returns ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of
    the item ids in string order, comma-joined; of the empty string without
    any), ``contaminated``, ``hits`` (sorted ``struct<at, n>`` in words). A null
    or empty text has no words. Items without words or with a null id match
    nothing; repeated items count once. Rows with equal id and text give one
    row; a null ``doc_id`` is a document like any other. Other columns are
    ignored. The items' fingerprints reach the tasks as a bitmap of fixed size.
    """
    return _hits(docs, items, window, k).drop("text_key")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, all columns kept.

    Documents are told apart by ``doc_id``; one without an id is judged by its text alone, whatever ids there are. Rows that
    share an id go together if one of them holds a window, a row of null or empty text too; without an id such a row stays. No rows give none.
    """
    named, key = (lambda c: F.col(c).isNotNull()), (lambda c, text: F.coalesce(F.col(c).cast("long"), text))
    hits = _hits(docs, items, window, k).where("contaminated")
    bad = written(hits.select(named("doc_id").alias("__named"), key("doc_id", F.col("text_key")).alias("__bad")).distinct(), "contaminated")
    is_bad = (named("doc_id") == F.col("__named")) & (key("doc_id", F.xxhash64("text")) == F.col("__bad"))
    return docs.join(bad, is_bad, "left_anti")
