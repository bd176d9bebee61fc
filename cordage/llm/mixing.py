"""Mixing sources to target weights by fitting budgets as subset sums.

Documents are counted by source and exact length. Whole copies of a source come
first; what is left of its target is a budget, spread over all lengths in
proportion to their counts, and the last of it is fitted by a bounded-knapsack
dynamic programme over lengths. Which documents of a length are taken is decided by a seeded
hash of their ids, up to a threshold.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import positions, small_side, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a hash bucket, about, within which the threshold of a length is looked for.
BUCKET = 4096
FIT_SCHEMA = "sid long, size long, n long, copies long, extra long"


def bounded_subset(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, at most ``counts``, so that the sum comes nearest to ``budget`` from below.

    ``lengths`` are distinct and positive. A bit for each sum tells whether it can be reached; items are binary
    parts of the counts, and each sum remembers the first item that reached it.
    """
    reached, whole = 1, (1 << budget + 1) - 1
    first = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, part = min(count, budget // length), 1
        while left > 0 and not reached >> budget & 1:
            take = min(part, left)
            new = (reached << length * take) & whole & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: budget + 1])] = len(items)
                reached |= new
            items.append((i, take))
            left, part = left - take, part * 2
    taken, total = [0] * len(lengths), reached.bit_length() - 1
    while total:
        i, take = items[first[total]]
        taken[i] += take
        total -= lengths[i] * take
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int, exact: int = 1 << 16) -> list[int]:
    """How many documents of each length make up ``budget`` words, ``0 <= budget < sum(length * count)``.

    All but about four of the longest documents is spread over the lengths in proportion to their
    counts, so a mix has documents of every length; what is left, ``exact`` at most, is fitted by
    ``bounded_subset`` with the documents that remain. Where that falls short, a budget of
    at most ``exact`` is fitted from nothing, so as well as any choice can.
    """
    window = min(exact, 4 * max(lengths, default=1))
    whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
    spread = max(0, budget - window)
    taken = [count * spread // whole for count in counts] if spread else [0] * len(counts)
    left = budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: (-(counts[i] * spread % whole), lengths[i])):  # what the floors have left over
        if left - lengths[i] >= window and taken[i] < counts[i]:
            taken[i] += 1
            left -= lengths[i]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left <= window:
            break
        more = min(counts[i] - taken[i], left // lengths[i], -(-(left - window) // lengths[i]))
        taken[i] += more
        left -= more * lengths[i]
    if left <= exact:  # else no document that remains is short enough
        longest_first = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        more = bounded_subset([lengths[i] for i in longest_first], [counts[i] - taken[i] for i in longest_first], left)
        for i, n in zip(longest_first, more, strict=True):
            taken[i] += n
            left -= n * lengths[i]
    if left and window < budget <= exact:
        return max(taken, bounded_subset(lengths, counts, budget), key=lambda t: sum(a * b for a, b in zip(lengths, t, strict=True)))
    return taken


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``sid`` and ``target``: ``share`` of all sizes dealt out by weight.

    Sources in the order of their code points, null last, take ``weights`` in turn. No
    target passes ``most`` times its source's size; what lies above is dealt again by weight. The
    level of the others rises from round to round until no more are capped: a sum over the sources a round.
    """
    placed = positions(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")).cast("long")
    placed = placed.select("source", "source_size", F.col("position").alias("sid"), weight.alias("__w"), (F.col("source_size") * most).alias("__cap"))
    whole = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level = Fraction(0)

    def capped(level: Fraction):
        return F.col("__cap").cast("decimal(38,0)") * F.lit(level.denominator).cast("decimal(19,0)") <= F.col("__w").cast("decimal(9,0)") * F.lit(str(level.numerator)).cast("decimal(28,0)")

    while True:
        found = placed.agg(F.sum(F.when(capped(level), F.col("__cap"))), F.sum(F.when(~capped(level), F.col("__w")))).first()
        if not found[1]:
            break
        before, level = level, (whole - (found[0] or 0)) / found[1]
        if level == before:
            break
    open_target = (F.col("__w").cast("double") * float(level.numerator)) / float(level.denominator)
    target = F.when(capped(level), F.col("__cap").cast("double")).otherwise(open_target)
    return placed.select("source", "sid", "source_size", target.alias("target"))


def _fit(exact: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        total, target = int(rows["source_size"][0]), float(rows["target"][0])
        copies, budget = divmod(int(target), total) if total else (0, 0)
        lengths, counts = rows["size"].tolist(), rows["n"].tolist()
        from_ = 1 if lengths and lengths[0] == 0 else 0
        extra = [0] * from_ + fit_budget(lengths[from_:], counts[from_:], budget, exact)
        return pd.DataFrame({"sid": rows["sid"], "size": rows["size"], "n": rows["n"], "copies": copies, "extra": extra})

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 11, exact: int = 1 << 16) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` for every row of ``docs`` (``doc_id``, ``text``, ``source``).

    A size is a number of words, runs of anything but ASCII white space; null and empty texts
    have 0, and nothing is taken of them. Targets as in ``source_targets``; a source without
    words has target 0. ``taken`` is the size times the copies that the mix holds, ``most`` at most;
    a source's sum is not above its target, and falls short of it by less than a word plus what no subset of
    its lengths can fill. The choice depends on ``seed`` and ids alone: reruns agree, in any partitioning.
    Rows that repeat an id, size and source are taken alike, so they may leave a source short by one such set.
    Rows without an id are told apart by their texts. Other columns are ignored; no rows give none.

    A source's lengths meet in one task, as counts: k distinct lengths take k * k / 2 words
    at least. Its documents never do.
    """
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), 1)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))
    sized = written(sized.select("doc_id", "source", size.alias("size"), order.alias("order")), "sizes")
    targets = small_side(written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets"))
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    lengths = lengths.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    fitted = written(lengths.groupBy("sid").applyInPandas(_fit(exact), FIT_SCHEMA), "fitted")
    placed = sized.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")

    # of lengths that are taken in part: the hash of the last document taken
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BUCKET))).cast("int")
    partly = placed.select("sid", "size", "order").join(fitted.where("extra > 0 and extra < n"), ["sid", "size"])
    partly = partly.withColumn("bucket", F.call_function("shiftright", F.col("order"), F.lit(63) - bits))
    buckets = partly.groupBy("sid", "size", "bucket", "extra").agg(F.count("*").alias("here"))
    so_far = Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = buckets.withColumn("until", F.sum("here").over(so_far)).where("until >= extra and until - here < extra")
    edge = edge.select(F.col("sid").alias("__sid"), F.col("size").alias("__size"), F.col("bucket").alias("__bucket"), (F.col("extra") - F.col("until") + F.col("here")).alias("wanted"))
    inside = partly.join(edge, (F.col("sid") == F.col("__sid")) & (F.col("size") == F.col("__size")) & (F.col("bucket") == F.col("__bucket")))
    below = F.count("*").over(Window.partitionBy("sid", "size").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("below", below).groupBy("sid", "size").agg(F.max(F.when(F.col("below") <= F.col("wanted"), F.col("order"))).alias("last"), F.min("order").alias("least"))
    plan = fitted.join(inside.select("sid", "size", F.coalesce("last", F.col("least") - 1).alias("last")), ["sid", "size"], "left")
    plan = plan.select("sid", "size", "copies", F.when(F.col("extra") == 0, F.lit(-1)).when(F.col("extra") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("last")).alias("last"))
    out = placed.join(written(plan, "plan"), ["sid", "size"])
    taken = F.col("size") * (F.col("copies") + F.when(F.col("order") <= F.col("last"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
