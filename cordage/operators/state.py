"""Toggles: membership by parity, and a bounded list that depends on their order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def toggled_on(toggles: DataFrame, keys: list[str]) -> DataFrame:
    """Keys toggled an odd number of times, with that number. Counts are made before the shuffle."""
    return toggles.groupBy(*keys).agg(F.count("*").alias("n_toggles")).where("n_toggles % 2 = 1")


def displayed_likes(likes: Column, liked: Column) -> Column:
    """Likes with one's own."""
    return F.coalesce(likes, F.lit(0)) + F.when(F.coalesce(liked, F.lit(False)), 1).otherwise(0)


def liked_posts(posts: DataFrame, toggles: DataFrame, key: str = "id", comment: str = "comment_id") -> DataFrame:
    """``posts`` with ``liked`` and ``likes`` as shown after all ``toggles``, of the posts and of their comments.

    ``posts`` has ``key``, ``likes``, ``liked`` and ``comments``
    (``array<struct<id, likes, liked>>``); ``toggles`` has ``key`` and
    ``comment``, which is null for the post itself. The order of toggles does
    not count, so they reduce to the odd ones before they meet their post. Null
    likes are 0 and a null ``liked`` is false. Toggles of unknown posts or
    comments do nothing. A null key is toggled by nothing.
    """
    odd = toggled_on(toggles.where(F.col(key).isNotNull()), [key, comment])
    flips = odd.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(comment).isNull()).alias("__own"), F.collect_set(comment).alias("__of"))
    now = lambda liked, flip: F.coalesce(liked, F.lit(False)) != F.coalesce(flip, F.lit(False))

    def shown(c: Column) -> Column:
        liked = now(c["liked"], F.array_contains("__of", c["id"]))
        return c.withField("likes", displayed_likes(c["likes"], liked)).withField("liked", liked)

    joined = posts.join(flips, F.col(key) == F.col("__key"), "left").withColumn("liked", now(F.col("liked"), F.col("__own")))
    return joined.withColumns({"likes": displayed_likes(F.col("likes"), F.col("liked")), "comments": F.transform("comments", shown)}).drop("__key", "__own", "__of")


def _toggled(held: list, item: str | None, most: int) -> list:
    if item in held:
        return [x for x in held if x != item]
    return [*held, item] if len(held) < most else held


def _n_lists(kinds: int, most: int) -> int:
    """How many lists of at most ``most`` places there are of ``kinds`` items, each once at most, and of places held by other items."""
    return sum(math.comb(n, k) * math.perm(kinds, k) for n in range(most + 1) for k in range(min(n, kinds) + 1))


def _lists(kinds: int, most: int) -> list[tuple[int, ...]]:
    """These lists: numbers of items, and -1 for a place that another item holds."""
    out, last = [()], [()]
    for _ in range(most):
        last = [(*t, x) for t in last for x in range(-1, kinds) if x < 0 or x not in t]
        out += last
    return out


def _summary(chunk: list, most: int) -> tuple[list, list[int]] | None:
    """Items of a chunk and what it makes of every list; None if that is not far shorter than the chunk.

    Of a list that is held before it, the chunk can only tell its own items apart: others stay where they are.
    """
    items = list(dict.fromkeys(chunk))
    if 4 * _n_lists(len(items), most) > len(chunk):
        return None
    lists = _lists(len(items), most)
    number = {t: n for n, t in enumerate(lists)}
    steps = np.array([[number[tuple(_toggled(list(t), x, most))] for t in lists] for x in range(len(items))])
    code, now = {x: n for n, x in enumerate(items)}, np.arange(len(lists))
    for x in chunk:
        now = steps[code[x]][now]
    return items, now.tolist()


def _after(held: list, items: list, table: list[int], lists: list[tuple[int, ...]], number: dict) -> list:
    code = {x: n for n, x in enumerate(items)}
    others = iter([x for x in held if x not in code])
    return [items[x] if x >= 0 else next(others) for x in lists[table[number[tuple(code.get(x, -1) for x in held)]]]]


def bounded_toggle(toggles: DataFrame, user: str, item: str, order: list[str], most: int = 3, chunk: int = 16_384) -> DataFrame:
    """``user`` and ``items``: what each user's list holds after all toggles in order.

    A toggle removes an item that the list holds, adds one at its end while it
    is shorter than ``most``, and else does nothing. A null item is an item, in
    text form as all are; a null user is a user. No rows give none.

    Rows lie in ranges of user and order, so a user of many toggles takes many
    tasks. A user who begins in a range is folded there, streamed. Of one who
    goes on from the range before, the list held is unknown: each ``chunk`` of
    its toggles becomes a table of what it makes of every list, in which only
    the chunk's own items are told apart. Lists and tables of such users then
    meet by user, in order. A chunk of so many different items that its table is
    not at most a quarter of its length passes on as it is: what such toggles do
    depends on all before them, so these are folded in sequence, in bounded
    memory.
    """
    kind = toggles.schema[user].dataType.simpleString()
    places = [f"o{n}" for n in range(len(order))]
    rows = toggles.select(F.col(user).alias("u"), F.col(item).cast("string").alias("i"), *(F.col(o).alias(p) for o, p in zip(order, places)))
    ranged = rows.repartitionByRange("u", *places, "i").sortWithinPartitions("u", *places, "i").select("u", "i")
    strings, numbers = pa.list_(pa.string()), pa.list_(pa.int32())

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun, going_on, now, held, waiting, n = TaskContext.get().partitionId(), False, True, None, [], [], 0
        out: list[tuple] = []

        def passed() -> None:
            made = _summary(waiting, most)
            out.append((now, part, n, None, *((None, *made) if made else (waiting, None, None))))

        for batch in batches:
            kind_u = batch.schema.field("u").type
            for u, i in zip(batch.column("u").to_pylist(), batch.column("i").to_pylist()):
                if begun and u != now:
                    if not going_on:
                        out.append((now, part, 0, held, None, None, None))
                    elif waiting:
                        passed()
                    going_on, held, waiting = False, [], []
                begun, now = True, u
                if not going_on:
                    held = _toggled(held, i, most)
                    continue
                waiting.append(i)
                if len(waiting) == chunk:
                    passed()
                    waiting, n = [], n + 1
            if out:
                yield _batch(out, [kind_u, pa.int32(), pa.int32(), strings, strings, strings, numbers])
                out = []
        if begun and (waiting or not going_on):
            if going_on:
                passed()
            else:
                out.append((now, part, 0, held, None, None, None))
            yield _batch(out, [kind_u, pa.int32(), pa.int32(), strings, strings, strings, numbers])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, held, known = False, None, [], {}
        for batch in batches:
            kind_u, done = batch.schema.field("u").type, []
            for at in range(batch.num_rows):  # a row is a user's list, or a chunk
                u, lists, raw, items, table = (batch.column(c)[at].as_py() for c in ("u", "held", "raw", "items", "made"))
                if begun and u != now:
                    done.append((now, held))
                    held = []
                begun, now = True, u
                if lists is not None:
                    held = lists
                elif raw is not None:
                    for i in raw:
                        held = _toggled(held, i, most)
                else:
                    if len(items) not in known:
                        all_lists = _lists(len(items), most)
                        known[len(items)] = all_lists, {t: n for n, t in enumerate(all_lists)}
                    held = _after(held, items, table, *known[len(items)])
            if done:
                yield _batch(done, [kind_u, strings], ["u", "items"])
        if begun:
            yield _batch([(now, held)], [kind_u, strings], ["u", "items"])

    chunks = ranged.mapInArrow(ranges, f"u {kind}, part int, n int, held array<string>, raw array<string>, items array<string>, made array<int>")
    settled = chunks.repartition("u").sortWithinPartitions("u", "part", "n").mapInArrow(joined, f"u {kind}, items array<string>")
    return settled.withColumnRenamed("u", user)


def _batch(rows: list[tuple], types: list[pa.DataType], names: tuple[str, ...] | list[str] = ("u", "part", "n", "held", "raw", "items", "made")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))
