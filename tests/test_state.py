"""The bounded list of a user whose toggles lie in many tasks, against the fold in order."""

import random

import pytest
from pyspark.sql import functions as F

from cordage.operators import state


def folded(rows, most=3):
    want = {}
    for u, _, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or "")):
        held = want.get(u, [])
        want[u] = [x for x in held if x != i] if i in held else [*held, i] if len(held) < most else held
    return want


def made(seed, kinds, n=6000, hot=0.8):
    pick = random.Random(seed)
    users = ["hot", *(f"u{n}" for n in range(40)), None]
    return [("hot" if pick.random() < hot else pick.choice(users), at, pick.choice([*(f"i{k}" for k in range(kinds)), None])) for at in range(n)]


@pytest.mark.parametrize("kinds, most, chunk", [(1, 3, 200), (4, 3, 700), (4, 3, 64), (2000, 3, 300), (3, 1, 50), (3, 0, 50), (5, 2, 400)])
def test_one_hot_user(spark, kinds, most, chunk):
    rows = made(kinds, kinds)
    df = spark.createDataFrame(rows, "user string, at long, item string").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        got = state.bounded_toggle(df, "user", "item", ["at"], most, chunk)
        assert {r.user: r["items"] for r in got.collect()} == folded(rows, most) and got.count() == len(folded(rows, most))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_hot_users_toggles_become_short_tables():
    chunk = [f"i{n * n % 5}" for n in range(4000)]
    items, table = state._summary(chunk, 3)
    assert len(items) == 3 and len(table) == state._n_lists(3, 3) == len(state._lists(3, 3)) < 100
    assert state._summary([f"i{n}" for n in range(4000)], 3) is None
    lists = state._lists(3, 3)
    for held in ([], ["x"], ["i1", "x", "y"], ["x", "y", "z"], ["i4", "i0"]):
        want = held
        for i in chunk:
            want = state._toggled(want, i, 3)
        assert state._after(held, items, table, lists, {t: n for n, t in enumerate(lists)}) == want


def test_users_of_other_types_and_no_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("user"), F.col("id").alias("at"), (F.col("id") * F.col("id") % 7).alias("item"))
    rows = [(str(r.user), r["at"], str(r["item"])) for r in df.collect()]
    got = state.bounded_toggle(df, "user", "item", ["at"])
    assert got.schema["user"].dataType.simpleString() == "int" and {str(r.user): r["items"] for r in got.collect()} == folded(rows)
    assert state.bounded_toggle(df.limit(0), "user", "item", ["at"]).count() == 0
