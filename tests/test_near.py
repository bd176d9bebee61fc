"""Rows near many points against every pair, and record folders with faulty files."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from cordage.operators import near
from cordage.sources import records


def km_by_force(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - lp) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h)))


@pytest.mark.parametrize("km", [0.5, 40, 700, 9000, 30000])
def test_within_each_is_every_pair(spark, km):
    rng = random.Random(km)
    place = lambda: (rng.choice([90.0, -90.0, 89.9, -89.99, 0.0, rng.uniform(-90, 90), rng.uniform(85, 90)]), rng.choice([180.0, -180.0, 179.9, -179.95, 0.0, rng.uniform(-180, 180), rng.uniform(180, 540)]))
    points = [(i, *place()) for i in range(250)]
    centres = [(i, *(points[rng.randrange(250)][1:] if rng.random() < 0.5 else place())) for i in range(60)]
    centres = [(i, max(-90.0, min(90.0, a + rng.uniform(-1, 1) * km / 111)), b + rng.uniform(-1, 1) * km / 111) for i, a, b in centres]
    table = spark.createDataFrame([*points, (900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, float("inf")), (903, 91.0, 1.0)], "p long, lat double, lng double")
    around = spark.createDataFrame([*centres, (900, None, 1.0), (901, 1.0, None)], "c long, at_lat double, at_lng double")
    found = near.within_each(table, around, km)
    want = {(p, c) for p, *x in points for c, *y in centres if km_by_force(x, y) <= km}
    got = [(r.p, r.c) for r in found.collect()]
    edge = {(p, c) for p, *x in points for c, *y in centres if abs(km_by_force(x, y) - km) < 1e-6}
    assert len(got) == len(set(got)) and set(got) ^ want <= edge
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_near_nothing(spark):
    none = spark.createDataFrame([], "p long, lat double, lng double")
    assert near.within_each(none, spark.createDataFrame([(1, 0.0, 0.0)], "c long, at_lat double, at_lng double"), 10).count() == 0


SEED = [(7, "seed")]


@pytest.mark.parametrize("bad", ['[{"id": 1, "na', "nonsense", '[{"id": "one", "name": "x"}]', '[{"id": 1, "name": "x"}, 5'])
@pytest.mark.parametrize("place", ["a.json", "m.json", "z.json"])
def test_a_faulty_file_anywhere(spark, tmp_path, bad, place):
    for name in ("b.json", "n.json", "y.json"):
        (tmp_path / name).write_text('[{"id": 1, "name": "%s"}, {"id": 2, "name": null}]' % name)
    (tmp_path / place).write_text(bad)
    seed = spark.createDataFrame(SEED, "id bigint, name string")
    for size in ("128m", "500b"):  # all files in one task, or a task for each
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert records.records_or_seed(spark, str(tmp_path), seed).collect() == seed.collect()
            kept = records.records_or_seed(spark, str(tmp_path), seed, keep_sound=True)
            assert sorted(r.name or "" for r in kept.collect()) == ["", "", "", "b.json", "n.json", "y.json"]
            assert [os.path.basename(r.file) for r in records.checked_records(spark, str(tmp_path), "id bigint, name string")[1].collect()] == [place]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_faulty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[")
    seed = spark.createDataFrame(SEED, "id bigint, name string").withColumn("more", F.lit(1.5))
    assert records.records_or_seed(spark, str(tmp_path), seed, keep_sound=True).collect() == seed.collect()
    assert records.records_or_seed(spark, str(tmp_path / "none"), seed).collect() == seed.collect()


def test_a_crowded_cell_is_many_tasks_work(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(i, 90.0 - rng.random(), rng.uniform(-180, 180)) for i in range(2000)], "p long, lat double, lng double")
    centres = spark.createDataFrame([(i, 90.0 - rng.random(), rng.uniform(-180, 180)) for i in range(300)], "c long, at_lat double, at_lng double")
    found = near.within_each(points, centres, 400, block=64)
    assert found.select("p", "c").distinct().count() == found.count() == 2000 * 300
    most = found.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    assert most < 0.6 * 2000 * 300


def test_antipodes_are_half_a_circle_apart(spark):
    rng = random.Random(6)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 0)) for i in range(500)]
    points = spark.createDataFrame(places, "p long, lat double, lng double")
    found = near.within_each(points, spark.createDataFrame([(i, -a, o + 180) for i, a, o in places], "c long, at_lat double, at_lng double"), 30000)
    assert found.where("p = c and abs(km - 20015.0868) < 0.01").count() == 500
