"""Tables that merge on read, and batches that end in one of two states wherever they fail."""

import os

import pytest
from pyspark.sql import functions as F

from cordage.plans import ingest as plan
from cordage.sources.batches import BatchStates
from cordage.sources.merge_on_read import MergeTable
from cordage.sources.versions import VersionedTable

SCHEMA = "name string, v bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_merge_table_follows_a_plain_one(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", "name", SCHEMA, buckets=4)
    with pytest.raises(FileNotFoundError):
        table.read()
    with pytest.raises(FileNotFoundError):
        table.upsert(spark.createDataFrame([], SCHEMA + ", seq int"), "seq")
    of = lambda *r: spark.createDataFrame(list(r), SCHEMA + ", seq int")
    first = table.commit(spark.createDataFrame([("a", 1), ("B", 2), ("c", 3), (None, 4), (None, 4)], SCHEMA))
    assert rows(table.read()) == rows(spark.createDataFrame([("a", 1), ("B", 2), ("c", 3), (None, 4), (None, 4)], SCHEMA))
    second = table.upsert(of(("A", 5, 1), ("a", 6, 2), ("d", None, 1), (None, 7, 1), (None, 7, 1)), "seq")
    state = [(None, 4), (None, 4), (None, 7), (None, 7), ("a", 6), ("B", 2), ("c", 3), ("d", None)]
    assert rows(table.read()) == sorted(state, key=str)
    table.remove(spark.createDataFrame([("C",), (None,), ("nobody",), ("D",)], "name string"))
    assert rows(table.read()) == sorted([r for r in state if r[0] not in ("c", "d")], key=str)
    third = table.compact()
    assert rows(table.read()) == sorted([r for r in state if r[0] not in ("c", "d")], key=str)
    assert table.compact() == third  # nothing left to fold
    table.upsert(of(("c", 8, 1)), "seq")
    table.upsert(of(), "seq")
    assert rows(table.read()) == sorted([r for r in state if r[0] not in ("c", "d")] + [("c", 8)], key=str)
    assert rows(table.read(second)) == sorted(state, key=str)
    table.rollback(second)
    table.upsert(of(("e", 9, 1)), "seq")  # builds on what was rolled back to
    assert rows(table.read()) == sorted([*state, ("e", 9)], key=str)
    table.rollback(first)
    assert table.read().count() == 5
    everything = MergeTable(spark, f"file://{tmp_path}/t", "name", SCHEMA, buckets=4)
    everything.remove(everything.read().select("name"))
    everything.compact()
    assert rows(everything.read()) == [(None, 4), (None, 4)]


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    table = MergeTable(spark, f"file://{tmp_path}/t", "name", SCHEMA, buckets=32)
    base = spark.range(200_000).select(F.concat(F.lit("row "), F.col("id")).alias("name"), F.xxhash64("id").alias("v"))
    table.commit(base)
    whole = size(tmp_path)
    table.upsert(base.where("name like '%0000'").withColumn("seq", F.lit(1)), "seq")  # 20 rows
    assert size(tmp_path) - whole < whole / 50
    before = size(tmp_path)
    table.upsert(base.where("name = 'row 7'").withColumns({"v": F.lit(0).cast("bigint"), "seq": F.lit(1)}), "seq")
    touched = table._merged(table.version())[1]
    table.compact()
    assert size(tmp_path) - before < whole * (len(touched) + 1) / 32  # buckets that nothing touches are not written again
    assert table.read().count() == 200_000 and table.read().where("v = 0").count() == 1
    scans = table.read().inputFiles()
    assert len(scans) == len(set(scans))


RECORDS = """name string, seq bigint, curriculum string, tuition_found boolean, tuition_by_grade array<struct<grade_level:string,annual_thb:bigint,semester_thb:bigint,notes:string>>,
tuition_min_thb bigint, tuition_max_thb bigint, hidden_costs array<struct<name:string,amount_thb:bigint,notes:string>>, confidence string"""


def batch_of(spark, *items):
    return spark.createDataFrame([(n, s, c, False, None, None, None, None, None) for n, s, c in items], RECORDS)


class Crash(BaseException):
    """Nothing in the library catches it."""


@pytest.fixture(params=["versions", "merge"])
def table_of(request, spark):
    def make(path):
        return VersionedTable(spark, path) if request.param == "versions" else MergeTable(spark, path, "name", batch_of(spark).drop("seq").schema, buckets=2)

    return make


def outcome(spark, table, where):
    names = sorted(r.name for r in table.read().collect())
    failed = sorted(r.name for r in plan.quarantined(spark, f"{where}/q").collect()) if os.path.exists(f"{where}/q") and any(n.startswith("batch=") for n in os.listdir(f"{where}/q")) else []
    log = sorted((r.batch, r.school_name, r.step) for r in spark.read.parquet(f"{where}/log").select(F.col("batch").cast("string"), "school_name", "step").collect()) if os.path.exists(f"{where}/log") else []
    return names, failed, log


def crash_points():
    return [("mark", n, after) for n in range(1, 6) for after in (False, True)] + [("_point", 1, False), ("_point", 1, True), ("commit", 1, False), ("commit", 1, True), ("log", 1, False), ("log", 1, True)]


@pytest.mark.parametrize("where, nth, after", crash_points())
def test_a_batch_ends_in_one_of_two_states(spark, table_of, tmp_path, monkeypatch, where, nth, after):
    path = f"file://{tmp_path}"
    table, args = table_of(f"{path}/t"), (f"{path}/q",)
    run = lambda records, batch: plan.ingest(table, *args, records, "name", "seq", f"{path}/log", batch=batch)
    run(batch_of(spark, ("one", 1, "IB"), ("bad", 2, None)), "first")
    first = outcome(spark, table, tmp_path)
    assert first == (["one"], ["bad"], [("first", "bad", "validate"), ("first", "one", "save"), ("first", "one", "validate")])
    calls = {"n": 0}

    def crashing(f):
        def g(*a, **b):
            calls["n"] += 1
            if calls["n"] == nth and not after:
                raise Crash
            out = f(*a, **b)
            if calls["n"] == nth:
                raise Crash
            return out

        return g

    kind = type(table)
    with monkeypatch.context() as m:
        if where == "mark":
            m.setattr(BatchStates, "mark", crashing(BatchStates.mark))
        elif where == "log":
            m.setattr(plan, "_write_log", crashing(plan._write_log))
        else:
            name = "upsert" if where == "commit" and kind is MergeTable else where
            m.setattr(kind, name, crashing(getattr(kind, name)))
        with pytest.raises(Crash):
            run(batch_of(spark, ("two", 1, "IB"), ("worse", 2, None), ("one", 3, "US")), "second")
    table = table_of(f"{path}/t")  # as another process finds it
    ends = plan.recover(table, *args, "name", f"{path}/log")
    assert plan.recover(table, *args, "name", f"{path}/log") == {}
    names, failed, log = outcome(spark, table, tmp_path)
    of_second = [(s, step) for b, s, step in log if b == "second"]
    moved = names == ["one", "two"]
    assert moved or names == ["one"]
    if ends:
        assert ends == {"second": "done" if moved else "undone"}
    if moved:
        assert of_second == sorted([("one", "save"), ("one", "validate"), ("two", "save"), ("two", "validate"), ("worse", "validate")])
    elif of_second:
        assert ("one", "compensate") in of_second and len(of_second) == 7
    assert [x for x in log if x[0] == "first"] == first[2]
    run(batch_of(spark, ("two", 1, "IB"), ("worse", 2, None), ("one", 3, "US")), "second")
    names, failed, log = outcome(spark, table, tmp_path)
    assert names == ["one", "two"] and failed == ["bad", "worse"] and len(log) == 3 + 5


def test_a_log_that_fails_after_the_table_has_moved(spark, tmp_path, monkeypatch):
    table, path = VersionedTable(spark, f"file://{tmp_path}/t"), f"file://{tmp_path}"
    with monkeypatch.context() as m:
        m.setattr(plan, "stamped_log", lambda rows: (_ for _ in ()).throw(OSError("disk")))
        with pytest.warns(UserWarning, match="recover"):
            version = plan.ingest(table, f"{path}/q", batch_of(spark, ("one", 1, "IB")), "name", "seq", f"{path}/log", batch="b")
    assert table.version() == version and plan.recover(table, f"{path}/q", "name", f"{path}/log") == {"b": "done"}
    assert spark.read.parquet(f"{path}/log").count() == 2


def test_quarantine_outlives_a_rollback(spark, tmp_path):
    table, path = VersionedTable(spark, f"file://{tmp_path}/t"), f"file://{tmp_path}"
    run = lambda *items: plan.ingest(table, f"{path}/q", batch_of(spark, *items), "name", "seq")
    first = run(("one", 1, "IB"))
    run(("bad", 1, None), ("two", 2, "IB"))
    table.rollback(first)
    run(("worse", 1, None), ("three", 2, "IB"))
    assert sorted(r.name for r in plan.quarantined(spark, f"{path}/q").collect()) == ["bad", "worse"]
    assert sorted(r.name for r in table.read().collect()) == ["one", "three"]
