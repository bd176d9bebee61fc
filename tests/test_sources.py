"""Record files, logs, versions and the batch that uses them."""

import json

import pytest
from pyspark.sql import functions as F

from cordage.plans import ingest
from cordage.sources import records
from cordage.sources.schema import RECORD
from cordage.sources.versions import VersionedTable


def test_read_records(spark, tmp_path):
    good = tmp_path / "r.json"
    good.write_text(json.dumps([{"school_name": "A", "tuition_by_grade": [{"grade_level": "K", "annual_thb": 5}], "extra": 1}], indent=2))
    row = records.read_records(spark, str(good)).first()
    assert row.school_name == "A" and row.tuition_by_grade[0].annual_thb == 5 and row.hidden_costs is None
    bad = tmp_path / "bad.json"
    bad.write_text("[{")
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        records.read_records(spark, str(bad)).collect()
    seed = spark.createDataFrame([], RECORD).unionByName(records.read_records(spark, str(good)).withColumn("school_name", F.lit("seed")))
    for path, want in ((good, "A"), (bad, "seed"), (tmp_path / "none.json", "seed")):
        assert records.records_or_seed(spark, str(path), seed).first().school_name == want


def test_log_and_dates(spark, tmp_path):
    steps = spark.createDataFrame([("A", "s", "a", "u", "r", 0.5, "ok")], "school_name string, step string, action_taken string, url_visited string, decision_reasoning string, confidence double, status string")
    for _ in range(2):
        records.append_log(steps, str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and rows[0].at is not None
    dated = records.with_default_date(spark.createDataFrame([("",), (None,), ("x",)], "lastUpdated string"))
    assert [r.lastUpdated for r in dated.collect()] == ["September 2026", "September 2026", "x"]


def test_versions_and_ingest(spark, tmp_path):
    table, kind = VersionedTable(spark, f"file://{tmp_path}/t"), RECORD + ", seq long"
    row = lambda name, curriculum, seq: (name, "", "ok", "", 1.0, curriculum, False, None, [], None, 0.5, "", None, None, seq)
    assert table.version() is None
    first = spark.createDataFrame([row("A", "IB", 1), row("B", "", 2), row("a", "British", 3)], kind)
    assert ingest.ingest(table, f"{tmp_path}/q", first, "school_name", "seq") == 1
    assert [(r.school_name, r.curriculum) for r in table.read().collect()] == [("a", "British")]
    assert [r.errors for r in ingest.quarantined(spark, f"{tmp_path}/q").collect()] == [["Curriculum information is missing."]]
    bad = spark.createDataFrame([row("D", "IB", 1), row("E", "", 2)], kind).withColumn("homepage_url", F.when(F.col("seq") == 1, F.raise_error(F.lit("no"))).otherwise(""))
    with pytest.raises(Exception, match="no"):
        ingest.ingest(table, f"{tmp_path}/q", bad, "school_name", "seq", f"{tmp_path}/log")
    commit, table.commit = table.commit, lambda rows: (_ for _ in ()).throw(OSError("disk"))
    once_more = spark.createDataFrame([row("D", "IB", 1), row("E", "", 2)], kind)
    for _ in range(2):  # a failed commit, twice: one batch in quarantine
        with pytest.raises(OSError):
            ingest.ingest(table, f"{tmp_path}/q", once_more, "school_name", "seq", f"{tmp_path}/log")
    table.commit = commit
    assert table.version() == 1 and sorted(r.school_name for r in ingest.quarantined(spark, f"{tmp_path}/q").collect()) == ["B", "E"]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").select("school_name", "step", "status").distinct().collect())[:3] == [("D", "compensate", "ok"), ("D", "save", "failed"), ("D", "validate", "ok")]
    ingest.ingest(table, f"{tmp_path}/q", spark.createDataFrame([row("A", "French", 1), row("C", "IB", 2)], kind), "school_name", "seq")
    assert sorted(r.school_name for r in table.read().collect()) == ["A", "C"]
    table.rollback(1)
    assert table.version() == 1 and table.read().count() == 1
    with pytest.raises(Exception):
        table.commit(table.read().withColumn("bad", F.raise_error(F.lit("no"))))
    assert table.version() == 1


def test_bounds_and_extraction(spark):
    made = spark.createDataFrame([("A", [("x", 5, None, None), ("y", 0, None, None), ("z", 3, None, None)]), ("B", [])], "school_name string, tuition_by_grade array<struct<grade_level:string,annual_thb:bigint,semester_thb:bigint,notes:string>>")
    assert [(r.tuition_min_thb, r.tuition_max_thb) for r in ingest.with_bounds(made).collect()] == [(3, 5), (None, None)]
    out = ingest.extracted(spark.createDataFrame([(1, "p")], "page_id long, html string"), lambda b: b.assign(n=b.html.str.len())[["page_id", "n"]], "page_id long, n long")
    assert out.first().n == 1


def test_record_files(spark, tmp_path):
    rows = spark.createDataFrame([("A", None, 1), ('B "x"\n', "y", 2), (None, "z", 3)], "a string, b string, c long").repartition(2)
    records.write_records(rows, str(tmp_path / "r"))
    back = records.read_records(spark, str(tmp_path / "r"), "a string, b string, c long")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    records.write_records(rows.limit(0), str(tmp_path / "none"))
    assert records.read_records(spark, str(tmp_path / "none"), "a string, b string, c long").count() == 0


def test_seed_schemas(spark):
    from cordage.sources import schema

    for ddl in (schema.SCHOOL, schema.DETAIL, schema.POST, schema.COORDINATE):
        assert spark.createDataFrame([], ddl).columns[0] == "id"


def test_a_large_partition_is_many_array_files(spark, tmp_path):
    rows = spark.range(60000).select(F.col("id").alias("c"), F.lit('€ "x"\n' * 30).alias("a")).coalesce(1)
    records.write_records(rows, str(tmp_path / "r"))
    arrays = [json.loads(f.read_text(encoding="utf-8")) for f in sorted((tmp_path / "r").glob("part-*"))]
    assert len(arrays) > 2 and sum(map(len, arrays)) == 60000 and max(map(len, arrays)) < 30000
    back = records.read_records(spark, str(tmp_path / "r"), "c bigint, a string")
    assert back.agg(F.count("*"), F.countDistinct("c"), F.sum(F.length("a"))).first()[:] == (60000, 60000, 60000 * 180)


def test_arrays_of_records_are_bounded():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"value": [json.dumps({"n": n, "s": "x" * n}) for n in part]}) for part in ([1, 2, 300], [4], [], [5, 6])]
    arrays = [json.loads(b.column(0)[0].as_py()) for b in records._as_arrays(iter(batches), 60)]
    assert [r["n"] for a in arrays for r in a] == [1, 2, 300, 4, 5, 6] and len(arrays) < 6
    assert [b.to_pydict() for b in records._as_arrays(iter([]))] == [{"value": ["[]"]}]


def test_records_of_a_batch_are_one_array():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"value": ['{"a": 1}'] * 1000})
    assert [len(json.loads(b.column(0)[0].as_py())) for b in records._as_arrays(iter([batch, batch]))] == [2000]
