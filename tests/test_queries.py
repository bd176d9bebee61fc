"""Every registered query of the record operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from cordage.plans import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.queries()))
def test_same_as_sql(spark, sf_dir, db, name):
    found = queries.queries()[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    key = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert key(found.collect()) == key(db.execute(f"select {columns} from ({queries.oracle_sql()[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["school_name", "scenario"] and set(e.oracle_sql()) <= set(e.queries())
