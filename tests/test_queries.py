import os

import duckdb
import pytest

from loomline.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    if name not in ORACLE:
        assert rows
        return
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    assert rows == sorted(str(tuple(r)) for r in want.project(", ".join(columns)).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, scans", [("report_with_total", 1), ("xml_page_lines", 1), ("written_contents", 1), ("grand_total", 1)])
def test_tables_are_read_once(spark, name, scans):
    """No query lexes its input twice."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == scans
