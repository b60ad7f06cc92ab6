"""Every registered query with SQL, against DuckDB on the smallest tables."""

import importlib
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
entry = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
        return x.isoformat() if hasattr(x, "isoformat") else repr(x)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, scans", [("data_quality", 1), ("vt_aggregate", 1), ("diagnose_registration", 2)])
def test_readings_are_read_once_for_several_figures(spark, name, scans):
    df = entry.queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert 1 <= plan.count("FileScan") <= scans
