import pytest
from pyspark.sql import functions as F

from sensorlake.operators.access import (computation_sensitivity, definition_devices, highest_role_rank)
from sensorlake.plans.compute import EXAMPLES, check_dataset, check_definition, check_types, compute


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("a", 1, 10.0, {"t": 1.0}), ("a", 2, 20.0, {"t": 2.0}), ("b", 3, None, {})],
                                 "k string, n int, x double, m map<string,double>")


@pytest.mark.parametrize("bad", [
    {"having": []}, {"where": [{"col": "x"}]}, {"where": [{"col": "x", "op": ">"}]}, {"where": "x > 1"}, {"limit": 0},
    {"limit": 10001}, {"limit": "ten"}, {"orderBy": [{"dir": "asc"}]}, {"orderBy": [{"col": "x", "dir": "up"}]},
    {"groupBy": [1]}, "x"])
def test_malformed(bad):
    with pytest.raises(ValueError):
        check_definition(bad)


def test_examples_are_well_formed():
    for dataset, definition in EXAMPLES.values():
        check_dataset(dataset)
        check_definition(definition)


def test_unknown_columns_get_hints(df):
    with pytest.raises(ValueError, match="kk.*close.*'k'"):
        compute({"select": ["kk"]}, df)
    with pytest.raises(ValueError):
        compute({"where": [{"col": "x", "op": "LIKE", "value": "a"}]}, df)
    with pytest.raises(ValueError):
        compute({"select": ["k; drop table"]}, df)
    with pytest.raises(ValueError):
        compute({"select": ["k", "COUNT(*)"]}, df)


def test_default_names_and_limit(df):
    out = compute({"select": ["COUNT(*)", "avg(x)", "SUM(m.t)", "count(x) as seen"], "groupBy": ["k"]}, df)
    assert out.columns == ["reading_count", "avg_x", "sum_t", "seen"]
    assert compute({"limit": 1}, df).count() == 1
    assert compute({"groupBy": ["k"]}, df).columns == ["k", "reading_count"]


def test_text_numbers_and_nulls(df):
    assert compute({"where": [{"col": "x", "op": ">", "value": "15.0"}]}, df).count() == 1
    assert compute({"where": [{"col": "x", "op": ">", "value": "abc"}]}, df).count() == 0
    assert compute({"where": [{"col": "m.t", "op": "IS NULL"}]}, df).count() == 1
    assert compute({"where": [{"col": "k", "op": "!=", "value": "a"}], "select": ["n"]}, df).collect()[0].n == 3


def test_order_by_unselected_column(df):
    rows = compute({"select": ["k as name"], "orderBy": [{"col": "n", "dir": "desc"}], "limit": 2}, df).collect()
    assert [r.name for r in rows] == ["b", "a"]


def test_top_k_is_one_operator(df):
    plan = compute({"select": ["k", "n"], "orderBy": [{"col": "n"}], "limit": 2}, df)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_type_advice(df):
    problems = check_types({"where": [{"col": "k", "op": ">", "value": 1}, {"col": "x", "op": "==", "value": "1"},
                                      {"col": "x", "op": ">", "value": 1}]}, df.schema)
    assert len(problems) == 2


def test_devices_of_a_definition():
    definition = {"select": ["ingestion_id == 'd1' as x", "n"], "where": [{"col": "Sensor_ID", "op": "==", "value": ["d2", "d3", 4]},
                                                                          {"col": "x", "op": "==", "value": "no"}]}
    assert definition_devices(definition) == {"d1", "d2", "d3"}
    assert highest_role_rank([]) == 0 and highest_role_rank(["Viewer", "ADMIN"]) == 3


def test_sensitivity(spark):
    devices = spark.createDataFrame([("p", "public", True), ("r", "restricted", False), ("c", "confidential", True)],
                                    "ingestion_id string, sensitivity string, enabled boolean")
    where = '{{"where": [{{"col": "ingestion_id", "op": "==", "value": {}}}]}}'
    definitions = spark.createDataFrame([(1, "{}"), (2, where.format('["p", "r"]')), (3, where.format('"p"')), (4, where.format('"zz"'))],
                                        "id int, definition string")
    got = {r.id: r.sensitivity for r in computation_sensitivity(definitions, devices).collect()}
    assert got == {1: "confidential", 2: "restricted", 3: "public", 4: "public"}
