"""Inputs at the edge: late samples, text operands, windows without grouping, dirty times, narrow floats."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import normalize as nz
from sensorlake.operators import transform as vt
from sensorlake.operators.profile import field_profile
from sensorlake.plans.compute import compute
from sensorlake.sources import layers as ly


def test_samples_come_from_all_readings(spark):
    rows = [("s", "t", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), json.dumps({"x": max(0, i - 60)})) for i in range(100)]
    df = spark.createDataFrame(rows, "ingestion_id string, topic string, ts timestamp, value string")
    got = field_profile(df).collect()
    assert [(r.uses, r.samples) for r in got] == [(100, ["0", "1", "2", "3", "4"])]


@pytest.mark.parametrize("operator, operand, kept", [
    ("==", "on", [1]), ("!=", "on", [2, 3]), ("==", "20", [3]), (">", "5", [2, 3]), ("==", 7, [2]), ("==", "7.0", [2])])
def test_text_operands(spark, operator, operand, kept):
    rows = [(i, "s", {"state": t}, {"state": n} if n else {}) for i, t, n in ((1, "on", None), (2, "7", 7.0), (3, "20", 20.0))]
    df = spark.createDataFrame(rows, "id int, ingestion_id string, sensor_data map<string,string>, normalized_data map<string,double>")
    if operator == ">":
        df = df.where("id > 1")
    rule = {"id": 1, "field_name": "state", "transformation_type": "filter", "config": {"operator": operator, "value": operand}}
    assert sorted(r.id for r in vt.apply_transformations(df, [rule]).collect()) == kept


def test_window_and_namesakes_with_unselected_order(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 30), {"x": "1"}, {"x": 2.0}, 1), (dt.datetime(2024, 1, 1, 0, 1, 5), {"x": "3"}, {"x": 4.0}, 0)],
                               "ts timestamp, a map<string,string>, b map<string,double>, n int")
    out = compute({"select": ["window(ts, '1 minute').start as w", "a.x", "b.x"], "orderBy": [{"col": "n"}]}, df)
    assert out.columns == ["w", "x", "x"]
    assert [tuple(r) for r in out.collect()] == [(dt.datetime(2024, 1, 1, 0, 1), "3", 4.0), (dt.datetime(2024, 1, 1), "1", 2.0)]


def test_no_limit_of_its_own(spark):
    assert compute({"select": ["id"]}, spark.range(250)).count() == 250


def test_retention_of_dirty_times(spark):
    df = spark.createDataFrame([("bad",), ("1725212710",), ("2024-09-01T10:00:00Z",), ("2024-01-01",), (None,)], "timestamp string") \
        .withColumn("ingestion_id", F.lit("s"))
    as_of = F.lit("2024-09-03").cast("timestamp")
    assert sorted(str(r.timestamp) for r in ly.apply_retention(df, "bronze", as_of).collect()) == \
        ["1725212710", "2024-09-01T10:00:00Z", "None", "bad"]
    assert [str(r.date) for r in ly.expired_partitions(df, "bronze", as_of, "timestamp").collect()] == ["2024-01-01"]


def test_renamed_numbers_do_not_depend_on_the_plan(spark):
    df = spark.sql("select 's' ingestion_id, cast(0.1 as float) f, cast(1.50 as decimal(9,2)) d, binary('12') b, '7' t, 3 i, timestamp'2024-01-01' timestamp")
    rules = {"f": "float_", "d": "dec", "b": "bin", "t": "text", "i": "int_"}
    table = spark.createDataFrame([(i, None, raw, name, True, 0, None) for i, (raw, name) in enumerate(rules.items())], nz.RULE_SCHEMA)
    plain = nz.to_union(df)
    got = [nz.to_union(df, rules=table), nz.normalize_union(plain, table), nz.normalize_union(plain, table, max_inline=0)]
    numbers = [{k: x for k, x in r.first().normalized_data.items() if k in rules.values()} for r in got]
    assert numbers[0] == numbers[1] == numbers[2]
    assert numbers[0]["float_"] == 0.1
