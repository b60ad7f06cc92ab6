import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sensorlake.operators.devices import diagnose_registration, registered_only
from sensorlake.operators.normalize import (from_union, lower_columns, merge_sensor_data, normalize_columns,
                                            normalize_union, resolve_rules, rules_frame, to_union, to_union_fixed)
from sensorlake.schema import UNION, check_stream_schema, is_union


def maps(df):
    return [(r.sensor_data, r.normalized_data) for r in df.orderBy("ingestion_id").collect()]


def test_lower_columns_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "SensorId int, SENSORID int, b int")
    assert lower_columns(df).collect()[0].asDict() == {"sensorid": 1, "b": 3}


def test_normalize_columns_coalesces(spark):
    df = spark.createDataFrame([(None, 5.0, "x")], "Temp double, temperature double, other string")
    out = normalize_columns(df, {"temp": "temperature"})
    assert out.columns == ["temperature", "other"] and out.collect()[0].temperature == 5.0


def test_union_drops_nulls_and_needs_no_id(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "5", None, True)], "timestamp string, a string, b double, c boolean")
    row = to_union(df).collect()[0]
    assert row.ingestion_id == "unknown" and row.sensor_data == {"a": "5", "c": "true"} and row.normalized_data == {"a": 5.0}
    assert is_union(to_union(df)) and not is_union(df)


def test_coalesce_order_is_asymmetric(spark):
    df = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), {"temp": "7"}, {"temperature": 9.0})], UNION)
    text, numbers = maps(normalize_union(df, {"temp": "temperature"}))[0]
    assert text == {"temp": "7", "temperature": "7"} and numbers == {"temperature": 9.0}


RULES = [{"raw_key": "A", "canonical_key": "x"}, {"raw_key": "b", "canonical_key": "x"},
         {"raw_key": "a", "canonical_key": "y", "ingestion_id": "s1"}, {"raw_key": "c", "canonical_key": "b", "ingestion_id": "s2"},
         {"raw_key": "c", "canonical_key": "off", "enabled": False}, {"raw_key": "a", "canonical_key": "late"}]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(s, "2024-01-01 00:00:00", a, b, c) for s in ("s1", "s2", "s3")
            for a, b, c in (("1", "2", "3"), (None, "+2", None), ("x", None, "4"))]
    return spark.createDataFrame(rows, "ingestion_id string, timestamp string, a string, b string, c string")


def rows_of(df):
    return sorted((r.ingestion_id, sorted(r.sensor_data.items()), sorted(r.normalized_data.items())) for r in df.collect())


def test_three_ways_to_apply_rules_agree(spark, wide):
    rules = rules_frame(spark, RULES)
    union = to_union(wide)
    inline = rows_of(normalize_union(union, rules))
    assert inline == rows_of(normalize_union(union, rules, max_inline=0))
    assert inline == rows_of(to_union(wide, rules=rules))
    first = next(r for r in inline if r[0] == "s1")
    assert dict(first[1]).get("y") == "1" and dict(first[1]).get("x") == "2"


def test_normalizing_twice_changes_nothing(spark, wide):
    once = normalize_union(to_union(wide), rules_frame(spark, RULES[:2]))
    assert rows_of(normalize_union(once, rules_frame(spark, RULES[:2]))) == rows_of(once)


def test_own_rule_beats_global(spark):
    fields = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s1", "zzz")], "ingestion_id string, raw_key string")
    got = {(r.ingestion_id, r.raw_key): r.canonical_key for r in resolve_rules(rules_frame(spark, RULES), fields).collect()}
    assert got == {("s1", "a"): "y", ("s2", "a"): "x"}


numbers = st.floats(allow_nan=False, allow_infinity=False, min_value=-1e6, max_value=1e6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=5))
def test_round_trip_keeps_numbers(spark, values):
    df = spark.createDataFrame([("s", "2024-01-01", a, b) for a, b in values], "ingestion_id string, timestamp string, a double, b double")
    back = from_union(to_union(df)).select("a", "b").collect()
    assert sorted((r.a, r.b) for r in back) == sorted(values)


def test_merge_and_fixed(spark, wide):
    merged = merge_sensor_data(to_union(wide), {"a": 0, "site": "north"}).collect()
    assert all(r.sensor_data["a"] == "0" and r.sensor_data["site"] == "north" for r in merged)
    assert all("a" not in r.normalized_data or r.normalized_data["a"] == 1.0 for r in to_union_fixed(wide).collect())


DEVICES = "ingestion_id string, enabled boolean"


def test_registration(spark):
    df = spark.createDataFrame([("src_click",), (" SRC_CLICK",), ("src_view",), ("unknown",), ("",)], "ingestion_id string")
    def kept(rows):
        return registered_only(df, spark.createDataFrame(rows, DEVICES)).count()
    assert kept([(" SRC_Click ", True)]) == 2
    assert kept([("unknown", True), ("", True), (" ", True)]) == 0
    assert kept([]) == 0
    assert kept([("src_view", False)]) == 0
    assert kept([(None, True), ("x", True)]) == 5
    assert kept([(None, False)]) == 0


def test_diagnosis(spark):
    union = spark.createDataFrame([("a", {"sensor_id": "1"}), ("a", {"sensor_id": "2"}), ("b", {})],
                                  "ingestion_id string, sensor_data map<string,string>")
    found = {(r.issue, r.ingestion_id, r.n) for r in diagnose_registration(
        union, spark.createDataFrame([("a", True), ("c", True)], DEVICES)).collect()}
    assert found == {("unregistered", "b", 1), ("unseen", "c", 0), ("several_sensors", "a", 2)}


def test_stream_schema():
    check_stream_schema(UNION)
    with pytest.raises(ValueError):
        check_stream_schema(T.StructType([UNION["timestamp"], UNION["sensor_data"]]))
    with pytest.raises(ValueError):
        check_stream_schema(T.StructType([UNION["ingestion_id"]]))
