import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import transform as vt


def union(spark, rows):
    return spark.createDataFrame(
        [(s, dt.datetime(2024, 1, 1), {k: str(x) for k, x in d.items()},
          {k: float(x) for k, x in d.items() if isinstance(x, (int, float))}) for s, d in rows],
        "ingestion_id string, timestamp timestamp, sensor_data map<string,string>, normalized_data map<string,double>")


def rule(field, kind, config, **more):
    return {"field_name": field, "transformation_type": kind, "config": config, **more}


def test_rule_order_and_json():
    rules = [rule("a", "filter", '{"operator": ">", "value": 1}', id=2), rule("a", "filter", "{bad", id=3),
             rule("a", "filter", {}, id=1), rule("a", "filter", {}, id=4, order_priority=1),
             rule("a", "filter", {}, id=5, enabled=False), rule("a", "filter", {}, id=6, ingestion_id="x")]
    assert [r["id"] for r in vt.order_rules(rules)] == [4, 1, 2, 6]
    assert [r["id"] for r in vt.order_rules(rules, "y")] == [4, 1, 2]


@pytest.mark.parametrize("kind, config", [
    ("filter", {"operator": ">"}), ("aggregate", {"function": "avg"}), ("convert", {"operation": "mathematical"}),
    ("convert", {"operation": "mathematical", "math_operation": "add"}), ("convert", {"operation": "x"}),
    ("convert", {"operation": "type_conversion"}), ("validate", {}), ("other", {})])
def test_bad_rules(kind, config):
    with pytest.raises(ValueError):
        vt.check_transformation(kind, config)


def test_good_rules():
    vt.check_transformation("filter", {"operator": ">", "value": 0})
    vt.check_transformation("convert", {"operation": "mathematical", "math_operation": "add", "operand_field": "b"})


def test_zero_operands_are_null(spark):
    df = spark.createDataFrame([(4.0, 0.0)], "a double, b double")
    got = df.select(*[vt.calculated(F.col("a"), {"math_operation": m}, F.col("b")) for m in ("divide", "modulo", "power")]).collect()[0]
    assert tuple(got) == (None, None, 1.0)


def test_booleans_and_formats(spark):
    df = spark.createDataFrame([(t,) for t in ("TRUE", "1", "yes", "On", "false", "0", "No", "off", "2")], "c string")
    got = [r[0] for r in df.select(vt.converted(F.col("c"), {"target_type": "boolean"})).collect()]
    assert got == [True] * 4 + [False] * 4 + [None]
    assert vt.spark_date_format("%Y-%m-%dT%H:%M:%S.%f") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    assert vt.spark_date_format("yyyy/MM/dd") == "yyyy/MM/dd"


def test_missing_fields(spark):
    df = union(spark, [("a", {"t": 5}), ("a", {"t": 50}), ("b", {"h": 1})])
    rules = [rule("t", "filter", {"operator": ">", "value": 10})]
    assert vt.apply_transformations(df, rules).count() == 1
    assert vt.apply_transformations(df, rules, on_missing="keep").count() == 2
    assert vt.apply_transformations(df, rules, on_missing="skip").count() == 1
    absent = [rule("nobody_has_it", "filter", {"operator": ">", "value": 10})]
    assert vt.apply_transformations(df, absent, on_missing="skip").count() == 3
    assert vt.apply_transformations(df, absent).count() == 0


def test_validation_flag_keeps_null(spark):
    df = union(spark, [("a", {"t": 5}), ("a", {"t": 500}), ("b", {"h": 1})])
    loose = vt.apply_transformations(df, [rule("t", "validate", {"validation_rules": [{"rule": "range", "params": {"max": 9}}]})])
    assert [r.t_valid for r in loose.collect()] == [True, False, None]
    strict = vt.apply_transformations(df, [rule("t", "validate", {"validation_rules": [
        {"rule": "range", "params": {"max": 9}}, {"rule": "not_null"}]})])
    assert [r.t_valid for r in strict.collect()] == [True, False, False]


def test_words_go_back_as_text(spark):
    df = union(spark, [("a", {"state": "on", "t": 1}), ("a", {"state": "odd", "t": 2})])
    out = vt.apply_transformations(df, [
        rule("state", "convert", {"operation": "type_conversion", "target_type": "boolean"}),
        rule("t", "convert", {"operation": "mathematical", "math_operation": "multiply", "operand_field": "t"})])
    rows = out.collect()
    assert [r.sensor_data["state"] for r in rows] == ["true", "odd"] and [r.normalized_data for r in rows] == [{"t": 1.0}, {"t": 4.0}]
    assert out.columns == df.columns


def test_source_rule_leaves_others(spark):
    df = union(spark, [("a", {"t": 1}), ("b", {"t": 1})])
    out = vt.apply_transformations(df, [rule("t", "convert", {"operation": "mathematical", "math_operation": "add", "operand": 1}, ingestion_id="b"),
                                        rule("t", "filter", {"operator": ">", "value": 5}, ingestion_id="a")])
    assert [(r.ingestion_id, r.normalized_data["t"]) for r in out.collect()] == [("b", 2.0)]


def test_unknown_names(spark):
    df = union(spark, [("a", {"t": 1})])
    for bad in (rule("t", "filter", {"operator": "~", "value": 1}), rule("t", "nonsense", {}),
                rule("t", "convert", {"operation": "type_conversion", "target_type": "x"})):
        with pytest.raises(ValueError):
            vt.apply_transformations(df, [bad])
