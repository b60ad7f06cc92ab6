import datetime as dt

from pyspark.sql import functions as F

from sensorlake.functions import (infer_type, merged_type, normalize_event_time, numeric_or_null, overlay,
                                  overlay_keys, parse_timestamp, path_source_id, sensor_id,
                                  stable_avg, stable_ingestion_id, topic_source_id, valid_reading)


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("c"))).collect()]


def test_numeric_text(spark):
    texts = ["-1.5", ".5", "1e3", "12", "+5", "5.", "NaN", " 5", "true", "", None]
    assert column(spark, texts, "string", numeric_or_null) == [-1.5, 0.5, 1000.0, 12.0] + [None] * 7


def test_time_shapes(spark):
    fallback = F.lit(dt.datetime(2000, 1, 1))
    texts = ["2024-01-02T03:04:05.678+00:00", "2024-01-02T03:04:05.678901", "2024-01-02T03:04:05+02:00",
             "2024-01-02T03:04:05", "2024-01-02 03:04:05.678901", "2024-01-02 03:04:05.678", "2024-01-02 03:04:05",
             "2024-01-02T03:04:05Z", "bad", None]
    base = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert column(spark, texts, "string", lambda c: parse_timestamp(c, fallback).cast("timestamp_ntz")) == [
        base.replace(microsecond=678000), base.replace(microsecond=678901), base - dt.timedelta(hours=2), base,
        base.replace(microsecond=678901), base.replace(microsecond=678000), base, base,
        dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1)]


def test_epoch_times(spark):
    fallback = F.lit(dt.datetime(2000, 1, 1))
    got = column(spark, ["1725212710", "1725212710.5", "1e999", "9" * 30, "2024-09-01T17:45:10Z", ""], "string",
                 lambda c: normalize_event_time(c, fallback).cast("timestamp_ntz"))
    at = dt.datetime(2024, 9, 1, 17, 45, 10)
    assert got == [at, at.replace(microsecond=500000), dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1), at,
                   dt.datetime(2000, 1, 1)]


def test_overlay(spark):
    df = spark.createDataFrame([({"temp": "1", "x": "2"}, {"x": "9", "y": "3"}), (None, {"a": "1"}), ({"a": "1"}, None)],
                               "base map<string,string>, over map<string,string>")
    got = [r[0] for r in df.select(overlay(F.col("base"), F.col("over"))).collect()]
    assert got == [{"temp": "1", "x": "9", "y": "3"}, {"a": "1"}, {"a": "1"}]
    keys = {"x": F.lit(None).cast("string"), "z": F.lit("7")}
    got = [r[0] for r in df.select(overlay_keys(F.col("base"), keys, "string")).collect()]
    assert got == [{"temp": "1", "z": "7"}, {"z": "7"}, {"a": "1", "z": "7"}]


def test_ids(spark):
    assert column(spark, ["a/b/#", "a/+/c", "/x"], "string", lambda c: topic_source_id(c, "x")) == [
        "x_a_b_wildcard", "x_a_plus_c", "x__x"]
    assert column(spark, ["/sensors/t1", "", "/"], "string", lambda c: path_source_id(c, "x")) == ["x_sensors_t1", "x", "x"]
    a, b = column(spark, ["My Feed", "My Feed"], "string", lambda c: stable_ingestion_id(c, F.lit("mqtt")))
    assert a == b and a[8:] == "_my_feed_mqtt"


def test_types(spark):
    texts = ["null", "true", "5", "5.5", '"x"', '"550e8400-E29B-41d4-a716-446655440000"', "[1]", '{"a": 1}']
    got = column(spark, texts, "string", lambda c: infer_type(F.try_parse_json(c)))
    assert got == ["null", "boolean", "double", "double", "string", "uuid", "array", "object"]
    rows = [("a", "double", 1), ("a", "string", 2), ("b", "uuid", 1), ("b", "string", 2), ("c", "null", 1), ("c", "double", 2),
            ("d", "string", 1), ("d", "uuid", 2)]
    df = spark.createDataFrame(rows, "k string, t string, at int").groupBy("k").agg(merged_type(F.col("t"), F.col("at")).alias("t"))
    assert {r.k: r.t for r in df.collect()} == {"a": "string", "b": "uuid", "c": "double", "d": "string"}


def test_mean_of_huge_values(spark):
    df = spark.createDataFrame([(1, 1e20), (1, 3e20), (2, 0.125), (2, 0.125)], "k int, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(stable_avg(F.col("v")).alias("m")).collect()}
    assert got == {1: 2e20, 2: 0.13}
    df = spark.createDataFrame([(1, 1.00005), (1, 1.00004), (2, 4.9e-5), (2, 4.9e-5), (2, 4.9e-5)], "k int, v double")
    got = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(stable_avg(F.col("v"), 4).alias("a"), stable_avg(F.col("v"), 6).alias("b")).collect()}
    assert got == {1: (1.0, 1.000045), 2: (0.0, 0.000049)}


def test_sensor_id_and_validity(spark):
    df = spark.createDataFrame([({"sensorid": "a", "sensor_id": "b"}, "s"), ({"x": "1"}, "s")],
                               "sensor_data map<string,string>, ingestion_id string")
    assert [tuple(r) for r in df.select(sensor_id(), sensor_id(fallback=False)).collect()] == [("a", "a"), ("s", "unknown")]
    assert column(spark, [1.0, float("nan"), None], "double", valid_reading) == [True, False, False]
