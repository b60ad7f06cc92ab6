import pytest
from pyspark.sql import functions as F

from sensorlake.functions import extract_field
from sensorlake.operators.wide import field_dictionary, field_object, field_path, field_value, object_entries, stored_object

UNION = "id long, ingestion_id string, sensor_data map<string,string>, normalized_data map<string,double>"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([
        (1, "a", {"temp": "5", "name": "x", "a.b c": "7", "empty": None}, {"temp": 5.5}),
        (2, "a", None, {"only": 2.0, "gone": None}),
        (3, "b", {}, None),
        (4, None, {"temp": "bad"}, {"temp": None}),
        (4, None, {"temp": "bad"}, {"temp": None}),
    ], UNION)


def texts(df):
    return sorted((r.id, r.text) for r in df.select("id", F.to_json("fields").alias("text")).collect())


def test_object_prefers_numbers_and_leaves_nulls_out(rows):
    assert texts(field_object(rows)) == [
        (1, '{"a.b c":"7","name":"x","temp":5.5}'), (2, '{"only":2.0}'), (3, "{}"), (4, '{"temp":"bad"}'), (4, '{"temp":"bad"}')]
    assert texts(field_object(rows, prefer_normalized=False))[:2] == [
        (1, '{"a.b c":"7","name":"x","temp":"5"}'), (2, '{"only":"2.0"}')]


def test_object_keeps_other_columns_and_replaces_its_own(rows):
    made = field_object(rows.withColumn("fields", F.lit("old")).withColumn("my.col", F.lit(1)))
    assert made.columns == ["id", "ingestion_id", "my.col", "fields"] and made.schema["fields"].dataType.typeName() == "variant"
    assert field_object(rows.limit(0)).count() == 0


def test_value_equals_the_extracted_column(rows):
    both = field_object(rows.withColumns({f"_{i}": extract_field(n) for i, n in enumerate(("temp", "name", "a.b c", "no"))}))
    for i, name in enumerate(("temp", "name", "a.b c", "no")):
        assert both.where(~field_value(name).eqNullSafe(F.col(f"_{i}"))).count() == 0
    assert field_path("it's") == '$["it\'s"]'
    with pytest.raises(ValueError):
        field_path("'\"")


def test_twenty_thousand_unknown_names(spark):
    key = F.concat(F.lit("k"), F.pmod(F.col("id"), F.lit(20_000)).cast("string"))
    wide = spark.range(60_000).select("id", F.create_map(key, F.lit("1")).alias("sensor_data"),
                                      F.create_map(key, F.lit(1.0)).alias("normalized_data"))
    found = field_dictionary(field_object(wide), F.col("id"))
    assert found.count() == 20_000
    assert found.where((F.col("uses") != 3) | (F.col("type") != "double") | (F.col("last_seen") - F.col("first_seen") != 40_000)).count() == 0


def test_objects_are_made_without_a_job_or_a_shuffle(spark, rows):
    plan = field_object(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stored_object_brings_mixed_fields_to_text(spark):
    mixed = spark.createDataFrame([(1, {"a": "1"}, {"a": 1.5, "b": 2.0}), (2, {"a": "on"}, None), (None, {"c": "x"}, None), (5, {}, None)],
                                  "id long, sensor_data map<string,string>, normalized_data map<string,double>")
    made = field_object(mixed)
    known = field_dictionary(made, F.col("id"))
    assert {r.field: r.type for r in known.collect()} == {"a": "string", "b": "double", "c": "string"}
    out = stored_object(made, known, ["id"])
    assert sorted((r.id or 0, r.t) for r in out.select("id", F.to_json("fields").alias("t")).collect()) == [
        (0, '{"c":"x"}'), (1, '{"a":"1.5","b":2.0}'), (2, '{"a":"on"}'), (5, "{}")]
    assert object_entries(out).columns == ["id", "field", "value"]


def test_stored_object_of_payloads(spark):
    rows = spark.createDataFrame([(1, '{"ok": true, "x": [1, 2], "n": null}'), (2, '{"ok": 0.5, "x": {"y": 1}}'), (3, '{"ok": false}'),
                                  (4, "no json"), (5, None)], "id long, value string")
    made = rows.select("id", F.try_parse_json("value").alias("fields"))
    out = stored_object(made, field_dictionary(made, F.col("id")), ["id"])
    assert [r.t for r in out.orderBy("id").select(F.to_json("fields").alias("t")).collect()] == [
        '{"n":null,"ok":1.0,"x":"[1,2]"}', '{"ok":0.5,"x":"{\\"y\\":1}"}', '{"ok":0.0}', None, None]
