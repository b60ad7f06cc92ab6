"""Value rules, alone and as a chain."""

from pyspark.sql import functions as F

from ..functions import extract_field
from ..operators import transform as vt
from . import views as v
from .normalization import _DIRTY, dirty, timestamp_texts
from .registry import query


def _rule(field, kind, config, **more):
    return {"field_name": field, "transformation_type": kind, "config": config, **more}


_CHAIN = [
    _rule("temperature", "convert", {"operation": "mathematical", "math_operation": "multiply", "operand": 1.8}, id=1, order_priority=10),
    _rule("temperature", "convert", {"operation": "mathematical", "math_operation": "add", "operand": 32}, id=2, order_priority=20),
    _rule("temperature", "validate", {"validation_rules": [{"rule": "range", "params": {"min": 0, "max": 200}}], "on_fail": "drop"}, id=3, order_priority=30),
    _rule("temperature", "convert", '{"operation": "mathematical", "math_operation": "subtract", "operand": 1}', id=4, order_priority=40, enabled=False),
]


def _temperature(df):
    return df.select("event_id", "ingestion_id", F.col("normalized_data")["temperature"].alias("temperature"),
                     F.col("sensor_data")["temperature"].alias("raw"))


@query("transform_chain", f"""WITH {v.ENRICHED} SELECT event_id, ingestion_id, temperature * 1.8e0 + 32 AS temperature,
  CAST(temperature AS VARCHAR) AS raw FROM en WHERE temperature * 1.8e0 + 32 BETWEEN 0 AND 200""")
def _(spark, sf):
    return _temperature(vt.apply_transformations(v.enriched(spark, sf), _CHAIN))


@query("transform_chain_keep", f"""WITH {v.ENRICHED} SELECT event_id, ingestion_id, temperature * 1.8e0 + 32 AS temperature,
  CAST(temperature AS VARCHAR) AS raw FROM en WHERE temperature IS NULL OR temperature * 1.8e0 + 32 BETWEEN 0 AND 200""")
def _(spark, sf):
    return _temperature(vt.apply_transformations(v.enriched(spark, sf), _CHAIN, on_missing="keep"))


@query("vt_source_rule", f"""WITH {v.ENRICHED} SELECT event_id, ingestion_id,
  CASE WHEN ingestion_id = 'src_view' THEN humidity / 100 ELSE humidity END AS humidity FROM en
  WHERE ingestion_id <> 'src_click' OR humidity >= 20""")
def _(spark, sf):
    rules = [_rule("humidity", "convert", {"operation": "mathematical", "math_operation": "divide", "operand": 100}, ingestion_id="src_view"),
             _rule("humidity", "filter", {"operator": ">=", "value": 20}, ingestion_id="src_click")]
    df = vt.apply_transformations(v.enriched(spark, sf), rules)
    return df.select("event_id", "ingestion_id", F.col("normalized_data")["humidity"].alias("humidity"))


@query("vt_filter_cmp", f"""WITH {v.ENRICHED} SELECT event_id, temperature, humidity FROM en
  WHERE temperature > 25.5 AND humidity <= 80 AND humidity <> 50""")
def _(spark, sf):
    rules = [_rule("temperature", "filter", {"operator": ">", "value": 25.5}),
             _rule("humidity", "filter", {"operator": "<=", "value": 80}),
             _rule("humidity", "filter", {"operator": "!=", "value": 50})]
    df = vt.apply_transformations(v.enriched(spark, sf), rules)
    return df.select("event_id", extract_field("temperature").alias("temperature"),
                     extract_field("humidity").alias("humidity"))


@query("vt_filter_contains", f"""WITH {v.ENRICHED} SELECT event_id, sensor_id AS "sensorId" FROM en
  WHERE contains(lower(sensor_id), 'sor_1') AND contains(sensor_id, '2')""")
def _(spark, sf):
    rules = [_rule("sensorId", "filter", {"operator": "contains", "value": "SOR_1"}),
             _rule("sensorId", "filter", {"operator": "contains", "value": "2", "case_sensitive": True})]
    df = vt.apply_transformations(v.enriched(spark, sf), rules)
    return df.select("event_id", F.col("sensor_data")["sensorId"].alias("sensorId"))


@query("vt_filter_regex", f"""WITH {v.ENRICHED} SELECT event_id, sensor_id AS "sensorId" FROM en
  WHERE regexp_matches(sensor_id, '^sensor_[0-9]{{2}}$')""")
def _(spark, sf):
    rules = [_rule("sensorId", "filter", {"operator": "regex", "value": "^sensor_[0-9]{2}$"})]
    df = vt.apply_transformations(v.enriched(spark, sf), rules)
    return df.select("event_id", F.col("sensor_data")["sensorId"].alias("sensorId"))


def _convert(column, target, **more):
    return vt.converted(F.col(column), {"target_type": target, **more})


@query("vt_convert_type", f"""WITH {_DIRTY}, t AS (
    SELECT event_id, raw, TRY_CAST(trim(raw) AS DOUBLE) AS d,
      CASE event_id % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'On' WHEN 3 THEN '0' WHEN 4 THEN '1' ELSE raw END AS flag FROM dirty)
  SELECT event_id, CASE WHEN raw = 'abc' OR raw = 'NaN' THEN -1 ELSE d END AS as_float,
    CASE WHEN raw IN ('+5', ' 5', '5.') THEN 5 WHEN raw = '-.5' THEN 0
         WHEN raw NOT IN ('abc', 'NaN', '1e3') THEN CAST(trunc(d) AS INTEGER) END AS as_int,
    CASE WHEN lower(flag) IN ('true', '1', 'yes', 'on') THEN true WHEN lower(flag) IN ('false', '0', 'no', 'off') THEN false END AS as_bool,
    CASE WHEN lower(flag) IN ('true', '1', 'yes', 'on') THEN true ELSE false END AS bool_default, raw AS as_string
  FROM t""")
def _(spark, sf):
    kind = F.col("event_id") % 6
    flag = F.col("raw")
    for i, word in enumerate(["TRUE", "no", "On", "0", "1"]):
        flag = F.when(kind == i, word).otherwise(flag)
    df = dirty(spark, sf).withColumn("flag", flag)
    number = _convert("raw", "float", default_value=-1.0)
    # a float keeps about seven digits: compare what both engines round to
    return df.select("event_id",
                     F.when(F.isnan(number), -1.0).otherwise(F.round(number.cast("double"), 2)).alias("as_float"),
                     _convert("raw", "int").alias("as_int"), _convert("flag", "boolean").alias("as_bool"),
                     _convert("flag", "boolean", default_value=False).alias("bool_default"),
                     _convert("raw", "string").alias("as_string"))


@query("vt_filter_text", f"WITH {v.ENRICHED} SELECT event_id FROM en WHERE sensor_id = (SELECT min(sensor_id) FROM en) OR sensor_id IS NULL")
def _(spark, sf):
    df = v.enriched(spark, sf)
    first = df.agg(F.min(extract_field("sensorId", prefer_normalized=False))).first()[0]
    return vt.apply_transformations(df, [_rule("sensorId", "filter", {"operator": "==", "value": first}),
                                         _rule("sensorId", "filter", {"operator": "!=", "value": "nobody"})],
                                    on_missing="keep").select("event_id")


@query("vt_convert_datetime", """SELECT event_id,
    CASE WHEN event_id % 5 IN (0, 2) THEN date_trunc('second', ts) WHEN event_id % 5 = 1 THEN ts END AS any_shape,
    CASE WHEN event_id % 5 = 2 THEN date_trunc('second', ts) ELSE TIMESTAMP '2000-01-01' END AS by_pattern FROM events""")
def _(spark, sf):
    return v.ntz(timestamp_texts(spark, sf).select(
        "event_id", _convert("text", "datetime").alias("any_shape"),
        _convert("text", "datetime", format="%Y-%m-%d %H:%M:%S", default_value="2000-01-01 00:00:00").alias("by_pattern")))


@query("vt_math", f"""WITH {v.ENRICHED} SELECT event_id, humidity + 2.5 AS added, humidity - temp AS subtracted, humidity * 2 AS multiplied,
    CASE WHEN humidity <> 0 THEN temp / humidity END AS divided, CASE WHEN humidity <> 0 THEN fmod(temp, humidity) END AS remainder,
    pow(humidity, 2) AS squared FROM en""")
def _(spark, sf):
    df = v.enriched(spark, sf).select("event_id", extract_field("humidity").alias("h"), extract_field("temp").alias("t"))

    def math(a, operation, b):
        return vt.calculated(a, {"math_operation": operation}, b)
    h, t = F.col("h"), F.col("t")
    return df.select("event_id", math(h, "add", F.lit(2.5)).alias("added"), math(h, "subtract", t).alias("subtracted"),
                     math(h, "multiply", F.lit(2)).alias("multiplied"), math(t, "divide", h).alias("divided"),
                     math(t, "modulo", h).alias("remainder"), math(h, "power", F.lit(2)).alias("squared"))


_CHECKS = [{"rule": "range", "params": {"min": 5, "max": 60}}, {"rule": "not_null"}]


def _validated(spark, sf, on_fail, checks=_CHECKS):
    return vt.apply_transformations(v.enriched(spark, sf), [
        _rule("temperature", "validate", {"validation_rules": checks, "on_fail": on_fail})])


@query("vt_validate_drop", f"WITH {v.ENRICHED} SELECT event_id, temperature FROM en WHERE temperature BETWEEN 5 AND 60")
def _(spark, sf):
    return _validated(spark, sf, "drop").select("event_id", extract_field("temperature").alias("temperature"))


@query("vt_validate_flag", f"""WITH {v.ENRICHED} SELECT event_id, temperature,
  temperature >= 5 AND temperature <= 60 AND temperature IS NOT NULL AS strict, temperature >= 5 AND temperature <= 60 AS lenient FROM en""")
def _(spark, sf):
    lenient = _validated(spark, sf, "flag", _CHECKS[:1]).withColumnRenamed("temperature_valid", "lenient")
    strict = vt.apply_transformations(lenient, [_rule("temperature", "validate", {"validation_rules": _CHECKS})])
    return strict.select("event_id", extract_field("temperature").alias("temperature"),
                         F.col("temperature_valid").alias("strict"), "lenient")


@query("vt_validate_default", f"""WITH {v.ENRICHED} SELECT event_id, CASE WHEN temperature BETWEEN 5 AND 60 THEN temperature END AS kept,
  CAST(temperature AS VARCHAR) AS raw FROM en""")
def _(spark, sf):
    return _validated(spark, sf, "default").select("event_id", F.col("normalized_data")["temperature"].alias("kept"),
                                                   F.col("sensor_data")["temperature"].alias("raw"))


@query("vt_validate_enum_regex", f"""WITH {v.ENRICHED} SELECT event_id FROM en
  WHERE humidity IN (10, 20, 30) AND regexp_matches(sensor_id, '[02468]$')""")
def _(spark, sf):
    df = vt.apply_transformations(v.enriched(spark, sf), [
        _rule("humidity", "validate", {"validation_rules": [{"rule": "enum", "params": {"values": [10, 20, 30]}}], "on_fail": "drop"}),
        _rule("sensorId", "validate", {"validation_rules": [{"rule": "regex", "params": {"pattern": "[02468]$"}}], "on_fail": "drop"})])
    return df.select("event_id")


@query("vt_aggregate", f"""WITH {v.ENRICHED} SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start,
    time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS window_end, sensor_id AS "sensorId",
    max(temperature) AS temperature_max, CAST(count(temperature) AS BIGINT) AS temperature_count
  FROM en WHERE temperature IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    df = v.enriched(spark, sf)
    config = {"window": "1 hour", "group_by": ["sensorId"], "function": ["max", "count"]}
    return v.ntz(vt.vt_aggregate(df, "temperature", config))


@query("vt_write_back", f"""WITH {v.ENRICHED} SELECT event_id, temperature * 2 AS temperature, humidity, CAST(3 AS BIGINT) AS n_keys FROM en""")
def _(spark, sf):
    df = v.enriched(spark, sf).withColumn("temperature", extract_field("temperature") * 2)
    df = vt.write_back(df, ["temperature"])
    return df.select("event_id", F.col("normalized_data")["temperature"].alias("temperature"),
                     F.col("normalized_data")["humidity"].alias("humidity"),
                     F.size("normalized_data").cast("long").alias("n_keys"))
