"""The given tables seen as a sensor lake: Spark frames, and the same as SQL text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators.normalize import (add_enrichment_metadata, lower_columns, rules_frame,
                                   to_union)
from ..plans.gold import windowed_average
from ..sources.layers import read_layer
from ..storage import fresh_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ntz(df: DataFrame) -> DataFrame:
    """Result columns as plain (zone-less) timestamps, the type of the given tables."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
                       if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# ---------------------------------------------------------------- readings

def bronze(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw readings, with the mixed-case column names sources really send."""
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("src_"), "event_type").alias("ingestion_id"),
        F.col("ts").cast("string").alias("timestamp"),
        F.concat(F.lit("sensor_"), F.col("user_id").cast("string")).alias("sensor_id"),
        F.col("value").alias("Temp"),
        F.get_json_object("props", "$.k").cast("double").alias("HUMIDITY"),
        F.lit("mqtt").alias("source_type"))


BRONZE = """ev AS (
  SELECT event_id, 'src_' || event_type AS ingestion_id, ts, 'sensor_' || user_id AS sensor_id,
         value AS temp, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity
  FROM events)"""

RULES = [
    {"raw_key": "sensor_id", "canonical_key": "sensorId"},
    {"raw_key": "temp", "canonical_key": "temperature"},
    {"raw_key": "humidity", "canonical_key": "humidity"},
    {"raw_key": "temp", "canonical_key": "error_level", "ingestion_id": "src_error"},
    {"raw_key": "source_type", "canonical_key": "origin", "enabled": False},
]

RULES_SQL = """rules(id, ingestion_id, raw_key, canonical_key, enabled) AS (VALUES
  (1, NULL, 'sensor_id', 'sensorId', true), (2, NULL, 'temp', 'temperature', true),
  (3, NULL, 'humidity', 'humidity', true), (4, 'src_error', 'temp', 'error_level', true),
  (5, NULL, 'source_type', 'origin', false))"""


def rules(spark: SparkSession) -> DataFrame:
    return rules_frame(spark, RULES)


def union(spark: SparkSession, sf: str) -> DataFrame:
    return to_union(lower_columns(bronze(spark, sf)), keep=["event_id"])


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return to_union(lower_columns(bronze(spark, sf)), keep=["event_id"], rules=rules(spark))


SILVER = T.StructType([*schema.ENRICHED.fields, T.StructField("event_id", T.LongType())])

_silver_paths: dict[tuple[str, str], str] = {}


def silver_path(spark: SparkSession, sf: str) -> str:
    """Folder of the silver table, written on first use and scanned by every query after that."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _silver_paths:
        path = fresh_path(spark, "silver")
        # a reading arrives the moment it is taken
        rows = add_enrichment_metadata(normalized(spark, sf), as_of=F.col("timestamp"))
        rows.hint("rebalance", "ingestion_id").write.partitionBy("ingestion_id").parquet(path)
        _silver_paths[key] = path
    return _silver_paths[key]


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return read_layer(spark, silver_path(spark, sf), SILVER)


ENRICHED = BRONZE + """,
en AS (
  SELECT event_id, ingestion_id, ts, sensor_id, temp, humidity,
         CASE WHEN ingestion_id <> 'src_error' THEN temp END AS temperature,
         CASE WHEN ingestion_id = 'src_error' THEN temp END AS error_level
  FROM ev)"""


# ---------------------------------------------------------------- devices

DEVICES = [
    ("src_click", "Clicks", True, "public", 7),
    (" SRC_View ", "Views", True, "internal", 90),
    ("src_purchase", "Purchases", True, "confidential", 14),
    ("src_error", "Errors", False, "restricted", 90),
    ("src_spare", "Spare", True, "internal", 90),
    ("unknown", "Nobody", True, "public", 90),
]

DEVICES_SQL = """devices(ingestion_id, name, enabled, sensitivity, retention_days) AS (VALUES
  ('src_click', 'Clicks', true, 'public', 7), (' SRC_View ', 'Views', true, 'internal', 90),
  ('src_purchase', 'Purchases', true, 'confidential', 14),
  ('src_error', 'Errors', false, 'restricted', 90),
  ('src_spare', 'Spare', true, 'internal', 90), ('unknown', 'Nobody', true, 'public', 90))"""


def devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DEVICES, "ingestion_id string, name string, enabled boolean, sensitivity string, "
                 "retention_days int")


# ---------------------------------------------------------------- gold and derived sets

def hourly_averages(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_average(enriched(spark, sf), window="1 hour")


# the mean of decimals: DuckDB's decimal division, rounded twice, is exact to the cent
MEAN = ("CAST(round((CAST(sum(CAST({0} AS DECIMAL(18,4))) AS DECIMAL(30,8)) / count({0}))"
        "::DECIMAL(38,10), 2) AS DOUBLE)")
HOUR = "time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01')"

AVERAGES = ENRICHED + f""",
gold AS (
  SELECT sensor_id AS "sensorId", {HOUR} AS time_start, {MEAN.format('temperature')} AS avg_temp,
         min(ts) AS min_enrichment_ts
  FROM en WHERE temperature IS NOT NULL GROUP BY ALL)"""


def alert_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The alert log users search: one row per reading over 30."""
    return table(spark, sf, "events").where("value > 30").select(
        F.col("event_id").alias("id"),
        F.when(F.col("value") > 100, "critical").otherwise("warning").alias("level"),
        F.concat(F.lit("sensor_"), F.col("user_id").cast("string"),
                 F.when(F.col("value") > 100, " overheated at ").otherwise(" is warm at "),
                 F.col("value").cast("string")).alias("message"),
        "ts")


ALERT_MESSAGES = """alerts AS (
  SELECT event_id AS id, CASE WHEN value > 100 THEN 'critical' ELSE 'warning' END AS level,
         'sensor_' || user_id || CASE WHEN value > 100 THEN ' overheated at ' ELSE ' is warm at ' END || CAST(value AS VARCHAR) AS message, ts
  FROM events WHERE value > 30)"""
