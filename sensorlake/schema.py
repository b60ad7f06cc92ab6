"""Fixed table layouts (bronze is dynamic, everything after it is not)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
_NUMBER_MAP = T.MapType(T.StringType(), T.DoubleType())

UNION = T.StructType([
    T.StructField("ingestion_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("sensor_data", _TEXT_MAP),
    T.StructField("normalized_data", _NUMBER_MAP),
])

ENRICHED = T.StructType([
    T.StructField("ingestion_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("event_time", T.TimestampType(), False),
    T.StructField("sensor_data", _TEXT_MAP),
    T.StructField("normalized_data", _NUMBER_MAP),
    T.StructField("ingest_ts", T.TimestampType()),
    T.StructField("ingest_date", T.DateType()),
    T.StructField("ingest_hour", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("site", T.StringType()),
])

AVERAGES = T.StructType([
    T.StructField("sensorId", T.StringType()),
    T.StructField("time_start", T.TimestampType()),
    T.StructField("avg_temp", T.DoubleType()),
    T.StructField("min_enrichment_ts", T.TimestampType()),
])

ALERTS = T.StructType([
    T.StructField("sensorId", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("alert_type", T.StringType()),
])

# The fixed bronze layout, used when schema inference is bypassed.
FIXED_BRONZE = T.StructType([
    T.StructField("ingestion_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("thread_id", T.DoubleType()),
    T.StructField("sequence", T.DoubleType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("ingestion_timestamp", T.StringType()),
])

LAYERS = {"enriched": ENRICHED, "averages": AVERAGES, "alerts": ALERTS}


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def is_union(df: DataFrame) -> bool:
    """True if the frame carries every column of the union layout."""
    return set(UNION.fieldNames()) <= set(df.columns)


def check_stream_schema(schema: T.StructType) -> None:
    """A stream needs its source id and at least one more field."""
    names = schema.fieldNames()
    if "ingestion_id" not in names:
        raise ValueError("stream schema has no ingestion_id field")
    if len(names) < 2:
        raise ValueError("stream schema has no data fields")
