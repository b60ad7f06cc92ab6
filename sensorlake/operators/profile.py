"""What sources send: per-source counts, fields with types and samples, drift between schemas.

Input is a message frame ``(ingestion_id, topic, ts, value)`` with the payload as JSON text.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import infer_type, merged_type

# Spark type stored for each reported type; anything else is text.
STORED_TYPE = {
    "int": "double", "integer": "double", "long": "double", "bigint": "double",
    "float": "double", "double": "double", "number": "double",
    "bool": "boolean", "boolean": "boolean",
}
# Promotion order of stored types; a number meeting text becomes text.
PROMOTION = ("boolean", "int", "bigint", "float", "double", "string")

SAMPLES = 5


def payload_fields(messages: DataFrame) -> DataFrame:
    """One row per top-level payload field: ``(ingestion_id, ts, field, type, text)``."""
    entries = messages.select("ingestion_id", "ts",
                              F.explode(F.from_json("value", "map<string,variant>")).alias("field", "_v"))
    return entries.select("ingestion_id", "ts", "field", infer_type(F.col("_v")).alias("type"),
                          F.col("_v").try_cast("string").alias("text"))


def dataset_profile(messages: DataFrame) -> DataFrame:
    """Per source: topic, readings, first and last seen, distinct sensors, payload bytes.

    Grouped by sensor first, so no source has its sensors gathered in one place; and by topic, so
    that the pass over all messages only counts and compares numbers, which hashes without sorting.
    """
    sensor = F.coalesce(F.get_json_object("value", "$.sensor_id"), F.get_json_object("value", "$.sensorId"))
    by_topic = (messages.select("ingestion_id", "topic", "ts", sensor.alias("_sensor"),
                                F.octet_length("value").alias("_bytes"))
                .groupBy("ingestion_id", "_sensor", "topic")
                .agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
                     F.sum("_bytes").alias("bytes")))
    by_sensor = by_topic.groupBy("ingestion_id", "_sensor").agg(
        F.sum("n").alias("n"), F.min(F.struct("first", "topic")).alias("_topic"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.sum("bytes").alias("bytes"))
    return by_sensor.groupBy("ingestion_id").agg(
        F.min("_topic")["topic"].alias("topic"), F.sum("n").alias("record_count"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.count("_sensor").alias("unique_sensor_count"), F.sum("bytes").alias("data_size_bytes"))


def field_profile(messages: DataFrame) -> DataFrame:
    """Per source and field: merged type, uses, nulls, and up to five distinct sample values.

    Samples are the values seen first, over all readings: equal values meet before they are ranked,
    and the ranking keeps five per task before its shuffle.
    """
    fields = payload_fields(messages)
    types = _first_seen(fields, "ingestion_id", "field").groupBy("ingestion_id", "field").agg(
        F.sum("uses").alias("uses"),
        F.sum(F.when(F.col("type") == "null", F.col("uses")).otherwise(0)).alias("nulls"),
        merged_type(F.col("type"), F.col("first_seen")).alias("type"))
    values = fields.where("text is not null").groupBy("ingestion_id", "field", "text").agg(F.min("ts").alias("ts"))
    earliest = W.partitionBy("ingestion_id", "field").orderBy(F.col("ts").asc_nulls_last(), "text")
    ranked = values.withColumn("_rank", F.row_number().over(earliest)).where(F.col("_rank") <= SAMPLES)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "text"))), lambda s: s["text"])
    samples = ranked.groupBy("ingestion_id", "field").agg(in_order.alias("samples"))
    return types.join(samples, ["ingestion_id", "field"], "left")


def schema_evolution(messages: DataFrame) -> DataFrame:
    """First time each (source, field, type) was seen, oldest first."""
    return _first_seen(payload_fields(messages), "ingestion_id", "field").drop("uses") \
        .orderBy("first_seen", "ingestion_id", "field", "type")


def _first_seen(fields: DataFrame, *keys: str) -> DataFrame:
    """Uses and first time of each type, the only pass over all fields; types merge afterwards."""
    return fields.groupBy(*keys, "type").agg(F.count("*").alias("uses"), F.min("ts").alias("first_seen"))


def merge_types(fields: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The most general ``type`` per key of rows ``(keys..., type, ts)``."""
    keys = list(keys)
    return _first_seen(fields, *keys).groupBy(*keys).agg(
        merged_type(F.col("type"), F.col("first_seen")).alias("type"))


def stored_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STORED_TYPE.items() for x in pair])
    return F.coalesce(known[F.lower(name)], F.lit("string"))


def merged_fields(profile: DataFrame) -> DataFrame:
    """Per field name over all sources: the stored type that holds every source's values."""
    order = F.create_map(*[F.lit(x) for i, name in enumerate(PROMOTION) for x in (name, i)])
    kind = stored_type(F.col("type"))
    return profile.groupBy(F.col("field").alias("name")).agg(
        F.max_by(kind, order[kind]).alias("type"), F.count("*").alias("sources"))


def merged_schema(profile: DataFrame, max_fields: int = 10000) -> T.StructType:
    """``merged_fields`` as a read schema: sorted by name, always with ``ingestion_id``."""
    rows = merged_fields(profile).orderBy("name").limit(max_fields + 1).collect()
    if len(rows) > max_fields:
        raise ValueError(f"more than {max_fields} fields; use wide.stored_object instead")
    kinds = {r.name: r.type for r in rows}
    kinds.setdefault("ingestion_id", "string")
    return T.StructType([T.StructField(name, T._parse_datatype_string(kinds[name]))
                         for name in sorted(kinds)])


def topics_summary(metadata: DataFrame) -> DataFrame:
    """Totals per topic over ``dataset_profile`` rows, most records first."""
    return metadata.groupBy("topic").agg(
        F.count("*").alias("dataset_count"), F.sum("record_count").alias("total_records"),
        F.sum("data_size_bytes").alias("total_size_bytes"),
        F.sum("unique_sensor_count").alias("total_unique_sensors"),
        F.min("first_seen").alias("earliest_data"), F.max("last_seen").alias("latest_data")) \
        .orderBy(F.desc("total_records"), "topic")


def metadata_stats(metadata: DataFrame) -> DataFrame:
    """Grand totals over ``dataset_profile`` rows."""
    return metadata.agg(
        F.count("*").alias("total_datasets"), F.count_distinct("topic").alias("total_topics"),
        F.sum("record_count").alias("total_records"),
        F.sum("unique_sensor_count").alias("total_unique_sensors"),
        F.round(F.sum("data_size_bytes") / (1024 * 1024), 2).alias("total_size_mb"))


def schema_drift(stream_fields: DataFrame, data_fields: DataFrame) -> DataFrame:
    """Fields present in the data that the running stream's schema lacks."""
    return data_fields.select("field").distinct().join(stream_fields.select("field"), "field", "left_anti")


