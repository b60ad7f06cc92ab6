"""Profiles of sources and fields, schema merging and drift, quality counts."""

from pyspark.sql import functions as F

from ..functions import extract_field, infer_type
from ..operators import normalize as nz
from ..operators import ontology as on
from ..operators import profile as pf
from ..operators import quality as ql
from ..operators import wide
from . import views as v
from .normalization import last_time
from .registry import query


# ---------------------------------------------------------------- messages

def _payload(spark, sf):
    """Events as JSON messages whose fields and types differ between sources."""
    k = F.get_json_object("props", "$.k")
    kind, i = F.col("event_type"), F.col("event_id")

    def text(c):
        return c.cast("string")
    temp = F.when(i % 7 == 0, "null").when((kind == "error") & (i % 3 == 0), '"n/a"').otherwise(text(F.col("value")))
    extra = (F.when(kind == "click", F.concat(F.lit(', "ok": '), F.when(i % 2 == 0, "true").otherwise("false")))
             .when(kind == "view", F.concat(F.lit(', "site": {"floor": '), k, F.lit("}")))
             .when(kind == "purchase", F.concat(F.lit(', "ref": "00000000-0000-4000-8000-'), F.lpad(text(i), 12, "0"), F.lit('"')))
             .when(kind == "error", F.concat(F.lit(', "ok": '), k)).otherwise(', "tags": [1, 2]'))
    payload = F.concat(F.lit('{"sensor_id": "sensor_'), text(F.col("user_id")), F.lit('", "temp": '), temp,
                       F.lit(', "k": '), k, extra, F.lit("}"))
    return v.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("src_"), kind).alias("ingestion_id"),
        F.concat(F.lit("city/sensors/"), kind).alias("topic"), "ts", payload.alias("value"))


_MESSAGES = """k AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
msg AS (SELECT event_id, 'src_' || event_type AS ingestion_id, 'city/sensors/' || event_type AS topic, ts, user_id, event_type, value AS temp, k,
  '{"sensor_id": "sensor_' || user_id || '", "temp": ' ||
  CASE WHEN event_id % 7 = 0 THEN 'null' WHEN event_type = 'error' AND event_id % 3 = 0 THEN '"n/a"' ELSE CAST(value AS VARCHAR) END || ', "k": ' || k ||
  CASE event_type WHEN 'click' THEN ', "ok": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
    WHEN 'view' THEN ', "site": {"floor": ' || k || '}'
    WHEN 'purchase' THEN ', "ref": "00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '"'
    WHEN 'error' THEN ', "ok": ' || k ELSE ', "tags": [1, 2]' END || '}' AS value FROM k),
fields AS (
  SELECT event_id, ingestion_id, ts, 'sensor_id' AS field, 'string' AS type, 'sensor_' || user_id AS text FROM msg
  UNION ALL SELECT event_id, ingestion_id, ts, 'temp', CASE WHEN event_id % 7 = 0 THEN 'null' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'string' ELSE 'double' END,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'n/a' ELSE regexp_replace(CAST(temp AS VARCHAR), '[.]0$', '') END FROM msg
  UNION ALL SELECT event_id, ingestion_id, ts, 'k', 'double', k FROM msg
  UNION ALL SELECT event_id, ingestion_id, ts, 'ok', 'boolean', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END FROM msg WHERE event_type = 'click'
  UNION ALL SELECT event_id, ingestion_id, ts, 'ok', 'double', k FROM msg WHERE event_type = 'error'
  UNION ALL SELECT event_id, ingestion_id, ts, 'site', 'object', '{"floor":' || k || '}' FROM msg WHERE event_type = 'view'
  UNION ALL SELECT event_id, ingestion_id, ts, 'ref', 'uuid', '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') FROM msg WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, ingestion_id, ts, 'tags', 'array', '[1,2]' FROM msg WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')),
ranks(type, rank) AS (VALUES ('null', 0), ('boolean', 1), ('double', 3), ('string', 4), ('uuid', 4), ('array', 5), ('object', 6)),
prof AS (SELECT ingestion_id, field, arg_max(type, rank) AS type, count(*) AS uses, count(*) FILTER (WHERE type = 'null') AS nulls
  FROM fields JOIN ranks USING (type) GROUP BY ALL),
meta AS (SELECT ingestion_id, min(topic) AS topic, count(*) AS record_count, min(ts) AS first_seen, max(ts) AS last_seen,
  count(DISTINCT user_id) AS unique_sensor_count, CAST(sum(strlen(value)) AS BIGINT) AS data_size_bytes FROM msg GROUP BY 1)"""


@query("infer_type", f"WITH {_MESSAGES} SELECT event_id, field, type, text FROM fields")
def _(spark, sf):
    entries = _payload(spark, sf).select("event_id", F.explode(F.from_json("value", "map<string,variant>")).alias("field", "_v"))
    return entries.select("event_id", "field", infer_type(F.col("_v")).alias("type"), F.col("_v").try_cast("string").alias("text"))


@query("merge_types", f"WITH {_MESSAGES} SELECT field, arg_max(type, rank) AS type FROM fields JOIN ranks USING (type) GROUP BY 1")
def _(spark, sf):
    return pf.merge_types(pf.payload_fields(_payload(spark, sf)), ["field"])


@query("dataset_profile", f"WITH {_MESSAGES} SELECT * FROM meta")
def _(spark, sf):
    return pf.dataset_profile(_payload(spark, sf))


@query("field_profile", f"""WITH {_MESSAGES}, uniq AS (SELECT ingestion_id, field, text, min(ts) AS ts FROM fields WHERE text IS NOT NULL GROUP BY ALL),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY ingestion_id, field ORDER BY ts, text) AS rn FROM uniq QUALIFY rn <= 5),
  samples AS (SELECT ingestion_id, field, string_agg(text, '|' ORDER BY rn) AS samples FROM firsts GROUP BY ALL)
  SELECT ingestion_id, field, type, CAST(uses AS BIGINT) AS uses, CAST(nulls AS BIGINT) AS nulls, samples FROM prof LEFT JOIN samples USING (ingestion_id, field)""")
def _(spark, sf):
    return pf.field_profile(_payload(spark, sf)).withColumn("samples", F.array_join("samples", "|"))


@query("schema_evolution", f"WITH {_MESSAGES} SELECT ingestion_id, field, type, min(ts) AS first_seen FROM fields GROUP BY ALL")
def _(spark, sf):
    return pf.schema_evolution(_payload(spark, sf))


@query("merged_schema", f"""WITH {_MESSAGES} SELECT field AS name, arg_max(kind, pos) AS type, CAST(count(*) AS BIGINT) AS sources FROM (
    SELECT field, CASE type WHEN 'double' THEN 'double' WHEN 'boolean' THEN 'boolean' ELSE 'string' END AS kind,
      CASE type WHEN 'double' THEN 4 WHEN 'boolean' THEN 0 ELSE 5 END AS pos FROM prof) GROUP BY 1""")
def _(spark, sf):
    return pf.merged_fields(pf.field_profile(_payload(spark, sf)))


@query("stored_object", f"""WITH {_MESSAGES} SELECT event_id, max(text) FILTER (WHERE field = 'sensor_id') AS sensor_id,
    max(text) FILTER (WHERE field = 'temp') AS temp, max(text) FILTER (WHERE field = 'site') AS site, max(text) FILTER (WHERE field = 'tags') AS tags,
    max(CASE WHEN type = 'boolean' THEN CASE WHEN text = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN field = 'ok' THEN CAST(text AS DOUBLE) END) FILTER (WHERE field = 'ok') AS ok
  FROM fields GROUP BY 1""")
def _(spark, sf):
    objects = _payload(spark, sf).select("event_id", "ts", F.try_parse_json("value").alias("fields"))
    stored = wide.stored_object(objects, wide.field_dictionary(objects, F.col("ts")), ["event_id"])
    return stored.select("event_id", *[wide.field_value(n, "string").alias(n) for n in ("sensor_id", "temp", "site", "tags")],
                         wide.field_value("ok").alias("ok"))


@query("topics_summary", f"""WITH {_MESSAGES} SELECT topic, CAST(count(*) AS BIGINT) AS dataset_count, CAST(sum(record_count) AS BIGINT) AS total_records,
    CAST(sum(data_size_bytes) AS BIGINT) AS total_size_bytes, CAST(sum(unique_sensor_count) AS BIGINT) AS total_unique_sensors,
    min(first_seen) AS earliest_data, max(last_seen) AS latest_data FROM meta GROUP BY 1""")
def _(spark, sf):
    return pf.topics_summary(pf.dataset_profile(_payload(spark, sf)))


@query("metadata_stats", f"""WITH {_MESSAGES} SELECT CAST(count(*) AS BIGINT) AS total_datasets, CAST(count(DISTINCT topic) AS BIGINT) AS total_topics,
    CAST(sum(record_count) AS BIGINT) AS total_records, CAST(sum(unique_sensor_count) AS BIGINT) AS total_unique_sensors,
    round(sum(data_size_bytes) / (1024 * 1024), 2) AS total_size_mb FROM meta""")
def _(spark, sf):
    return pf.metadata_stats(pf.dataset_profile(_payload(spark, sf)))


# the schema a stream was started with, before sources began to send more
_STREAM_FIELDS = ["ingestion_id", "timestamp", "sensor_id", "temp", "k"]


@query("schema_drift", f"WITH {_MESSAGES} SELECT DISTINCT field FROM fields WHERE field NOT IN ('ingestion_id', 'timestamp', 'sensor_id', 'temp', 'k')")
def _(spark, sf):
    running = spark.createDataFrame([(f,) for f in _STREAM_FIELDS], "field string")
    return pf.schema_drift(running, pf.payload_fields(_payload(spark, sf)))


def _unknown(spark, sf):
    known = spark.createDataFrame([("temperature",), ("humidity",), ("sensorId",), ("k",)], "field string")
    return on.unrecognized_fields(pf.payload_fields(_payload(spark, sf)), v.rules(spark), known)


_UNKNOWN = """unknown AS (SELECT DISTINCT 'ontology-unknown-' || field AS id, field, 'Sensor field "' || field || '" is not defined in the ontology.' AS message, 'info' AS variant
  FROM (SELECT CASE field WHEN 'sensor_id' THEN 'sensorId' WHEN 'temp' THEN 'temperature' ELSE field END AS field FROM fields)
  WHERE field NOT IN ('temperature', 'humidity', 'sensorId', 'k'))"""


@query("unrecognized_fields", f"WITH {_MESSAGES}, {_UNKNOWN} SELECT * FROM unknown")
def _(spark, sf):
    return _unknown(spark, sf)


@query("collect_alerts", f"""WITH {_MESSAGES}, {_UNKNOWN} SELECT id, message, variant FROM unknown
  UNION ALL SELECT 'unlinked-' || ingestion_id, '"' || ingestion_id || '" is not linked to any building.', 'warning' FROM (SELECT DISTINCT ingestion_id FROM msg WHERE event_type <> 'click')""")
def _(spark, sf):
    from ..operators.devices import unlinked_devices
    messages = _payload(spark, sf)
    sources = messages.select(F.lit("ann").alias("owner"), "ingestion_id", F.lit("").alias("name")).distinct()
    links = messages.where("topic = 'city/sensors/click'").select("ingestion_id").distinct()
    return on.collect_alerts(_unknown(spark, sf), unlinked_devices(sources, links))


@query("valid_sensor_types", """SELECT p_partkey AS id, p_type AS type FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'STANDARD')""")
def _(spark, sf):
    classes = spark.createDataFrame([("Sensor", None), ("ECONOMY", "Sensor"), ("SMALL", "Sensor"), ("STANDARD", "Sensor"),
                                     ("LARGE", "Building"), ("PROMO", "ECONOMY")], "name string, parent string")
    return on.valid_sensor_types(v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type")), classes)


# ---------------------------------------------------------------- quality

@query("distinct_sources", f"WITH {v.BRONZE} SELECT DISTINCT ingestion_id FROM ev")
def _(spark, sf):
    return v.bronze(spark, sf).select("ingestion_id").distinct().orderBy("ingestion_id")


_DAY_FILE = "strftime(ts, '%Y%m%d')"


@query("bronze_stats", f"""WITH {v.BRONZE} SELECT ingestion_id, CAST(count(*) AS BIGINT) AS readings, CAST(count(DISTINCT {_DAY_FILE}) AS BIGINT) AS files
  FROM ev GROUP BY 1""")
def _(spark, sf):
    return ql.bronze_stats(v.bronze(spark, sf), file=F.date_format("timestamp", "yyyyMMdd"))


@query("enrichment_summary", f"""WITH {v.AVERAGES}, {v.DEVICES_SQL}, recent AS (SELECT * FROM en WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '600 minutes'),
  recent_gold AS (SELECT * FROM gold WHERE time_start >= (SELECT max(ts) FROM events) - INTERVAL '600 minutes')
  SELECT CAST(count(*) AS BIGINT) AS recent_rows, CAST(count(DISTINCT sensor_id) AS BIGINT) AS recent_sensors,
    (SELECT string_agg(sensor_id, ',' ORDER BY sensor_id) FROM (SELECT DISTINCT sensor_id FROM recent ORDER BY 1 LIMIT 5)) AS sample_sensors,
    (SELECT CAST(count(*) AS BIGINT) FROM recent_gold) AS gold_rows, (SELECT CAST(count(DISTINCT "sensorId") AS BIGINT) FROM recent_gold) AS gold_sensors,
    (SELECT CAST(count(*) AS BIGINT) FROM devices WHERE enabled) AS registered_total, false AS registered_any FROM recent""")
def _(spark, sf):
    return ql.enrichment_summary(v.enriched(spark, sf), v.hourly_averages(spark, sf), v.devices(spark), 600, last_time(spark, sf))


@query("processing_metrics", f"""WITH {v.ENRICHED} SELECT CAST(count(*) AS BIGINT) AS records_processed,
    CAST(count(*) FILTER (WHERE temperature IS NULL) AS BIGINT) AS records_failed, max(ts) AS last_processing_time,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2) AS processing_duration_seconds,
    round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 2) AS records_per_second,
    round(count(*) FILTER (WHERE temperature IS NULL) / count(*) * 100, 2) AS error_rate_percent FROM en""")
def _(spark, sf):
    # readings of the error source count as failed: nothing of theirs is normalised
    only = F.when(F.col("ingestion_id") != "src_error", F.col("normalized_data"))
    return v.ntz(ql.processing_metrics(v.enriched(spark, sf).withColumn("normalized_data", only)))


@query("data_quality", f"""WITH {v.ENRICHED} SELECT CAST(count(DISTINCT ingestion_id) AS BIGINT) AS unique_ingestion_ids, CAST(count(*) AS BIGINT) AS readings,
    CAST(7 AS BIGINT) AS fields_with_data, CAST(4 AS BIGINT) AS fields_normalized, round(4 / 7 * 100, 2) AS schema_compliance_rate FROM en""")
def _(spark, sf):
    return ql.data_quality(v.enriched(spark, sf))


@query("source_counts", f"WITH {v.BRONZE} SELECT ingestion_id, CAST(count(*) AS BIGINT) AS readings FROM ev GROUP BY 1")
def _(spark, sf):
    return ql.source_counts(v.bronze(spark, sf))


@query("field_coverage", f"""WITH {v.ENRICHED} SELECT unnest(['sensor_id', 'sensorId', 'temp', 'temperature', 'error_level', 'humidity', 'source_type']) AS field,
    unnest([count(*), count(*), count(*), count(temperature), count(error_level), count(*), count(*)]) AS readings,
    unnest([0, 0, count(*), count(temperature), count(error_level), count(*), 0]) AS normalized FROM en""")
def _(spark, sf):
    return ql.field_coverage(v.enriched(spark, sf))


@query("normalization_stats", f"""WITH {v.BRONZE} SELECT CAST(4 AS BIGINT) AS active_rules,
    CAST(3 * count(*) AS BIGINT) AS total_applied, CAST(4 AS BIGINT) AS canonical_fields,
    round(count(*) FILTER (WHERE ingestion_id <> 'src_error') * 3.0 / (3 * count(*)) * 100
      + count(*) FILTER (WHERE ingestion_id = 'src_error') * 2.0 / (3 * count(*)) * 100, 2) AS success_rate FROM ev""")
def _(spark, sf):
    used = nz.rule_usage(v.union(spark, sf), v.rules(spark))
    # the error source's own rule has been counted, but its last use was not recorded
    rules = v.rules(spark).drop("applied_count", "last_applied_at").join(
        used.select(F.col("rule_id").alias("id"), "applied_count",
                    F.when(F.col("canonical_key") != "error_level", F.col("last_applied_at")).alias("last_applied_at")), "id", "left")
    return ql.normalization_stats(rules)


@query("readings_long", f"""WITH {v.ENRICHED} SELECT ingestion_id, 'temp' AS metric, temp AS value, ts FROM en
  UNION ALL SELECT ingestion_id, 'humidity', humidity, ts FROM en UNION ALL SELECT ingestion_id, 'temperature', temperature, ts FROM en WHERE temperature IS NOT NULL
  UNION ALL SELECT ingestion_id, 'error_level', error_level, ts FROM en WHERE error_level IS NOT NULL""")
def _(spark, sf):
    return v.ntz(ql.readings_long(v.enriched(spark, sf)))


@query("hourly_mean", f"""SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, {v.MEAN.format('value')} AS mean FROM events GROUP BY ALL""")
def _(spark, sf):
    return ql.hourly_mean(v.table(spark, sf, "events"), "value", "ts")


@query("global_mean", """SELECT CAST(round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(30,8)) / count(value), 4) AS DOUBLE) AS mean, CAST(count(value) AS BIGINT) AS n FROM events""")
def _(spark, sf):
    return ql.global_mean(v.table(spark, sf, "events"), "value")


@query("approx_files")
def _(spark, sf):
    return ql.approx_files(v.table(spark, sf, "events"), "ts")


@query("quality_log", f"""WITH {v.ENRICHED} SELECT ingestion_id, 'missing_temperature' AS metric_name, CAST(count(*) - count(temperature) AS DOUBLE) AS metric_value, max(ts) AS measurement_time
  FROM en GROUP BY ingestion_id, CAST(ts AS DATE)""")
def _(spark, sf):
    from ..storage import fresh_path
    path = fresh_path(spark, "quality-log")
    measured = v.enriched(spark, sf).groupBy("ingestion_id", "ingest_date").agg(
        F.lit("missing_temperature").alias("metric_name"),
        F.count_if(extract_field("temperature").isNull()).cast("double").alias("metric_value"),
        F.max("timestamp").alias("measurement_time")).drop("ingest_date")
    ql.append_quality_metrics(measured, path)
    return v.ntz(ql.quality_log(spark.read.schema(measured.schema).parquet(path)))
