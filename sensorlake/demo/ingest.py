"""Messages in, files out: decoding, bronze layout, file listings, retention."""

from pyspark.sql import functions as F

from ..functions import normalize_event_time, stable_ingestion_id, topic_source_id
from ..operators.normalize import lower_columns
from ..schema import ENRICHED
from ..sources import files as fl
from ..sources import layers as ly
from ..sources import messages as ms
from ..sources import sensor_csv as sc
from ..storage import fresh_path
from . import views as v
from .normalization import last_time, timestamp_texts
from .registry import query


def raw_messages(spark, sf):
    """Event properties as broker messages, every tenth of them not JSON."""
    return v.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("city/sensors/"), "event_type").alias("topic"), "ts",
        F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("props")).alias("value"))


_RAW = "raw AS (SELECT event_id, event_type, 'city/sensors/' || event_type AS topic, ts, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE props END AS value, json_extract_string(props, '$.k') AS k FROM events)"


@query("parse_messages", f"""WITH {_RAW} SELECT event_id, CASE WHEN value <> 'bad' THEN k END AS k, CASE WHEN value = 'bad' THEN 'bad' END AS content,
  CASE WHEN value = 'bad' THEN 'true' END AS raw, CAST(CASE WHEN value = 'bad' THEN 2 ELSE 1 END AS INTEGER) AS n FROM raw""")
def _(spark, sf):
    data = F.col("data")
    return ms.parse_messages(raw_messages(spark, sf)).select(
        "event_id", data["k"].alias("k"), data["content"].alias("content"), data["raw"].alias("raw"), F.size(data).alias("n"))


@query("source_ids", f"""WITH {_RAW} SELECT event_id, 'broker_city_sensors_' || event_type || '_wildcard_plus' AS source_id,
  substr(md5(' My ' || event_type || '-Feed _mqtt'), 1, 8) || '_my_' || event_type || '_feed_mqtt' AS stable_id FROM raw""")
def _(spark, sf):
    name = F.concat(F.lit(" My "), F.element_at(F.split("topic", "/"), -1), F.lit("-Feed "))
    return raw_messages(spark, sf).select(
        "event_id", topic_source_id(F.concat("topic", F.lit("/#/+")), "broker").alias("source_id"),
        stable_ingestion_id(name, F.lit("mqtt")).alias("stable_id"))


@query("extract_records", f"""WITH {_RAW}, k3 AS (SELECT event_id, event_id % 4 AS kind, k FROM raw), two AS (SELECT unnest([0, 1]) AS i)
  SELECT event_id, '{{"n":' || CAST(CAST(k AS INTEGER) + i AS VARCHAR) || '}}' AS record FROM k3, two WHERE kind = 0
  UNION ALL SELECT event_id, '{{"n":' || k || '}}' FROM k3 WHERE kind = 1
  UNION ALL SELECT event_id, '{{"other":' || k || '}}' FROM k3 WHERE kind = 2
  UNION ALL SELECT event_id, '{{"content":"plain ' || k || '"}}' FROM k3 WHERE kind = 3""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 4
    nested = F.concat(F.lit('{"data": {"items": [{"n": '), k, F.lit('}, {"n": '), (k.cast("int") + 1).cast("string"), F.lit("}]}}"))
    document = F.when(kind == 0, nested).when(kind == 1, F.concat(F.lit('{"data": {"items": {"n": '), k, F.lit("}}}"))) \
        .when(kind == 2, F.concat(F.lit('{"other": '), k, F.lit("}"))).otherwise(F.concat(F.lit("plain "), k))
    return ms.extract_records(v.table(spark, sf, "events").select("event_id", document.alias("value")), "data.items") \
        .select("event_id", "record")


@query("extract_records_indexed", """SELECT event_id, '{"n":' || json_extract_string(props, '$.k') || '}' AS record FROM events""")
def _(spark, sf):
    document = F.concat(F.lit('[{"skip": 1}, {"rows": '), F.replace("props", F.lit('"k"'), F.lit('"n"')), F.lit("}]"))
    return ms.extract_records(v.table(spark, sf, "events").select("event_id", document.alias("value")), "1.rows") \
        .select("event_id", "record")


@query("event_time_normalize", """SELECT event_id, CASE event_id % 5 WHEN 1 THEN ts WHEN 4 THEN (SELECT max(ts) FROM events) ELSE date_trunc('second', ts) END AS event_time FROM events""")
def _(spark, sf):
    return v.ntz(timestamp_texts(spark, sf).select(
        "event_id", normalize_event_time(F.col("text"), last_time(spark, sf)).alias("event_time")))


@query("bronze_payload", f"""WITH {_RAW} SELECT event_id, 'broker_city_sensors_' || event_type AS ingestion_id, ts AS event_time,
  CASE WHEN value = 'bad' THEN NULL ELSE k END AS k, 'mqtt' AS source_type, topic, CASE WHEN value = 'bad' THEN 'true' END AS raw,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp FROM raw""")
def _(spark, sf):
    parsed = ms.parse_messages(raw_messages(spark, sf)).select(
        "topic", F.col("ts").cast("string").alias("timestamp"), topic_source_id(F.col("topic"), "broker").alias("source_id"),
        F.map_concat("data", F.create_map(F.lit("ingestion_id"), F.lit("overwritten"))).alias("data"),
        F.create_map(F.lit("source_type"), F.lit("mqtt"), F.lit("topic"), F.col("topic"), F.lit("event_id"), F.col("event_id").cast("string"))
        .alias("metadata"))
    p = F.col("payload")
    return v.ntz(ms.build_bronze(parsed, last_time(spark, sf)).select(
        p["event_id"].cast("long").alias("event_id"), p["ingestion_id"].alias("ingestion_id"), "event_time",
        *[p[c].alias(c) for c in ("k", "source_type", "topic", "raw", "timestamp")]))


# ---------------------------------------------------------------- bronze files

def _written(spark, sf):
    """A month of thin sources: one directory a day, not one an hour."""
    path = fresh_path(spark, "bronze")
    ly.write_bronze(lower_columns(v.bronze(spark, sf)), path, partitions=("ingestion_id", "date"))
    return path


@query("bronze_roundtrip", f"""WITH {v.BRONZE} SELECT CAST(event_id AS DOUBLE) AS event_id, ingestion_id, ts AS timestamp, sensor_id, temp, humidity,
  CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour FROM ev""")
def _(spark, sf):
    df = ly.read_bronze(spark, _written(spark, sf))
    return df.select("event_id", "ingestion_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "sensor_id",
                     "temp", "humidity", "date", F.col("hour").cast("int").alias("hour"))


@query("bronze_scan", f"""WITH {v.BRONZE} SELECT CAST(event_id AS DOUBLE) AS event_id, temp FROM ev
  WHERE ingestion_id = 'src_click' AND CAST(ts AS DATE) = DATE '2024-01-15' AND hour(ts) = 7""")
def _(spark, sf):
    return ly.read_bronze(spark, _written(spark, sf), "src_click", "2024-01-15", 7).select("event_id", "temp")


@query("layer_scan", f"""WITH {v.ENRICHED} SELECT ingestion_id, ts AS event_time, temperature FROM en WHERE ts >= TIMESTAMP '2024-01-20'""")
def _(spark, sf):
    path = fresh_path(spark, "silver")
    missing = ly.read_layer(spark, path, ENRICHED)
    v.enriched(spark, sf).drop("event_id").write.parquet(path)
    df = missing.unionByName(ly.read_layer(spark, path, ENRICHED)).where("event_time >= timestamp'2024-01-20'")
    return v.ntz(df.select("ingestion_id", "event_time", F.col("normalized_data")["temperature"].alias("temperature")))


@query("retention", f"""WITH {v.BRONZE}, {v.DEVICES_SQL}, a AS (SELECT CAST(max(ts) AS DATE) AS today FROM events)
  SELECT event_id, ev.ingestion_id FROM ev LEFT JOIN devices d ON lower(trim(d.ingestion_id)) = ev.ingestion_id, a
  WHERE CAST(ts AS DATE) >= today - coalesce(retention_days, 7)""")
def _(spark, sf):
    return ly.apply_retention(v.bronze(spark, sf), "bronze", last_time(spark, sf), devices=v.devices(spark)) \
        .select("event_id", "ingestion_id")


@query("retention_enforced", f"""WITH {v.BRONZE}, {v.DEVICES_SQL}, a AS (SELECT CAST(max(ts) AS DATE) AS today FROM events)
  SELECT ev.ingestion_id, CAST(ts AS DATE) AS date, CAST(count(*) AS BIGINT) AS readings
  FROM ev LEFT JOIN devices d ON lower(trim(d.ingestion_id)) = ev.ingestion_id, a
  WHERE CAST(ts AS DATE) >= today - coalesce(retention_days, 7) GROUP BY ALL""")
def _(spark, sf):
    # day folders of the bronze table are dropped; what is left is counted
    path = fresh_path(spark, "bronze")
    ly.write_bronze(v.bronze(spark, sf).drop("event_id"), path, partitions=("ingestion_id", "date"))
    ly.enforce_retention(spark, path, "bronze", last_time(spark, sf), v.devices(spark))
    return spark.read.parquet(path).groupBy("ingestion_id", "date").agg(F.count("*").alias("readings"))


@query("retention_rewritten", f"""WITH {v.BRONZE}, {v.DEVICES_SQL}, a AS (SELECT CAST(max(ts) AS DATE) AS today FROM events)
  SELECT ev.ingestion_id, CAST(count(*) AS BIGINT) AS readings, min(ts) AS oldest
  FROM ev LEFT JOIN devices d ON lower(trim(d.ingestion_id)) = ev.ingestion_id, a
  WHERE CAST(ts AS DATE) >= today - coalesce(retention_days, 7) GROUP BY ALL""")
def _(spark, sf):
    # sources without day folders: only those with expired readings are written again
    path = fresh_path(spark, "bronze")
    v.bronze(spark, sf).select("ingestion_id", F.col("timestamp").cast("timestamp").alias("timestamp")) \
        .write.partitionBy("ingestion_id").parquet(path)
    ly.rewrite_retention(spark.read.parquet(path), path, "bronze", last_time(spark, sf), devices=v.devices(spark))
    return v.ntz(spark.read.parquet(path).groupBy("ingestion_id").agg(F.count("*").alias("readings"), F.min("timestamp").alias("oldest")))


@query("retention_text_times", """WITH t AS (SELECT event_id, ts, (SELECT CAST(max(ts) AS DATE) FROM events) AS today FROM events)
  SELECT event_id FROM t WHERE event_id % 4 = 3 OR CAST(ts AS DATE) >= today - 7""")
def _(spark, sf):
    text = F.col("ts").cast("string")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    rows = v.table(spark, sf, "events").select("event_id", F.lit("any").alias("ingestion_id"), F.when(F.col("event_id") % 4 == 3, "bad")
                                               .when(F.col("event_id") % 4 == 2, epoch).otherwise(text).alias("timestamp"))
    return ly.apply_retention(rows, "bronze", last_time(spark, sf)).select("event_id")


@query("expired_partitions", f"""WITH {v.BRONZE} SELECT DISTINCT ingestion_id, CAST(ts AS DATE) AS date FROM ev
  WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM events) - 7""")
def _(spark, sf):
    return ly.expired_partitions(v.bronze(spark, sf), "bronze", last_time(spark, sf), "timestamp")


@query("file_inventory")
def _(spark, sf):
    return fl.file_inventory(spark, sf, min_size=1000, suffix="parquet", sort_by="size", order="desc")


@query("file_size_classes")
def _(spark, sf):
    return fl.size_classes(fl.list_files(spark, sf))


@query("sample_latest")
def _(spark, sf):
    return fl.sample_latest_files(spark, _written(spark, sf))


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def _(spark, sf):
    return fl.preview(v.table(spark, sf, "orders").orderBy("o_orderkey"), 50)[1]


# ---------------------------------------------------------------- sensor archive

_KEYS = sorted("/".join(row[:3]) for row in sc.UNITS) + [
    "audio/mic/octave", "metsense/bmp180/id", "nc/net/rx", "chemsense/co/voltage"]
_KEY_ROWS = ", ".join(f"({i}, '{k.split('/')[0]}', '{k.split('/')[1]}', '{k.split('/')[2]}')" for i, k in enumerate(_KEYS))
_UNIT_ROWS = ", ".join(map(str, sc.UNITS))
_TOPIC_ROWS = ", ".join(map(str, sc.TOPICS))
_SLICE = f"""keys(i, subsystem, sensor, parameter) AS (VALUES {_KEY_ROWS}), units(subsystem, sensor, parameter, unit) AS (VALUES {_UNIT_ROWS}),
  topics(parameter, topic) AS (VALUES {_TOPIC_ROWS}), slice AS (
  SELECT coalesce(topic, 'smartcity/sensors/aot_' || parameter) AS topic, 'aot_node' || user_id || '_' || sensor AS sensor_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || 'Z' AS timestamp, 'node' || user_id AS node_id, subsystem, sensor, parameter,
    CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value, coalesce(unit, '') AS unit
  FROM events JOIN keys ON i = event_id % {len(_KEYS)} LEFT JOIN units USING (subsystem, sensor, parameter) LEFT JOIN topics USING (parameter)
  WHERE subsystem <> 'nc' AND parameter <> 'id')"""


def _archive(spark, sf):
    """Events as a compressed sensor archive, with two kinds of rows that do not count."""
    keys = spark.createDataFrame([(i, *k.split("/")) for i, k in enumerate(_KEYS)], "i long, subsystem string, sensor string, parameter string")
    rows = v.table(spark, sf, "events").withColumn("i", F.col("event_id") % len(_KEYS)).join(keys, "i").select(
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("node"), F.col("user_id").cast("string")).alias("node_id"),
        "subsystem", "sensor", "parameter", F.col("event_id").cast("string").alias("value_raw"),
        F.when(F.col("event_id") % 3 == 0, "NA").otherwise(F.col("value").cast("string")).alias("value_hrf"))
    path = fresh_path(spark, "archive")
    rows.write.csv(path, header=True, compression="gzip")
    return sc.read_sensor_csv(spark, path)


@query("sensor_slice", f"WITH {_SLICE} SELECT * FROM slice")
def _(spark, sf):
    return sc.sensor_slice(_archive(spark, sf)).drop("value_raw", "value_hrf")


@query("sensor_slice_stats", f"""WITH {_SLICE} SELECT topic, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT sensor) AS BIGINT) AS sensors,
  CAST(count(DISTINCT subsystem) AS BIGINT) AS subsystems, CAST(count(DISTINCT node_id) AS BIGINT) AS nodes FROM slice GROUP BY 1""")
def _(spark, sf):
    return sc.sensor_slice_stats(sc.sensor_slice(_archive(spark, sf)))
