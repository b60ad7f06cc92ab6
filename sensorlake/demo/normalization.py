"""Layout, renaming, rules, device filter, what-if previews."""

from pyspark.sql import functions as F

from ..functions import as_text, extract_field, numeric_or_null, parse_timestamp, sensor_id, valid_reading
from ..operators import devices as dev
from ..operators import normalize as nz
from ..operators import wide
from . import views as v
from .registry import query


def _entries(df):
    """One row per map entry: text from ``sensor_data``, number from ``normalized_data``."""
    keys = F.map_keys("sensor_data")
    return v.ntz(df.select("event_id", "ingestion_id", "timestamp", "sensor_data", "normalized_data",
                           F.explode(F.array_union(keys, F.map_keys("normalized_data"))).alias("key"))
                 .select("event_id", "ingestion_id", "timestamp", "key",
                         F.col("sensor_data")[F.col("key")].alias("text"),
                         F.col("normalized_data")[F.col("key")].alias("number")))


_RAW_ENTRIES = """
  SELECT event_id, ingestion_id, ts AS timestamp, 'sensor_id' AS key, sensor_id AS text, CAST(NULL AS DOUBLE) AS number FROM ev
  UNION ALL SELECT event_id, ingestion_id, ts, 'temp', CAST(temp AS VARCHAR), temp FROM ev
  UNION ALL SELECT event_id, ingestion_id, ts, 'humidity', CAST(humidity AS VARCHAR), humidity FROM ev
  UNION ALL SELECT event_id, ingestion_id, ts, 'source_type', 'mqtt', NULL FROM ev"""


@query("lower_columns", f"WITH {v.BRONZE} SELECT event_id, ingestion_id, ts AS timestamp, sensor_id, temp, "
                        "humidity, 'mqtt' AS source_type FROM ev")
def _(spark, sf):
    df = nz.lower_columns(v.bronze(spark, sf).withColumn("Sensor_ID2", F.lit(0))).drop("sensor_id2")
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("normalize_columns", f"""WITH {v.BRONZE}
  SELECT event_id, ingestion_id, sensor_id AS "sensorId",
         coalesce(CASE WHEN humidity >= 50 THEN temp END, temp * 2) AS temperature, humidity FROM ev""")
def _(spark, sf):
    df = v.bronze(spark, sf).select(
        "event_id", "ingestion_id", "sensor_id", F.when(F.col("HUMIDITY") >= 50, F.col("Temp")).alias("TEMP"),
        (F.col("Temp") * 2).alias("Temperature"), "HUMIDITY")
    return nz.normalize_columns(df, {"sensor_id": "sensorId", "temp": "temperature"})


@query("to_union", f"WITH {v.BRONZE} {_RAW_ENTRIES}")
def _(spark, sf):
    return _entries(v.union(spark, sf))


@query("to_union_fixed", f"WITH {v.BRONZE} {_RAW_ENTRIES}")
def _(spark, sf):
    return _entries(nz.to_union_fixed(nz.lower_columns(v.bronze(spark, sf)), keep=["event_id"]))


_DIRTY = """dirty AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '+5' WHEN 1 THEN '5.' WHEN 2 THEN '1e3'
    WHEN 3 THEN 'NaN' WHEN 4 THEN ' 5' WHEN 5 THEN '-.5' WHEN 6 THEN 'abc'
    ELSE CAST(value AS VARCHAR) END AS raw FROM events)"""


def dirty(spark, sf):
    """Readings as the text real sensors send, good and bad."""
    kinds = ["+5", "5.", "1e3", "NaN", " 5", "-.5", "abc"]
    text = F.col("value").cast("string")
    for i, kind in enumerate(kinds):
        text = F.when(F.col("event_id") % 8 == i, kind).otherwise(text)
    return v.table(spark, sf, "events").select("event_id", text.alias("raw"))


@query("numeric_or_null", rf"""WITH {_DIRTY} SELECT event_id, raw,
  CASE WHEN regexp_full_match(raw, '-?\d*\.?\d+([eE][-+]?\d+)?') THEN TRY_CAST(raw AS DOUBLE) END AS number FROM dirty""")
def _(spark, sf):
    return dirty(spark, sf).withColumn("number", numeric_or_null(F.col("raw")))


def timestamp_texts(spark, sf):
    """The same instant written in the ways sources write it."""
    ts, kind = F.col("ts"), F.col("event_id") % 5
    text = (F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(kind == 3, F.unix_seconds(ts.cast("timestamp")).cast("string"))
            .otherwise("bad"))
    return v.table(spark, sf, "events").select("event_id", "ts", text.alias("text"))


def last_time(spark, sf):
    """Latest event time of the table, as a scalar: 'now' for reproducible results."""
    return v.table(spark, sf, "events").agg(F.max("ts")).scalar()


@query("parse_timestamp", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts
    WHEN 2 THEN date_trunc('second', ts) ELSE (SELECT max(ts) FROM events) END AS parsed FROM events""")
def _(spark, sf):
    return v.ntz(timestamp_texts(spark, sf).select(
        "event_id", parse_timestamp(F.col("text"), last_time(spark, sf)).alias("parsed")))


_NORMAL_ENTRIES = """
  SELECT event_id, ingestion_id, ts AS timestamp, 'sensor_id' AS key, sensor_id AS text, CAST(NULL AS DOUBLE) AS number FROM en
  UNION ALL SELECT event_id, ingestion_id, ts, 'sensorId', sensor_id, NULL FROM en
  UNION ALL SELECT event_id, ingestion_id, ts, 'temp', CAST(temp AS VARCHAR), temp FROM en
  UNION ALL SELECT event_id, ingestion_id, ts, CASE WHEN ingestion_id = 'src_error' THEN 'error_level' ELSE 'temperature' END, CAST(temp AS VARCHAR), temp FROM en
  UNION ALL SELECT event_id, ingestion_id, ts, 'humidity', CAST(humidity AS VARCHAR), humidity FROM en
  UNION ALL SELECT event_id, ingestion_id, ts, 'source_type', 'mqtt', NULL FROM en"""


@query("normalize_union", f"WITH {v.ENRICHED} {_NORMAL_ENTRIES}")
def _(spark, sf):
    return _entries(nz.normalize_union(v.union(spark, sf), v.rules(spark)))


@query("to_union_with_rules", f"WITH {v.ENRICHED} {_NORMAL_ENTRIES}")
def _(spark, sf):
    return _entries(v.normalized(spark, sf))


@query("normalize_union_joined", f"WITH {v.ENRICHED} {_NORMAL_ENTRIES}")
def _(spark, sf):
    return _entries(nz.normalize_union(v.union(spark, sf), v.rules(spark), max_inline=0))


@query("extract_field", f"""WITH {v.ENRICHED} SELECT event_id, temperature, CAST(temp AS VARCHAR) AS temp_text,
  CAST(NULL AS DOUBLE) AS sensor_number FROM en""")
def _(spark, sf):
    return v.normalized(spark, sf).select("event_id", extract_field("temperature").alias("temperature"),
                                          as_text("temp").alias("temp_text"),
                                          extract_field("sensor_id").alias("sensor_number"))


@query("from_union", f"""WITH {v.ENRICHED} SELECT ingestion_id, ts AS timestamp, temperature, error_level, humidity,
  temp FROM en""")
def _(spark, sf):
    return v.ntz(nz.from_union(v.normalized(spark, sf)).drop("sensor_id", "sensorId", "source_type"))


@query("extract_all", f"""WITH {v.ENRICHED} SELECT event_id, ingestion_id, ts AS timestamp, sensor_id,
  CAST(temp AS VARCHAR) AS temp, CAST(humidity AS VARCHAR) AS humidity, 'mqtt' AS source_type FROM en""")
def _(spark, sf):
    df = nz.extract_all(v.union(spark, sf), prefer_normalized=False)
    return v.ntz(df.drop("sensor_data", "normalized_data"))


@query("field_object", f"""WITH {v.ENRICHED} SELECT event_id, ingestion_id, ts AS timestamp, temperature, error_level, humidity, temp,
  sensor_id AS "sensorId" FROM en""")
def _(spark, sf):
    df = wide.field_object(v.normalized(spark, sf))
    return v.ntz(df.select("event_id", "ingestion_id", "timestamp", *[
        wide.field_value(n).alias(n) for n in ("temperature", "error_level", "humidity", "temp")],
        wide.field_value("sensorId", "string").alias("sensorId")))


@query("field_dictionary", """SELECT 'part_' || l_partkey AS field, CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 'string' ELSE 'double' END AS type,
  CAST(count(*) AS BIGINT) AS uses, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY l_partkey""")
def _(spark, sf):
    # a field of its own for every part: names that nobody knows beforehand, as many as there are parts
    field = F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))
    number = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity").cast("double"))
    items = v.table(spark, sf, "lineitem").select("l_shipdate", F.create_map(field, F.col("l_returnflag")).alias("sensor_data"),
                                                  F.create_map(field, number).alias("normalized_data"))
    return wide.field_dictionary(wide.field_object(items), F.col("l_shipdate"))


@query("available_fields", """SELECT unnest(['sensor_id', 'sensorId', 'temp', 'temperature', 'error_level',
  'humidity', 'source_type']) AS field""")
def _(spark, sf):
    return nz.available_fields(v.normalized(spark, sf))


@query("merge_sensor_data", f"""WITH {v.BRONZE} {_RAW_ENTRIES.replace("'source_type', 'mqtt'", "'source_type', 'rest'")}
  UNION ALL SELECT event_id, ingestion_id, ts, 'floor', '3', NULL FROM ev""")
def _(spark, sf):
    return _entries(nz.merge_sensor_data(v.union(spark, sf), {"floor": 3, "source_type": "rest"}))


@query("enrichment_metadata", f"""WITH {v.ENRICHED} SELECT event_id, ts AS event_time, ts AS ingest_ts,
  CAST(ts AS DATE) AS ingest_date, strftime(ts, '%H') AS ingest_hour, 'mqtt' AS source, 'default' AS site FROM en""")
def _(spark, sf):
    return v.ntz(v.enriched(spark, sf).select("event_id", "event_time", "ingest_ts", "ingest_date",
                                              "ingest_hour", "source", "site"))


@query("extract_sensor_id", f"""WITH {v.ENRICHED} SELECT event_id, sensor_id AS "sensorId",
  CASE WHEN humidity < 50 THEN ingestion_id ELSE sensor_id END AS with_fallback,
  CASE WHEN humidity < 50 THEN 'unknown' ELSE sensor_id END AS without_fallback FROM en""")
def _(spark, sf):
    df = v.normalized(spark, sf).withColumn("sensorId", sensor_id())
    anonymous = F.map_filter("sensor_data", lambda k, _: ~F.lower(k).startswith("sensor"))
    low = F.col("normalized_data")["humidity"] < 50
    return df.withColumn("sensor_data", F.when(low, anonymous).otherwise(F.col("sensor_data"))).select(
        "event_id", "sensorId", sensor_id().alias("with_fallback"),
        sensor_id(fallback=False).alias("without_fallback"))


@query("valid_reading", f"WITH {v.ENRICHED} SELECT event_id, temperature FROM en WHERE temperature IS NOT NULL")
def _(spark, sf):
    df = v.normalized(spark, sf).select("event_id", extract_field("temperature").alias("temperature"))
    # readings of faulty sensors arrive as NaN, which must not count either
    faulty = df.where("temperature is null").withColumn("temperature", F.lit(float("nan")))
    return df.unionByName(faulty).where(valid_reading(F.col("temperature")))


_RESOLVED = """keys AS (SELECT DISTINCT ingestion_id, unnest(['sensor_id', 'temp', 'humidity', 'source_type']) AS raw_key FROM ev),
  resolved AS (SELECT k.ingestion_id, k.raw_key, r.canonical_key, r.id AS rule_id
    FROM keys k JOIN rules r ON r.raw_key = k.raw_key AND r.enabled
      AND (r.ingestion_id IS NULL OR r.ingestion_id = k.ingestion_id)
    QUALIFY row_number() OVER (PARTITION BY k.ingestion_id, k.raw_key ORDER BY r.ingestion_id IS NULL, r.id) = 1)"""


@query("resolve_rules", f"""WITH {v.BRONZE}, {v.RULES_SQL}, {_RESOLVED}
  SELECT ingestion_id, raw_key, canonical_key, CAST(rule_id AS BIGINT) AS rule_id FROM resolved""")
def _(spark, sf):
    return nz.resolve_rules(v.rules(spark), nz.field_keys(v.union(spark, sf))) \
        .select("ingestion_id", "raw_key", "canonical_key", "rule_id")


@query("rule_usage", f"""WITH {v.BRONZE}, {v.RULES_SQL}, {_RESOLVED}
  SELECT CAST(rule_id AS BIGINT) AS rule_id, raw_key, canonical_key, CAST(count(*) AS BIGINT) AS applied_count,
         max(ts) AS last_applied_at
  FROM resolved JOIN ev USING (ingestion_id) GROUP BY ALL""")
def _(spark, sf):
    return v.ntz(nz.rule_usage(v.union(spark, sf), v.rules(spark)))


@query("seed_rules", """WITH defaults(raw_key, canonical_key) AS (VALUES ('sensorid', 'sensorId'), ('sensor_id', 'sensorId'),
    ('sensor-id', 'sensorId'), ('temperature', 'temperature'), ('humidity', 'humidity'), ('timestamp', 'timestamp'),
    ('time', 'timestamp'), ('ts', 'timestamp'))
  SELECT raw_key, canonical_key FROM defaults
  WHERE raw_key NOT IN (SELECT unnest(['sensor_id', 'temp', 'humidity', 'source_type']) FROM (SELECT count(*) FROM events))""")
def _(spark, sf):
    # the rules so far: one per field the sources have sent
    fields = nz.field_keys(v.union(spark, sf)).select(F.upper("raw_key").alias("raw_key")).distinct()
    return nz.seed_rules(fields)


# ---------------------------------------------------------------- devices

_ALLOWED = """allowed AS (SELECT DISTINCT lower(trim(ingestion_id)) AS id FROM devices
    WHERE enabled AND lower(trim(ingestion_id)) NOT IN ('', 'unknown'))"""


@query("registered_only", f"""WITH {v.BRONZE}, {v.DEVICES_SQL}, {_ALLOWED}
  SELECT event_id, ingestion_id FROM ev WHERE lower(trim(ingestion_id)) IN (SELECT id FROM allowed)""")
def _(spark, sf):
    return dev.registered_only(v.union(spark, sf), v.devices(spark)).select("event_id", "ingestion_id")


@query("diagnose_sensors", f"""WITH {v.BRONZE} SELECT ingestion_id, CAST(count(*) AS BIGINT) AS readings,
  CAST(count(DISTINCT sensor_id) AS BIGINT) AS sensors FROM ev GROUP BY 1""")
def _(spark, sf):
    return dev.sensors_per_source(v.union(spark, sf))


@query("diagnose_unregistered", f"""WITH {v.BRONZE}, {v.DEVICES_SQL} SELECT ingestion_id, CAST(count(*) AS BIGINT) AS readings
  FROM ev WHERE ingestion_id NOT IN (SELECT ingestion_id FROM devices WHERE enabled) GROUP BY 1""")
def _(spark, sf):
    return dev.unregistered_sources(v.union(spark, sf), v.devices(spark))


@query("diagnose_unseen", f"""WITH {v.BRONZE}, {v.DEVICES_SQL} SELECT DISTINCT ingestion_id FROM devices
  WHERE enabled AND ingestion_id NOT IN (SELECT ingestion_id FROM ev)""")
def _(spark, sf):
    return dev.unseen_devices(v.union(spark, sf), v.devices(spark))


@query("diagnose_registration", f"""WITH {v.BRONZE}, {v.DEVICES_SQL}
  SELECT 'unregistered' AS issue, ingestion_id, CAST(count(*) AS BIGINT) AS n FROM ev
    WHERE ingestion_id NOT IN (SELECT ingestion_id FROM devices WHERE enabled) GROUP BY 2
  UNION ALL SELECT DISTINCT 'unseen', ingestion_id, 0 FROM devices
    WHERE enabled AND ingestion_id NOT IN (SELECT ingestion_id FROM ev)
  UNION ALL SELECT 'several_sensors', ingestion_id, count(DISTINCT sensor_id) FROM ev GROUP BY 2 HAVING count(DISTINCT sensor_id) > 1
  UNION ALL SELECT 'fewer_devices_than_sensors', NULL, n FROM (SELECT count(DISTINCT sensor_id) AS n FROM ev)
    WHERE n > (SELECT count(*) FROM devices WHERE enabled)""")
def _(spark, sf):
    return dev.diagnose_registration(v.union(spark, sf), v.devices(spark))


@query("unlinked_devices", """SELECT s.s_name AS owner, 'unlinked-' || c.c_name AS id,
    '"' || c.c_name || '" is not linked to any building.' AS message, 'warning' AS variant
  FROM customer c JOIN supplier s ON s.s_suppkey = c.c_custkey % (SELECT count(*) FROM supplier)
  WHERE c.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, sf):
    customer, supplier = v.table(spark, sf, "customer"), v.table(spark, sf, "supplier")
    urgent = v.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    owners = supplier.agg(F.count("*")).scalar()
    owned = customer.withColumn("s_suppkey", F.col("c_custkey") % owners).join(supplier, "s_suppkey")
    links = urgent.join(customer, F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.col("c_name").alias("ingestion_id"))
    return dev.unlinked_devices(owned.select(F.col("s_name").alias("owner"),
                                             F.col("c_name").alias("ingestion_id"),
                                             F.col("c_name").alias("name")), links)
