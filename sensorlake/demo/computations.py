"""User-written computations, their examples, sensitivity and access."""

from pyspark.sql import functions as F

from ..operators import access
from ..operators.quality import readings_long
from ..plans.compute import EXAMPLES, compute
from . import views as v
from .registry import query


def _all(definition, df, dataset=None, **more):
    """Every row of the answer: these queries are not top-k reports."""
    return v.ntz(compute(definition, df, dataset, default_limit=None, **more))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("registered_hourly_average", f"""WITH {v.ENRICHED}, {v.DEVICES_SQL}
  SELECT sensor_id AS "sensorId", {v.HOUR} AS time_start, {v.MEAN.format('temperature')} AS avg_temp, min(ts) AS min_enrichment_ts
  FROM en WHERE temperature IS NOT NULL AND lower(trim(ingestion_id)) IN
    (SELECT lower(trim(ingestion_id)) FROM devices WHERE enabled AND ingestion_id <> 'unknown') GROUP BY ALL""")
def _(spark, sf):
    from ..operators.devices import registered_only
    from ..plans.gold import windowed_average
    return v.ntz(windowed_average(registered_only(v.enriched(spark, sf), v.devices(spark)), window="1 hour"))


@query("dsl_alias", f"""WITH {v.AVERAGES} SELECT date_trunc('day', time_start) AS day, max(avg_temp) AS hottest,
    CAST(count(*) AS BIGINT) AS n FROM gold WHERE avg_temp > 20 GROUP BY 1""")
def _(spark, sf):
    return _all({"select": ["window(timestamp, '1 day').start as day", "MAX(temperature) as hottest", "COUNT(*) as n"],
                 "where": [{"col": "temperature", "op": ">", "value": 20}],
                 "groupBy": ["window(ts, '1 day')"], "orderBy": [{"col": "day"}]},
                v.hourly_averages(spark, sf), "silver")


@query("dsl_where", f"""WITH {v.ENRICHED} SELECT event_id, ingestion_id FROM en
  WHERE temperature >= 30 AND humidity < 50 AND ingestion_id <> 'src_view' AND CAST(ts AS DATE) <= DATE '2024-01-20'""")
def _(spark, sf):
    return _all({"select": ["event_id", "ingestion_id"],
                 "where": [{"col": "normalized_data.temperature", "op": ">=", "value": "30.0"},
                           {"col": "normalized_data.humidity", "op": "<", "value": 50},
                           {"col": "ingestion_id", "op": "!=", "value": "src_view"},
                           {"col": "ingest_date", "op": "<=", "value": "2024-01-20"}]}, v.enriched(spark, sf))


@query("dsl_contains", f"WITH {v.ALERT_MESSAGES} SELECT id, message FROM alerts WHERE contains(message, 'overheat') AND level = 'critical'")
def _(spark, sf):
    return _all({"select": ["id", "message"], "where": [{"col": "message", "op": "contains", "value": "overheat"},
                                                        {"col": "level", "op": "==", "value": "critical"}]},
                v.alert_messages(spark, sf), "alerts")


@query("dsl_nulls", f"WITH {v.ENRICHED} SELECT event_id, error_level FROM en WHERE temperature IS NULL AND error_level IS NOT NULL")
def _(spark, sf):
    return _all({"select": ["event_id", "normalized_data.error_level"],
                 "where": [{"col": "normalized_data.temperature", "op": "IS NULL"},
                           {"col": "normalized_data.error_level", "op": "is not null"}]}, v.enriched(spark, sf))


@query("dsl_select", f"""WITH {v.ENRICHED} SELECT event_id, sensor_id AS "sensorId", temperature AS latest_temp, humidity,
  CAST(ts AS DATE) AS ingest_date FROM en""")
def _(spark, sf):
    return _all({"select": ["event_id", "sensor_data.sensorId", "normalized_data.temperature as latest_temp",
                            "normalized_data.humidity", "ingest_date"]}, v.enriched(spark, sf))


@query("dsl_groupby", f"""WITH {v.ENRICHED} SELECT CAST(ts AS DATE) AS ingest_date, ingestion_id AS source_id, CAST(count(*) AS BIGINT) AS reading_count
  FROM en GROUP BY ALL""")
def _(spark, sf):
    return _all({"select": ["ingest_date", "ingestion_id as source_id", "COUNT(*)"],
                 "groupBy": ["ingest_date", "ingestion_id"]}, v.enriched(spark, sf))


@query("dsl_group_first", f"""WITH {v.ENRICHED} SELECT ingestion_id, arg_min(sensor_id, event_id) AS "sensorId",
  arg_max(temp, event_id) AS last_temp FROM en GROUP BY 1""")
def _(spark, sf):
    return _all({"select": ["ingestion_id", "sensor_data.sensorId", "last(normalized_data.temp)"],
                 "groupBy": ["ingestion_id"]}, v.enriched(spark, sf), order_key="event_id")


@query("dsl_aggregates", f"""WITH {v.ENRICHED} SELECT ingestion_id, CAST(count(*) AS BIGINT) AS reading_count,
  CAST(count(temperature) AS BIGINT) AS count_temperature, round(avg(temperature), 9) AS avg_temperature, min(humidity) AS min_humidity,
  max(humidity) AS max_humidity, sum(humidity) AS total FROM en GROUP BY 1""")
def _(spark, sf):
    return _rounded(_all({"select": ["ingestion_id", "COUNT(*)", "count(normalized_data.temperature)", "AVG(normalized_data.temperature)",
                                     "MIN(normalized_data.humidity)", "max(normalized_data.humidity)",
                                     "SUM(normalized_data.humidity) as total"],
                          "groupBy": ["ingestion_id"]}, v.enriched(spark, sf)), "avg_temperature")


@query("dsl_window", f"""WITH {v.ENRICHED}, slides AS (SELECT unnest([0, 15, 30, 45]) AS back), w AS (
    SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') - to_minutes(back) AS time_start, en.* FROM en CROSS JOIN slides)
  SELECT time_start, time_start + INTERVAL '1 hour' AS time_end, max(temperature) AS max_temperature, CAST(count(*) AS BIGINT) AS reading_count
  FROM w GROUP BY ALL""")
def _(spark, sf):
    w = "window(ingest_ts, '1 hour', '15 minutes')"
    return _all({"select": [f"{w}.start", f"{w}.end", "MAX(normalized_data.temperature)", "COUNT(*)"], "groupBy": [w]},
                v.enriched(spark, sf))


@query("dsl_orderby", f"""WITH {v.ENRICHED} SELECT ingestion_id, event_id, CAST(row_number() OVER (ORDER BY ingestion_id, event_id DESC) AS BIGINT) AS place
  FROM en QUALIFY place <= 500""")
def _(spark, sf):
    df = compute({"select": ["ingestion_id", "event_id"], "limit": 500,
                  "orderBy": [{"col": "ingestion_id"}, {"col": "event_id", "dir": "DESC"}]}, v.enriched(spark, sf))
    # a 500-row report: number its rows as they come
    from pyspark.sql import Window as W
    return df.withColumn("place", F.row_number().over(W.orderBy("ingestion_id", F.desc("event_id"))).cast("long"))


@query("dsl_window_unselected_order", f"""WITH {v.ENRICHED} SELECT ingestion_id, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') AS minute
  FROM en ORDER BY event_id LIMIT 200""")
def _(spark, sf):
    return v.ntz(compute({"select": ["ingestion_id", "window(ingest_ts, '1 minute').start as minute"], "limit": 200,
                          "orderBy": [{"col": "event_id"}]}, v.enriched(spark, sf)))


@query("dsl_topk", f"WITH {v.ENRICHED} SELECT event_id, temperature FROM en ORDER BY temperature DESC NULLS LAST, event_id LIMIT 100")
def _(spark, sf):
    return compute({"select": ["event_id", "normalized_data.temperature"], "limit": 100,
                    "orderBy": [{"col": "temperature", "dir": "desc"}, {"col": "event_id"}]},
                   v.enriched(spark, sf).withColumn("temperature", F.col("normalized_data")["temperature"]))


@query("dsl_global_agg", f"""WITH {v.ENRICHED} SELECT CAST(count(*) AS BIGINT) AS reading_count, max(temperature) AS max_temperature,
  round(avg(humidity), 9) AS avg_humidity FROM en""")
def _(spark, sf):
    return _rounded(compute({"select": ["COUNT(*)", "MAX(normalized_data.temperature)", "AVG(normalized_data.humidity)"]},
                            v.enriched(spark, sf)), "avg_humidity")


# ---------------------------------------------------------------- the shipped examples

def _example(name, df, *tie_break):
    """An example with a unique tie-break, so that its top-k is one fixed set of rows."""
    dataset, definition = EXAMPLES[name]
    definition = {**definition, "orderBy": definition["orderBy"] + [{"col": c} for c in tie_break]}
    return v.ntz(compute(definition, df, dataset))


@query("ex_hot_temps", f"""WITH {v.AVERAGES} SELECT "sensorId", avg_temp, time_start FROM gold WHERE avg_temp > 25
  ORDER BY avg_temp DESC, "sensorId", time_start LIMIT 50""")
def _(spark, sf):
    return _example("hot-temps", v.hourly_averages(spark, sf), "sensorId", "time_start")


@query("ex_sensor_summary", f"""WITH {v.ENRICHED} SELECT ingestion_id, sensor_id, temperature AS latest_temp, humidity AS latest_humidity,
  CAST(ts AS DATE) AS ingest_date, 'mqtt' AS source FROM en WHERE CAST(ts AS DATE) >= DATE '2024-01-10' ORDER BY ts DESC, event_id LIMIT 100""")
def _(spark, sf):
    dataset, definition = EXAMPLES["sensor-summary-table"]
    definition = {**definition, "where": [{"col": "ingest_date", "op": ">=", "value": "2024-01-10"}],
                  "orderBy": definition["orderBy"] + [{"col": "event_id"}]}
    return compute(definition, v.enriched(spark, sf), dataset)


@query("ex_daily_summary", f"""WITH {v.ENRICHED} SELECT CAST(ts AS DATE) AS ingest_date, ingestion_id, CAST(count(*) AS BIGINT) AS reading_count,
    round(avg(temperature), 9) AS avg_temperature, min(temperature) AS min_temperature, max(temperature) AS max_temperature,
    round(avg(humidity), 9) AS avg_humidity
  FROM en WHERE temperature IS NOT NULL GROUP BY ALL ORDER BY ingest_date DESC, reading_count DESC, ingestion_id LIMIT 50""")
def _(spark, sf):
    return _rounded(_example("daily-readings-summary", v.enriched(spark, sf), "ingestion_id"), "avg_temperature", "avg_humidity")


@query("ex_alert_keyword", f"""WITH {v.ALERT_MESSAGES} SELECT id, level, message, ts FROM alerts WHERE contains(message, 'overheat')
  ORDER BY ts DESC, id LIMIT 20""")
def _(spark, sf):
    return _example("alerts-keyword", v.alert_messages(spark, sf), "id")


@query("ex_below_zero", f"""WITH {v.ENRICHED} SELECT event_id, ingestion_id, 'temperature' AS metric, temperature - 100 AS value, ts FROM en
  WHERE temperature - 100 < 0 ORDER BY ts DESC, event_id LIMIT 100""")
def _(spark, sf):
    frost = readings_long(v.enriched(spark, sf), keep=["event_id"]).withColumn("value", F.col("value") - 100)
    return _example("below-zero", frost, "event_id")


@query("ex_window_avg", f"""WITH {v.ENRICHED} SELECT time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') AS time_start,
    time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 minute' AS time_end, round(avg(temperature), 9) AS avg_temperature,
    CAST(count(*) AS BIGINT) AS reading_count, min(temperature) AS min_temperature, max(temperature) AS max_temperature
  FROM en WHERE temperature IS NOT NULL GROUP BY ALL ORDER BY 1 LIMIT 50""")
def _(spark, sf):
    return _rounded(_example("average-temperature", v.enriched(spark, sf)), "avg_temperature")


@query("ex_threshold_throttled", f"""WITH {v.ENRICHED} SELECT ingestion_id AS "sensorId", max(temperature) AS temperature, max(ts) AS event_time,
    time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 minute' AS window_end
  FROM en WHERE temperature > 30 GROUP BY ALL ORDER BY window_start DESC, "sensorId" LIMIT 100""")
def _(spark, sf):
    return _example("temperature-over-threshold", v.enriched(spark, sf), "sensorId")


# ---------------------------------------------------------------- sensitivity and access

_SOURCES = ["src_click", "src_purchase", "src_error", "src_spare", "src_nobody"]


def definitions(spark, sf):
    """Parts as saved computations: a sixth reads every source, the others filter on one."""
    kind = F.col("p_size") % 6
    source = F.get(F.array(*[F.lit(s) for s in _SOURCES]), kind.cast("int"))
    where = F.when(kind < 4, F.concat(F.lit('[{"col": "ingestion_id", "op": "==", "value": "'), source, F.lit('"}]'))) \
        .when(kind == 4, F.lit('[{"col": "SensorId", "op": "==", "value": ["src_nobody", "src_click"]}]')).otherwise("[]")
    return v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.concat(F.lit('{"select": ["ingestion_id"], "where": '), where, F.lit("}")).alias("definition"))


_SENSITIVITY = f"""{v.DEVICES_SQL}, level(sensitivity, rank) AS (VALUES ('public', 0), ('internal', 1), ('confidential', 2), ('restricted', 3)),
  refs AS (SELECT p_partkey AS id, p_name AS name, unnest(CASE p_size % 6 WHEN 0 THEN ['src_click'] WHEN 1 THEN ['src_purchase'] WHEN 2 THEN ['src_error']
      WHEN 3 THEN ['src_spare'] WHEN 4 THEN ['src_nobody', 'src_click'] ELSE [NULL] END) AS ref FROM part),
  overall AS (SELECT max(rank) AS rank, count(*) AS n FROM devices JOIN level USING (sensitivity) WHERE enabled),
  ranked AS (SELECT refs.id, refs.name, CASE WHEN bool_or(ref IS NULL) THEN (SELECT rank FROM overall) ELSE coalesce(max(l.rank), 0) END AS rank,
      CASE WHEN bool_or(ref IS NULL) THEN (SELECT n FROM overall) ELSE count(d.ingestion_id) END AS n_devices
    FROM refs LEFT JOIN devices d ON d.ingestion_id = refs.ref LEFT JOIN level l USING (sensitivity) GROUP BY ALL)"""


@query("sensitivity", f"""WITH {_SENSITIVITY} SELECT id, sensitivity, CAST(n_devices AS BIGINT) AS n_devices FROM ranked JOIN level USING (rank)""")
def _(spark, sf):
    return access.computation_sensitivity(definitions(spark, sf), v.devices(spark)).select("id", "sensitivity", "n_devices")


@query("access_filter", f"""WITH {_SENSITIVITY}, users(username, top) AS (VALUES ('ann', 0), ('bob', 1), ('eve', 3), ('zed', 0))
  SELECT username, id, sensitivity, rank > top AS access_restricted FROM ranked JOIN level USING (rank)
    JOIN users ON username = ['ann', 'bob', 'eve', 'zed'][1 + id % 4]""")
def _(spark, sf):
    roles = spark.createDataFrame([("ann", "viewer"), ("bob", "viewer"), ("bob", "User"), ("eve", "admin"), ("zed", "guest")],
                                  "username string, role string")
    tiles = access.computation_sensitivity(definitions(spark, sf), v.devices(spark)).withColumn(
        "username", F.get(F.array(*[F.lit(u) for u in ("ann", "bob", "eve", "zed")]), (F.col("id") % 4).cast("int")))
    return access.access_filter(tiles, roles).select("username", "id", "sensitivity", "access_restricted")


@query("readable_rows", f"WITH {v.ENRICHED}, {v.DEVICES_SQL} SELECT event_id FROM en JOIN devices d USING (ingestion_id) WHERE d.sensitivity IN ('public', 'internal')")
def _(spark, sf):
    labelled = v.enriched(spark, sf).join(v.devices(spark).select("ingestion_id", "sensitivity"), "ingestion_id")
    return access.readable(labelled, ["user", "viewer"]).select("event_id")
