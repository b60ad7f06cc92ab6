"""Newest rows, recent windows, pages, tile examples."""

from pyspark.sql import functions as F

from ..operators import rank as rk
from ..plans.gold import threshold_alerts
from . import views as v
from .normalization import last_time
from .profiling import _MESSAGES, _payload
from .registry import query


@query("latest_per_source", """SELECT event_id, event_type, ts, value FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100""")
def _(spark, sf):
    return rk.latest_per_source(v.table(spark, sf, "events"), "ts", 100, "event_type", ["event_id"]) \
        .select("event_id", "event_type", "ts", "value")


@query("latest_per_source_large", """SELECT event_id, event_type, ts FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1500""")
def _(spark, sf):
    return rk.latest_per_source(v.table(spark, sf, "events"), "ts", 1500, "event_type", ["event_id"]) \
        .select("event_id", "event_type", "ts")


@query("latest_turns", """SELECT conv_id, turn, role, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def _(spark, sf):
    return rk.latest_per_source(v.table(spark, sf, "conversations"), "turn", 3, "conv_id")


@query("topic_analysis", f"""WITH {_MESSAGES}, last10 AS (SELECT *, row_number() OVER (PARTITION BY ingestion_id ORDER BY ts DESC, event_id DESC) AS rn FROM msg QUALIFY rn <= 10)
  SELECT ingestion_id, CAST(count(*) AS BIGINT) AS messages, string_agg(DISTINCT topic, '|') AS topics,
    array_to_string(list_sort(list_distinct(list('sensor_' || user_id))), '|') AS sensor_ids, string_agg(value, '|' ORDER BY rn) FILTER (WHERE rn <= 3) AS samples FROM last10 GROUP BY 1""")
def _(spark, sf):
    out = rk.topic_analysis(_payload(spark, sf), "ts", ["event_id"])
    return out.select("ingestion_id", "messages", *[F.array_join(c, "|").alias(c) for c in ("topics", "sensor_ids", "samples")])


@query("topic_sources", f"WITH {_MESSAGES} SELECT DISTINCT topic, ingestion_id FROM msg")
def _(spark, sf):
    return rk.topic_sources(_payload(spark, sf))


@query("last_n_points", "SELECT event_id, ts, value FROM (SELECT * FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts, event_id")
def _(spark, sf):
    series = v.table(spark, sf, "events").where("event_type = 'view'").select("event_id", "ts", "value")
    return rk.last_n_points(series, "ts", 50, ["event_id"])


@query("recent_averages", f"""WITH {v.AVERAGES} SELECT "sensorId", time_start, avg_temp FROM gold WHERE time_start >= (SELECT max(ts) FROM events) - INTERVAL '1440 minutes'""")
def _(spark, sf):
    return v.ntz(rk.recent_averages(v.hourly_averages(spark, sf), 1440, last_time(spark, sf).cast("timestamp"))
                 .select("sensorId", "time_start", "avg_temp"))


_ALERTS = v.ENRICHED + """, per_minute AS (SELECT sensor_id AS "sensorId", max(temperature) AS temperature, max(ts) AS event_time, 'TEMP_OVER_LIMIT' AS alert_type
  FROM en WHERE temperature > 30 GROUP BY sensor_id, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01'))"""


@query("threshold_alerts", f"WITH {_ALERTS} SELECT * FROM per_minute")
def _(spark, sf):
    return v.ntz(threshold_alerts(v.enriched(spark, sf)))


@query("first_alert_per_sensor", f"""WITH {v.ENRICHED} SELECT sensor_id AS "sensorId", arg_min(temperature, (ts, event_id)) AS temperature, min(ts) AS event_time,
  'TEMP_OVER_LIMIT' AS alert_type FROM en WHERE temperature > 30 GROUP BY 1""")
def _(spark, sf):
    return v.ntz(threshold_alerts(v.enriched(spark, sf), mode="once"))


@query("recent_alerts", f"WITH {_ALERTS} SELECT * FROM per_minute WHERE event_time >= (SELECT max(ts) FROM events) - INTERVAL '600 minutes'")
def _(spark, sf):
    return v.ntz(rk.recent_alerts(threshold_alerts(v.enriched(spark, sf)), 600, last_time(spark, sf).cast("timestamp")))


@query("paginate", """SELECT c_custkey, c_name, c_acctbal, (SELECT CAST(count(*) AS BIGINT) FROM customer) AS total_items FROM customer
  ORDER BY c_acctbal, c_custkey LIMIT 40 OFFSET 80""")
def _(spark, sf):
    customers = v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rk.paginate(customers, [F.asc_nulls_first("c_acctbal"), F.asc("c_custkey")], page=3, size=40)


@query("deep_page", """WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate, count(*) OVER () AS total_items,
    row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1 AS place FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate, total_items FROM o
  WHERE place >= total_items * 9 // 10 // 50 * 50 AND place < total_items * 9 // 10 // 50 * 50 + 50""")
def _(spark, sf):
    # the page at nine tenths of the table
    order = [F.desc("l_extendedprice"), *[F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")]]
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]
    pages = rk.Pages(v.table(spark, sf, "lineitem").select(*columns), order, part_rows=20_000)
    return pages.page(pages.total * 9 // 10 // 50 + 1, 50).select(*columns[:4], "total_items")


@query("tile_examples", """SELECT t AS tile_type, coalesce((SELECT min(p_partkey) FROM part WHERE CASE WHEN p_brand IN ('Brand#1', 'Brand#7', 'Brand#99') THEN p_brand ELSE 'Brand#1' END = t),
  (SELECT min(p_partkey) FROM part)) AS computation_id FROM (VALUES ('Brand#1'), ('Brand#7'), ('Brand#99')) v(t)""")
def _(spark, sf):
    computations = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tile_type"))
    return rk.first_per_type(computations, ["Brand#1", "Brand#7", "Brand#99"], "Brand#1")
