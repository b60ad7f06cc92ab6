"""Operational metrics over a message log: orders received, their lines shipped."""

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import normalize as nz
from . import views as v
from .normalization import last_time
from .registry import query


def message_log(spark, sf):
    """Line items as messages: sent when ordered, received when shipped."""
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    lines = v.table(spark, sf, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_returnflag").alias("source_type"), F.col("l_linestatus").alias("error_type"),
        F.col("o_orderdate").alias("event_time"), F.col("l_shipdate").alias("ingest_time"),
        F.col("o_orderstatus").alias("status"), "l_orderkey", "l_suppkey")


_LOG = """log AS (SELECT l_returnflag AS source_type, l_linestatus AS error_type, o_orderdate AS event_time, l_shipdate AS ingest_time,
  o_orderstatus AS status, l_orderkey, l_suppkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_WEEK = "time_bucket(INTERVAL '7 days', ingest_time, TIMESTAMP '1970-01-01')"


def _rate(df):
    return v.ntz(df.withColumn("per_second", F.round("per_second", 9)))


@query("message_rate", """SELECT time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS window_start, CAST(count(*) AS BIGINT) AS messages,
  round(count(*) / 300.0::DOUBLE, 9) AS per_second FROM events GROUP BY 1""")
def _(spark, sf):
    return _rate(mt.message_rate(v.table(spark, sf, "events"), "ts"))


@query("rate_by_source", f"""WITH {_LOG} SELECT {_WEEK} AS window_start, source_type, CAST(count(*) AS BIGINT) AS messages,
  round(count(*) / 604800.0::DOUBLE, 9) AS per_second FROM log GROUP BY ALL""")
def _(spark, sf):
    return _rate(mt.message_rate(message_log(spark, sf), "ingest_time", "7 days", ["source_type"]))


@query("rate_by_error", f"""WITH {_LOG} SELECT {_WEEK} AS window_start, source_type, error_type, CAST(count(*) AS BIGINT) AS messages,
  round(count(*) / 604800.0::DOUBLE, 9) AS per_second FROM log GROUP BY ALL""")
def _(spark, sf):
    return _rate(mt.message_rate(message_log(spark, sf), "ingest_time", "7 days", ["source_type", "error_type"]))


@query("success_rate", f"""WITH {_LOG} SELECT source_type, CAST(count(*) AS BIGINT) AS received, CAST(count(*) FILTER (WHERE status = 'F') AS BIGINT) AS processed,
  round(count(*) FILTER (WHERE status = 'F') / count(*) * 100, 2) AS success_percent FROM log GROUP BY 1""")
def _(spark, sf):
    return mt.success_rate(message_log(spark, sf), F.col("status") == "F", ["source_type"])


@query("bytes_rate", """SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, CAST(sum(strlen(props)) AS BIGINT) AS bytes,
  CAST(count(DISTINCT user_id) AS BIGINT) AS files FROM events GROUP BY 1""")
def _(spark, sf):
    return v.ntz(mt.bytes_rate(v.table(spark, sf, "events"), "ts", "props", F.col("user_id"), "1 hour"))


@query("latency_percentiles", f"""WITH {_LOG} SELECT source_type, round(quantile_cont(delay, 0.5), 6) AS p50, round(quantile_cont(delay, 0.95), 6) AS p95,
  round(quantile_cont(delay, 0.99), 6) AS p99 FROM log WHERE delay >= 0 GROUP BY 1""")
def _(spark, sf):
    delay = mt.seconds_between("event_time", "ingest_time")
    out = mt.latency_percentiles(message_log(spark, sf).where(delay >= 0), delay, ["source_type"])
    return out.select("source_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("value_percentiles", """SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
  round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem""")
def _(spark, sf):
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    out = mt.exact_percentiles(v.table(spark, sf, "lineitem"), "l_extendedprice", shares)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_BOUNDS = "(VALUES (1.0::DOUBLE), (2), (5), (10), (20), (30), (60), (120), (300), (600), (1800), (3600), (NULL))"


@query("latency_histogram", f"""WITH {_LOG}, h AS (SELECT source_type, delay / 86400 AS d FROM log WHERE delay >= 0), b(le) AS {_BOUNDS}
  SELECT source_type, le, CAST(count(*) FILTER (WHERE le IS NULL OR d <= le) AS BIGINT) AS n FROM h, b GROUP BY ALL""")
def _(spark, sf):
    days = mt.seconds_between("event_time", "ingest_time") / 86400
    return mt.latency_histogram(message_log(spark, sf).where(days >= 0), days, keys=["source_type"])


@query("timestamp_delay", f"""WITH {_LOG} SELECT source_type, CAST(count(*) AS BIGINT) AS n, min(delay) AS shortest, max(delay) AS longest, round(avg(delay), 6) AS mean
  FROM log WHERE delay >= 0 GROUP BY 1""")
def _(spark, sf):
    return mt.timestamp_delay(message_log(spark, sf), "event_time", "ingest_time", ["source_type"])


@query("gold_latency", f"""WITH {v.AVERAGES}, newest AS (SELECT *, (SELECT max(ts) FROM events) + INTERVAL '30 minutes' AS now FROM gold ORDER BY time_start DESC, "sensorId" LIMIT 5),
  ages AS (SELECT "sensorId", time_start, (epoch_us(now) - epoch_us(time_start)) / 1e6 AS a, (epoch_us(now) - epoch_us(min_enrichment_ts)) / 1e6 AS b FROM newest)
  SELECT "sensorId", time_start, CASE WHEN a BETWEEN 0 AND 3600 THEN a END AS sensor_to_gold, CASE WHEN b BETWEEN 0 AND 3600 THEN b END AS enrichment_to_gold FROM ages""")
def _(spark, sf):
    return v.ntz(mt.gold_latency(v.hourly_averages(spark, sf), last_time(spark, sf) + F.expr("INTERVAL 30 MINUTES")))


@query("top_rules", """WITH n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM events) SELECT raw_key, n AS total FROM n, (VALUES ('sensor_id'), ('temp'), ('humidity')) t(raw_key)""")
def _(spark, sf):
    return mt.top_rules(nz.rule_usage(v.union(spark, sf), v.rules(spark)))


@query("batch_status", "SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS batches FROM orders GROUP BY 1")
def _(spark, sf):
    return mt.batch_status(v.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query("step_durations", """SELECT l_suppkey AS step, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS last_seconds FROM lineitem GROUP BY 1""")
def _(spark, sf):
    log = v.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "step")
    return mt.step_durations(log, "step", F.struct("l_shipdate", "l_orderkey", "l_linenumber"), F.col("l_quantity"))


@query("layer_freshness", f"""WITH {v.AVERAGES}, a AS (SELECT max(ts) AS now FROM events)
  SELECT 'bronze' AS layer, max(ts) AS newest, (epoch_us(max(now)) - epoch_us(max(ts))) / 1e6 AS age_seconds FROM ev, a
  UNION ALL SELECT 'silver', max(ts), (epoch_us(max(now)) - epoch_us(max(ts))) / 1e6 FROM en, a WHERE temperature IS NOT NULL
  UNION ALL SELECT 'gold', max(time_start), (epoch_us(max(now)) - epoch_us(max(time_start))) / 1e6 FROM gold, a""")
def _(spark, sf):
    silver = v.enriched(spark, sf).where("normalized_data['temperature'] is not null")
    return v.ntz(mt.layer_freshness({
        "bronze": (v.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts"),
        "silver": (silver, "ingest_ts"), "gold": (v.hourly_averages(spark, sf), "time_start")}, last_time(spark, sf)))
