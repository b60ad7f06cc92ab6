"""Streaming queries over the events file, run to their end and read back from their tables."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rank as rk
from ..plans.gold import threshold_alerts, windowed_average
from ..plans.reprocess import reprocess
from ..streaming.control import ProgressTable, read_table, start, stream_progress, write_table
from ..sources.layers import bronze_columns, stream_bronze, stream_layer, write_bronze
from ..schema import ENRICHED
from ..streaming.enrich import SilverWriter, batch_counts, enrichment_stream, value_rule_usage
from ..streaming.latest import list_state, newest_per_source, newest_rows
from ..storage import fresh_path
from . import views as v
from .registry import query


STORED = T.StructType([*ENRICHED.fields, T.StructField("enrichment_timestamp", T.TimestampType())])


def event_stream(spark, sf, **options):
    schema = v.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").options(**options).parquet(sf) \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def _as_readings(events):
    """Event rows as raw readings (the streaming twin of the bronze view)."""
    return events.select(
        F.concat(F.lit("src_"), "event_type").alias("ingestion_id"), F.col("ts").cast("string").alias("timestamp"),
        F.concat(F.lit("sensor_"), F.col("user_id").cast("string")).alias("sensor_id"), F.col("value").alias("Temp"),
        F.get_json_object("props", "$.k").cast("double").alias("HUMIDITY"), F.lit("mqtt").alias("source_type"))


def _enriched_stream(spark, sf):
    """The silver table as a stream, as the gold queries read it."""
    return stream_layer(spark, v.silver_path(spark, sf), v.SILVER)


def _run(spark, writer, kind):
    query = start(writer, f"{kind}-{uuid.uuid4().hex[:8]}", fresh_path(spark, f"{kind}-checkpoint"))
    query.awaitTermination()
    return query


def _table(spark, df, kind, mode, keys=()):
    path = fresh_path(spark, kind)
    _run(spark, write_table(df, path, mode), kind)
    return v.ntz(read_table(spark, path, mode, keys))


_RULES = [{"id": 1, "field_name": "temperature", "transformation_type": "convert", "order_priority": 10,
           "config": {"operation": "mathematical", "math_operation": "multiply", "operand": 2}},
          {"id": 2, "field_name": "temperature", "transformation_type": "validate", "order_priority": 20,
           "config": {"validation_rules": [{"rule": "range", "params": {"min": 0, "max": 400}}], "on_fail": "default"}}]


@query("stream_enrich", f"""WITH {v.ENRICHED}, {v.DEVICES_SQL} SELECT ingestion_id, ts AS event_time, ts AS ingest_ts, CAST(ts AS DATE) AS ingest_date,
    sensor_id AS "sensorId", CASE WHEN temperature * 2 <= 400 THEN temperature * 2 END AS temperature, CAST(temperature AS VARCHAR) AS raw, humidity, 'mqtt' AS source
  FROM en WHERE lower(trim(ingestion_id)) IN (SELECT lower(trim(ingestion_id)) FROM devices WHERE enabled AND ingestion_id <> 'unknown')""")
def _(spark, sf):
    path = fresh_path(spark, "silver")
    writer = SilverWriter(path, devices=lambda: v.devices(spark), transformations=lambda: _RULES)
    raw = _as_readings(event_stream(spark, sf))
    _run(spark, enrichment_stream(raw, v.rules(spark), writer, as_of=F.col("timestamp")), "enrich")
    silver = writer.table(spark).read(STORED)
    return v.ntz(silver.select("ingestion_id", "event_time", "ingest_ts", "ingest_date", F.col("sensor_data")["sensorId"].alias("sensorId"),
                               F.col("normalized_data")["temperature"].alias("temperature"), F.col("sensor_data")["temperature"].alias("raw"),
                               F.col("normalized_data")["humidity"].alias("humidity"), "source"))


@query("stream_window_avg", f"""WITH {v.AVERAGES} SELECT * FROM gold WHERE time_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM en WHERE temperature IS NOT NULL) - INTERVAL '2 minutes'""")
def _(spark, sf):
    # append: windows still open at the end of the data are not out yet
    return _table(spark, windowed_average(_enriched_stream(spark, sf), window="1 hour"), "averages", "append")


@query("stream_window_avg_complete", f"WITH {v.AVERAGES} SELECT * FROM gold")
def _(spark, sf):
    return _table(spark, windowed_average(_enriched_stream(spark, sf), window="1 hour", watermark=None), "averages", "complete")


@query("stream_sliding_avg", f"""WITH {v.ENRICHED}, slides AS (SELECT unnest([0, 30]) AS back), w AS (
    SELECT sensor_id, ts, temperature, time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - to_minutes(back) AS time_start FROM en CROSS JOIN slides WHERE temperature IS NOT NULL)
  SELECT sensor_id AS "sensorId", time_start, {v.MEAN.format('temperature')} AS avg_temp, min(ts) AS min_enrichment_ts FROM w GROUP BY ALL""")
def _(spark, sf):
    sliding = windowed_average(_enriched_stream(spark, sf), window="1 hour", slide="30 minutes")
    return _table(spark, sliding, "sliding", "complete")


@query("stream_hourly_mean", f"WITH {v.AVERAGES} SELECT * FROM gold")
def _(spark, sf):
    hourly = windowed_average(_enriched_stream(spark, sf), window="1 hour", time="event_time", watermark="1 minute")
    return _table(spark, hourly, "hourly", "update", ("sensorId", "time_start"))


_MINUTES = v.ENRICHED + """, per_minute AS (SELECT sensor_id AS "sensorId", max(temperature) AS temperature, max(ts) AS event_time, 'TEMP_OVER_LIMIT' AS alert_type,
    time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') AS minute FROM en WHERE temperature > 30 GROUP BY ALL)"""


@query("stream_alerts", f"""WITH {_MINUTES.replace('GROUP BY ALL', "GROUP BY sensor_id, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01')")}
  SELECT "sensorId", temperature, event_time, alert_type FROM per_minute
  WHERE minute + INTERVAL '1 minute' <= (SELECT max(ts) FROM en WHERE temperature > 30) - INTERVAL '2 minutes'""")
def _(spark, sf):
    return _table(spark, threshold_alerts(_enriched_stream(spark, sf)), "alerts", "append")


@query("stream_alerts_once", f"""WITH {v.ENRICHED} SELECT DISTINCT sensor_id AS "sensorId", 'TEMP_OVER_LIMIT' AS alert_type FROM en WHERE temperature > 30""")
def _(spark, sf):
    return _table(spark, threshold_alerts(_enriched_stream(spark, sf), mode="once"), "alerts", "append").select("sensorId", "alert_type")


@query("stream_late_data", """SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS time_start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1
  HAVING time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '2 minutes'""")
def _(spark, sf):
    # all events arrive, the last one again, and then all of them again, each arrival taken as it comes: the last one is
    # later than the watermark that the others left
    path, out, checkpoint = (fresh_path(spark, kind) for kind in ("late", "late-counts", "late-checkpoint"))
    events = v.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = events.where(F.col("ts") == events.agg(F.max("ts")).scalar())
    for arrival in (events, newest, events):
        arrival.write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        counts = stream.withWatermark("ts", "2 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")) \
            .select(F.col("w.start").alias("time_start"), "n")
        start(write_table(counts, out), f"late-{uuid.uuid4().hex[:8]}", checkpoint).awaitTermination()
    return v.ntz(read_table(spark, out))


@query("stream_count", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(ts) AS latest FROM events GROUP BY 1")
def _(spark, sf):
    counts = event_stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return _table(spark, counts, "count", "complete")


_ALIVE = """WITH alive AS (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL '12 hours')
  SELECT event_id, user_id, ts, value FROM events SEMI JOIN alive USING (user_id)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"""


def _arrivals(spark, sf, path, *parts):
    """Events in order of time, written so many files at a time."""
    events = v.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    files = fresh_path(spark, "sorted")
    events.repartitionByRange(sum(parts), "ts").write.parquet(files)
    names = sorted(r[0] for r in spark.read.parquet(files).select(F.input_file_name()).distinct().collect())
    for n in parts:
        for name in names[:n]:
            spark.read.schema(events.schema).parquet(name).write.mode("append").parquet(path)
        names = names[n:]
        yield events.schema


def _newest(spark, schema, path, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    changes = newest_per_source(stream, "ts", 5, "user_id", ("event_id",), silent="12 hours")
    with list_state(spark):
        start(changes.writeStream.outputMode("update").format("noop"), f"newest-{uuid.uuid4().hex[:8]}", checkpoint).awaitTermination()


@query("stream_latest_n", _ALIVE)
def _(spark, sf):
    path, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "newest")
    for schema in _arrivals(spark, sf, path, 3):
        _newest(spark, schema, path, checkpoint)
    return v.ntz(newest_rows(spark, checkpoint))


@query("stream_latest_state", _ALIVE)
def _(spark, sf):
    # the query ends after two files and is started again from its checkpoint for the rest
    path, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "newest")
    for schema in _arrivals(spark, sf, path, 2, 2):
        _newest(spark, schema, path, checkpoint)
    return v.ntz(newest_rows(spark, checkpoint))


@query("stream_progress")
def _(spark, sf):
    path = fresh_path(spark, "progress")
    counts = event_stream(spark, sf).groupBy("event_type").count()
    return stream_progress([_run(spark, write_table(counts, path, "complete"), "progress")])


@query("stream_progress_log", "SELECT CAST(6 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS input_rows FROM events")
def _(spark, sf):
    # a listener writes what each batch of a query over six files says
    path = fresh_path(spark, "arrivals")
    events = v.table(spark, sf, "events").select("event_id", "event_type")
    events.repartition(6).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with ProgressTable(spark, fresh_path(spark, "progress"), every=4) as progress:
        counts = stream.groupBy("event_type").count()
        progress.wait(_run(spark, write_table(counts, fresh_path(spark, "counts"), "complete"), "progress"))
    return progress.read().agg(F.count("*").alias("batches"), F.sum("input_rows").alias("input_rows"))


@query("reprocess", f"""WITH {v.ENRICHED}, {v.DEVICES_SQL}, ok AS (SELECT * FROM en WHERE lower(trim(ingestion_id)) IN
    (SELECT lower(trim(ingestion_id)) FROM devices WHERE enabled AND ingestion_id <> 'unknown')),
  t AS (SELECT *, CASE WHEN temperature * 2 <= 400 THEN temperature * 2 END AS t2 FROM ok)
  SELECT 'averages' AS part, sensor_id AS "sensorId", {v.MEAN.format('t2')} AS temperature, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') AS time FROM t
    WHERE coalesce(t2, temperature) IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'alerts', sensor_id, max(t2), max(ts) FROM t WHERE t2 > 30 GROUP BY sensor_id, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01')""".replace("CASE WHEN temperature * 2 <= 400 THEN temperature * 2 END AS t2", "CASE WHEN temperature * 2 <= 400 THEN temperature * 2 ELSE temperature END AS t2"))
def _(spark, sf):
    bronze = _as_readings(v.table(spark, sf, "events"))
    made = reprocess(bronze, v.rules(spark), v.devices(spark), _RULES, as_of=F.col("timestamp"))
    return v.ntz(made["averages"].select(F.lit("averages").alias("part"), "sensorId", F.col("avg_temp").alias("temperature"), F.col("time_start").alias("time"))
                 .unionByName(made["alerts"].select(F.lit("alerts").alias("part"), "sensorId", "temperature", F.col("event_time").alias("time"))))


# ---------------------------------------------------------------- bronze to gold, in arrivals

class _Lake:
    """A bronze folder that arrivals are added to, and the streams that follow it: enrichment, averages, alerts."""

    def __init__(self, spark, sf):
        self.spark = spark
        self.readings = _as_readings(v.table(spark, sf, "events"))
        self.bronze, self.averages, self.alerts = (fresh_path(spark, x) for x in ("bronze", "averages", "alerts"))
        self.writer = SilverWriter(fresh_path(spark, "silver"), lambda: v.devices(spark), lambda: _RULES)
        self.checkpoints = {x: fresh_path(spark, f"{x}-checkpoint") for x in ("enrich", "averages", "alerts")}
        self.schema = bronze_columns(self.readings).drop("date", "hour").schema

    def parts(self, n):
        """The readings cut by time, without a shuffle of their own: the cuts are quantiles of the times."""
        at = F.unix_micros(F.col("timestamp").cast("timestamp"))
        cuts = self.readings.select(at.alias("at")).approxQuantile("at", [(i + 1) / n for i in range(n - 1)], 0.01)
        edges = [None, *cuts, None]
        for low, high in zip(edges, edges[1:], strict=False):
            yield self.readings.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))

    def arrive(self, readings):
        write_bronze(readings, self.bronze, partitions=("ingestion_id",))

    def _follow(self, name, writer):
        start(writer, f"{name}-{uuid.uuid4().hex[:8]}", self.checkpoints[name]).awaitTermination()

    def enrich(self):
        raw = stream_bronze(self.spark, self.bronze, self.schema).drop("date", "hour")
        self._follow("enrich", enrichment_stream(raw, v.rules(self.spark), self.writer, as_of=F.col("timestamp")))

    def gold(self, window="1 minute"):
        silver = self.writer.table(self.spark).stream(STORED)
        self._follow("averages", write_table(windowed_average(silver, window=window), self.averages))
        self._follow("alerts", write_table(threshold_alerts(silver), self.alerts))

    def result(self):
        averages, alerts = self.spark.read.parquet(self.averages), self.spark.read.parquet(self.alerts)
        return v.ntz(averages.select(F.lit("averages").alias("part"), "sensorId", F.col("avg_temp").alias("temperature"), F.col("time_start").alias("time"))
                     .unionByName(alerts.select(F.lit("alerts").alias("part"), "sensorId", "temperature", F.col("event_time").alias("time"))))


_ACCEPTED = f"""{v.ENRICHED}, {v.DEVICES_SQL}, ok AS (SELECT * FROM en WHERE lower(trim(ingestion_id)) IN
    (SELECT lower(trim(ingestion_id)) FROM devices WHERE enabled AND ingestion_id <> 'unknown')),
  t AS (SELECT *, CASE WHEN temperature * 2 <= 400 THEN temperature * 2 ELSE temperature END AS t2 FROM ok WHERE temperature IS NOT NULL),
  minutes AS (SELECT *, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') AS minute FROM t)"""
# what append mode has let out at the end: windows that the watermark has passed
_CLOSED = f"""WITH {_ACCEPTED}
  SELECT 'averages' AS part, sensor_id AS "sensorId", {v.MEAN.format('t2')} AS temperature, minute AS time FROM minutes GROUP BY sensor_id, minute
    HAVING minute + INTERVAL '1 minute' <= (SELECT max(ts) FROM t) - INTERVAL '2 minutes'
  UNION ALL SELECT 'alerts', sensor_id, max(t2), max(ts) FROM minutes WHERE t2 > 30 GROUP BY sensor_id, minute
    HAVING minute + INTERVAL '1 minute' <= (SELECT max(ts) FROM t WHERE t2 > 30) - INTERVAL '2 minutes'"""


@query("stream_pipeline", _CLOSED)
def _(spark, sf):
    # three arrivals in order, each followed to gold, then the first again, which is too late for gold by then
    lake = _Lake(spark, sf)
    arrivals = list(lake.parts(3))
    for readings in [*arrivals, arrivals[0]]:
        lake.arrive(readings)
        lake.enrich()
        lake.gold()
    return lake.result()


@query("stream_retry", _CLOSED)
def _(spark, sf):
    # while gold follows silver, every batch is written once more and another one dies before it is published
    lake = _Lake(spark, sf)
    table = lake.writer.table(spark)
    for readings in lake.parts(2):
        lake.arrive(readings)
        lake.enrich()
        lake.gold()
        again = table.read(STORED)
        for entry in table.log().collect():
            table.write(again, entry.batch_id)
        again.write.partitionBy("ingestion_id").parquet(f"{table.path}/_staged/lost-{uuid.uuid4().hex}")
        lake.gold()
    return lake.result()


@query("value_rule_usage", f"""WITH {_ACCEPTED} SELECT CAST(1 AS BIGINT) AS rule_id, CAST(count(*) AS BIGINT) AS applied_count FROM t
  UNION ALL SELECT 2, count(*) FROM t""")
def _(spark, sf):
    lake = _Lake(spark, sf)
    for readings in lake.parts(2):
        lake.arrive(readings)
        lake.enrich()
    return value_rule_usage(lake.writer.table(spark)).select("rule_id", "applied_count")


@query("enrichment_batches", f"""WITH {_ACCEPTED} SELECT CAST((SELECT count(*) FROM en) AS BIGINT) AS received, CAST(count(*) AS BIGINT) AS written FROM ok""")
def _(spark, sf):
    lake = _Lake(spark, sf)
    for readings in lake.parts(2):
        lake.arrive(readings)
        lake.enrich()
    return batch_counts(lake.writer.table(spark)).agg(F.sum("received").alias("received"), F.sum("written").alias("written"))


@query("silver_compaction", f"""WITH {_ACCEPTED} SELECT ingestion_id, CAST(count(*) AS BIGINT) AS readings, CAST(1 AS BIGINT) AS files FROM ok GROUP BY 1""")
def _(spark, sf):
    # four batches of many files become one file for each source; streams do not see them again
    lake = _Lake(spark, sf)
    table = lake.writer.table(spark)
    for readings in lake.parts(4):
        lake.arrive(readings)
        lake.enrich()
    table.compact()
    rows = table.read(STORED).select("ingestion_id", F.input_file_name().alias("file"))
    return rows.groupBy("ingestion_id", "file").count().groupBy("ingestion_id").agg(
        F.sum("count").alias("readings"), F.count("*").alias("files"))
