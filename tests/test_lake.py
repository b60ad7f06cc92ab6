import datetime as dt
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorlake.functions import overlay
from sensorlake.operators.devices import registered_only
from sensorlake.operators.normalize import rules_frame
from sensorlake.plans.gold import threshold_alerts, windowed_average
from sensorlake.plans.reprocess import reprocess
from sensorlake.schema import ENRICHED
from sensorlake.sources import files as fl
from sensorlake.sources import layers as ly
from sensorlake.sources.messages import build_bronze, extract_records, parse_messages, payload_columns
from sensorlake.sources.sensor_csv import as_messages, read_sensor_csv, sensor_slice
from sensorlake.storage import fresh_path, materialize, shared_dir
from sensorlake.streaming.control import ProgressTable, find_query, rate_source, read_table, start, stop, stream_progress, write_table
from sensorlake.sources.commits import CommittedTable
from sensorlake.streaming.enrich import SilverWriter, batch_counts, enrich, enrichment_stream, value_rule_usage
from sensorlake.streaming import latest
from sensorlake.streaming.latest import list_state, newest_per_source, newest_rows

SCHEMA = "ingestion_id string, timestamp string, temp double, n int, sensor_id string"


def readings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def raw(spark):
    start_at = dt.datetime(2024, 5, 1, 10, 30)
    return readings(spark, [("s%d" % (i % 3), (start_at + dt.timedelta(minutes=i)).isoformat(), float(i), i, f"d{i % 4}") for i in range(60)])


def test_storage(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]


def test_bronze_layout_and_pruning(spark, raw):
    path = fresh_path(spark, "bronze")
    ly.write_bronze(raw, path)
    df = ly.read_bronze(spark, path)
    assert df.count() == 60 and dict(df.dtypes)["n"] == "double"
    # rows that straddle an hour go where they belong
    assert ly.read_bronze(spark, path, hour=11).where("minute(cast(timestamp as timestamp)) >= 0").count() == 30
    one = ly.read_bronze(spark, path, "s1", "2024-05-01", 10)
    assert one.count() == 10
    assert "PartitionFilters: [isnotnull(ingestion_id" in one._jdf.queryExecution().toString()
    assert set(fl.sample_latest_files(spark, path, 2, 100).select("_ingestion_id").distinct().toPandas()["_ingestion_id"]) == {"s2"}
    assert fl.file_inventory(spark, path, suffix="parquet", page_size=2).count() == 2


def test_missing_layers_are_empty(spark, raw):
    path = fresh_path(spark, "nothing")
    assert ly.read_layer(spark, path, ENRICHED).count() == 0
    ly.ensure_table(spark, path, ENRICHED)
    assert ly.read_layer(spark, path, ENRICHED).schema == ENRICHED or ly.read_layer(spark, path, ENRICHED).columns == ENRICHED.names
    bronze = fresh_path(spark, "bronze")
    ly.write_bronze(raw, bronze, partitions=("ingestion_id",))
    assert ly.available_datasets(spark, {"bronze": bronze, "alerts": fresh_path(spark, "none")}) == ["bronze"]
    paths = {"bronze": bronze, "enriched": path, "averages": path, "alerts": path}
    assert ly.resolve_dataset("Bronze", paths, spark).count() == 60
    assert ly.resolve_dataset("sensors", paths, spark).columns == ["ingestion_id", "metric", "value", "ts"]


def test_retention(spark):
    df = spark.createDataFrame([("a", "2024-05-01"), ("b", "2024-05-01"), ("c", "2024-05-09"), ("a", None)], "ingestion_id string, timestamp string")
    devices = spark.createDataFrame([("B", 30)], "ingestion_id string, retention_days int")
    kept = ly.apply_retention(df, "bronze", F.lit("2024-05-10").cast("timestamp"), devices=devices)
    assert sorted((r.ingestion_id, r.timestamp is None) for r in kept.collect()) == [("a", True), ("b", False), ("c", False)]


def test_retention_drops_folders_and_rewrites_touched_sources_only(spark):
    path, flat = fresh_path(spark, "bronze"), fresh_path(spark, "flat")
    rows = [("a/b c", "2024-05-01", 1), ("a/b c", "2024-05-09", 2), ("keeps", "2024-05-01", 3), ("new", "2024-05-10", 4), ("old", "2024-04-01", 5),
            (None, "2024-05-01", 6), ("a/b c", None, 7)]
    df = spark.createDataFrame(rows, "ingestion_id string, date string, x int")
    devices = spark.createDataFrame([(" Keeps", 30)], "ingestion_id string, retention_days int")
    now = F.lit("2024-05-10").cast("timestamp")
    df.write.partitionBy("ingestion_id", "date").parquet(path)
    gone = ly.enforce_retention(spark, path, "bronze", now, devices)
    assert sorted((str(r.ingestion_id), r.date) for r in gone.collect()) == [("None", "2024-05-01"), ("a/b c", "2024-05-01"), ("old", "2024-04-01")]
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 3, 4, 7]
    assert ly.enforce_retention(spark, path, "bronze", now, devices).count() == 0

    df.write.partitionBy("ingestion_id").parquet(flat)
    def files(source):
        found = spark.read.parquet(flat).where(F.col("ingestion_id") == source).select(F.input_file_name().alias("f")).distinct()
        return {r.f for r in found.collect()}

    before = {s: files(s) for s in ("a/b c", "keeps", "new")}
    assert ly.rewrite_retention(spark.read.parquet(flat), flat, "bronze", now, "date", devices) == ["a/b c", "old"]
    assert sorted(r.x for r in spark.read.parquet(flat).collect()) == [2, 3, 4, 6, 7]
    assert files("keeps") == before["keeps"] and files("new") == before["new"] and files("a/b c") != before["a/b c"]

    log = fresh_path(spark, "quality")
    spark.createDataFrame([("2024-03-01", 1.0), ("2024-05-01", 2.0)], "date string, metric_value double").write.partitionBy("date").parquet(log)
    assert [r.date for r in ly.enforce_retention(spark, log, "quality", now, levels=("date",)).collect()] == ["2024-03-01"]


def test_every_update_of_a_query_is_kept(spark):
    path = fresh_path(spark, "many")
    spark.range(0, 110, 1, 110).write.parquet(path)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)
    with ProgressTable(spark, fresh_path(spark, "progress"), every=25) as progress:
        query = start(stream.writeStream.format("noop"), "many", fresh_path(spark, "ck"))
        query.awaitTermination()
        progress.wait(query)
        failing = start(stream.select(F.raise_error(F.lit("oops"))).writeStream.format("noop"), "failing", fresh_path(spark, "ck"))
        with pytest.raises(Exception, match="oops"):
            failing.awaitTermination()
        progress.wait(failing)
    files = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    rows = progress.read().where(F.col("name") == "many")
    assert rows.agg(F.count("*"), F.sum("input_rows"), F.count_distinct("batch_id")).first()[:] == (files, 110, files) and files > 100
    assert "oops" in progress.read().where("error is not null").collect()[0].error


def test_messages(spark):
    twice = parse_messages(spark.createDataFrame([('{"a": 1, "b": 2, "a": 3}',)], "value string"))
    assert twice.select(overlay(F.col("data"), F.create_map(F.lit("b"), F.lit("4"))).alias("m")).collect()[0].m == {"a": "3", "b": "4"}
    df = spark.createDataFrame([('{"a": 1}',), ("oops",), ("[1]",)], "value string")
    assert [r.data for r in parse_messages(df).collect()] == [
        {"a": "1"}, {"content": "oops", "raw": "true"}, {"content": "[1]", "raw": "true"}]
    assert parse_messages(df, content_type=F.lit("text/plain")).collect()[1].data == {"content": "oops", "content_type": "text/plain"}


@pytest.mark.parametrize("path, document, records", [
    ("data.items", '{"data": {"items": [{"a": 1}, {"a": 2}]}}', ['{"a":1}', '{"a":2}']),
    ("items.0.data", '{"items": [{"data": 5}]}', ["5"]), ("items.3", '{"items": [1]}', ['{"items":[1]}']),
    ("x", '{"y": 1}', ['{"y":1}']), ("", "[1, 2]", ["1", "2"]), ("x", '{"x": []}', []),
    ("0", '{"0": "key"}', ['"key"']), ("", "plain", ['{"content":"plain"}'])])
def test_records(spark, path, document, records):
    df = spark.createDataFrame([(document,)], "value string")
    assert [r.record for r in extract_records(df, path).collect()] == records


def test_envelope(spark):
    df = spark.createDataFrame([({"a": "1", "timestamp": "x", "topic": "mine"}, {"source_type": "mqtt", "topic": "t"}, "id1", "1725212710")],
                               "data map<string,string>, metadata map<string,string>, source_id string, timestamp string")
    bronze = build_bronze(df, F.lit("2024-09-02").cast("timestamp"))
    payload = bronze.collect()[0].payload
    assert payload == {"a": "1", "topic": "t", "ingestion_id": "id1", "timestamp": "2024-09-01T17:45:10.000000Z",
                       "source_type": "mqtt", "ingestion_timestamp": "2024-09-02T00:00:00.000000Z"}
    wide = payload_columns(bronze, spark.createDataFrame([], "a double, topic double").schema).collect()[0]
    assert wide.a == 1.0 and wide.topic is None


def test_sensor_archive(spark):
    path = fresh_path(spark, "csv")
    rows = [("2018/01/01 00:00:06", "n1", "metsense", "bmp180", "temperature", "17", "NA"),
            ("2018/01/01 00:00:07", "n1", "chemsense", "co", "concentration", "3", "0.5"),
            ("2018/01/01 00:00:08", "n1", "audio", "mic", "octave", "NA", "7"), ("2018/01/01 00:00:09", "n1", "metsense", "x", "id", "1", "1"),
            ("2018/01/01 00:00:05", "n1", "nc", "net", "rx", "1", "1")]
    spark.createDataFrame(rows, "timestamp string, node_id string, subsystem string, sensor string, parameter string, value_raw string, value_hrf string") \
        .write.csv(path, header=True, compression="gzip")
    out = sensor_slice(read_sensor_csv(spark, path))
    assert {(r.topic, r.sensor_id, r.value, r.unit) for r in out.collect()} == {
        ("smartcity/sensors/aot_temperature", "aot_n1_bmp180", "17", "C"), ("smartcity/sensors/aot_air_quality", "aot_n1_co", "0.5", "ppm"),
        ("smartcity/sensors/aot_octave", "aot_n1_mic", "7", "")}
    assert sensor_slice(read_sensor_csv(spark, path), max_rows=1).collect()[0].timestamp == "2018-01-01 00:00:06Z"
    assert '"temperature":"17"' in as_messages(out).where("topic like '%temperature'").collect()[0].value


# ---------------------------------------------------------------- streams against their batch twins

RULES = [{"raw_key": "temp", "canonical_key": "temperature"}, {"raw_key": "sensor_id", "canonical_key": "sensorId"}]


def facts(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_streamed_lake_equals_reprocessed_lake(spark, raw):
    bronze, silver, gold, alerts = (fresh_path(spark, n) for n in ("bronze", "silver", "gold", "alerts"))
    raw.repartitionByRange(3, "timestamp").write.parquet(bronze)
    devices = spark.createDataFrame([("S0", True), ("s1", True)], "ingestion_id string, enabled boolean")
    rules = rules_frame(spark, RULES)
    arrival = F.col("timestamp")
    stream = ly.stream_bronze(spark, bronze, raw.schema, max_files=1)
    writer = SilverWriter(silver, lambda: devices)
    start(enrichment_stream(stream, rules, writer, arrival), "enrich-test", fresh_path(spark, "ck")).awaitTermination()
    assert batch_counts(writer.table(spark)).agg(F.count("*"), F.sum("received"), F.sum("written")).first()[:] == (3, 60, 40)

    enriched = writer.table(spark).stream(ENRICHED)
    averages = windowed_average(enriched, window="10 minutes", watermark=None)
    start(write_table(averages, gold, "complete"), "gold-test", fresh_path(spark, "ck")).awaitTermination()
    start(write_table(threshold_alerts(enriched, watermark=None), alerts, "complete"), "alerts-test",
          fresh_path(spark, "ck")).awaitTermination()
    made = reprocess(raw, rules, devices, window="10 minutes", as_of=arrival)
    columns = ("sensorId", "time_start", "avg_temp", "min_enrichment_ts")
    assert facts(read_table(spark, gold, "complete"), *columns) == facts(made["averages"], *columns)
    columns = ("sensorId", "temperature", "event_time", "alert_type")
    assert facts(read_table(spark, alerts, "complete"), *columns) == facts(made["alerts"], *columns)
    assert made["alerts"].count() > 0


def test_nothing_registered_writes_nothing(spark, raw):
    bronze, silver = fresh_path(spark, "bronze"), fresh_path(spark, "silver")
    raw.write.parquet(bronze)
    nobody = spark.createDataFrame([], "ingestion_id string, enabled boolean")
    writer = SilverWriter(silver, lambda: nobody)
    stream = ly.stream_bronze(spark, bronze, raw.schema)
    start(enrichment_stream(stream, {"temp": "temperature"}, writer), "nobody", fresh_path(spark, "ck")).awaitTermination()
    assert [b.written for b in batch_counts(writer.table(spark)).collect()] == [0]
    assert writer.table(spark).read(ENRICHED).count() == 0


def test_a_repeated_batch_counts_once(spark, raw):
    batch = enrich(raw, rules_frame(spark, RULES))
    table = CommittedTable(spark, fresh_path(spark, "silver"))
    assert table.read(ENRICHED).count() == 0 and table.compact() == 0
    assert table.write(batch, 0, lambda: {"n": 60}) and not table.write(batch, 0, lambda: {"n": 61})
    assert table.read(ENRICHED).count() == 60 and [r.n for r in table.counts().collect()] == [60]
    # entered but not yet moved when the writer died: the next attempt publishes the first one's rows
    batch.write.partitionBy("ingestion_id").parquet(f"{table.path}/_staged/1-lost")
    table._enter("1", kind="batch", batch_id=1, last_id=1, folder="_staged/1-lost", counts={})
    assert table.read(ENRICHED).count() == 60
    assert not table.write(batch.limit(7), 1) and table.read(ENRICHED).count() == 120


def test_small_files_are_packed_under_a_running_stream(spark, raw):
    table = CommittedTable(spark, fresh_path(spark, "silver"))
    batch = enrich(raw, rules_frame(spark, RULES))
    path, checkpoint = fresh_path(spark, "copy"), fresh_path(spark, "ck")

    def follow():
        start(write_table(table.stream(ENRICHED), path), "follow", checkpoint).awaitTermination()

    for i in range(4):
        batch.repartition(8).write.partitionBy("ingestion_id").parquet(f"{table.path}/_staged/{i}")
        table._enter(str(i), kind="batch", batch_id=i, last_id=i, folder=f"_staged/{i}", counts={})
        table._publish(i)
    follow()
    before = facts(table.read(ENRICHED), "ingestion_id", "timestamp", "sensor_data")
    bytes_of = {r[0]: r[1] for r in table.read(ENRICHED).select("ingestion_id", F.input_file_name().alias("f")).distinct()
                .groupBy("ingestion_id").count().collect()}
    assert max(bytes_of.values()) > 8
    assert table.compact(file_bytes=60_000) == 4 and table.compact() == 0
    assert facts(table.read(ENRICHED), "ingestion_id", "timestamp", "sensor_data") == before
    files = table.read(ENRICHED).select("ingestion_id", F.input_file_name().alias("f")).distinct().groupBy("ingestion_id").count().collect()
    assert all(1 <= r["count"] < 8 for r in files)
    table.write(batch, 4)
    follow()
    assert table.read(ENRICHED).count() == 300 and spark.read.parquet(path).count() == 300


def test_packing_does_not_sort(spark, raw):
    """Each task writes one file of one source, as the rows come: no sort whose memory grows with the file."""
    table = CommittedTable(spark, fresh_path(spark, "silver"))
    batch = enrich(raw, rules_frame(spark, RULES))
    for i in range(2):
        table.write(batch, i)
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    sc.setJobGroup(group := table.path, "packing")
    try:
        assert table.compact() == 2
    finally:
        sc._jsc.clearJobGroup()
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = [store.lastStageAttempt(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    writing = [s for s in stages if s.outputRecords() == 120]
    assert writing and max(s.peakExecutionMemory() for s in writing) == 0
    assert table.read(ENRICHED).count() == 120 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_value_rules_are_counted_by_the_write(spark, raw):
    rules = [{"id": 7, "field_name": "temperature", "transformation_type": "filter", "order_priority": 1,
              "config": {"operator": ">", "value": 20}},
             {"id": 8, "field_name": "temperature", "transformation_type": "convert", "order_priority": 2, "ingestion_id": "s1",
              "config": {"operation": "mathematical", "math_operation": "multiply", "operand": 2}},
             {"id": 9, "field_name": "nothing", "transformation_type": "filter", "order_priority": 3, "ingestion_id": "s9",
              "config": {"operator": ">", "value": 0}}]
    writer = SilverWriter(fresh_path(spark, "silver"), lambda: None, lambda: rules)
    batch = enrich(raw, rules_frame(spark, RULES))
    writer(batch, 0)
    writer(batch, 1)
    temperature = F.col("normalized_data")["temperature"]
    have, hot = batch.where(temperature.isNotNull()).count(), batch.where((temperature > 20) & (F.col("ingestion_id") == "s1")).count()
    usage = {r.rule_id: (r.applied_count, r.batches, r.last_batch) for r in value_rule_usage(writer.table(spark)).collect()}
    assert usage == {7: (2 * have, 2, 1), 8: (2 * hot, 2, 1)} and hot > 0


def test_registered_sources_are_broadcast(spark, raw):
    devices = spark.createDataFrame([("S0", True), ("s1", False)], "ingestion_id string, enabled boolean")
    plan = registered_only(raw, devices)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(_device" not in plan
    assert registered_only(raw, devices.unionAll(spark.createDataFrame([(None, True)], devices.schema))).count() == 60


def _files(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_newest_rows_survive_a_restart_and_leave_when_silent(spark):
    path, checkpoint = fresh_path(spark, "arrivals"), fresh_path(spark, "ck")
    schema = "ingestion_id string, ts timestamp, v int, more struct<t:timestamp,w:double,x:array<string>>"
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    row = lambda source, s, v: (source, None if s is None else at(s), v, (at(s or 0) + dt.timedelta(microseconds=7), float("nan"), ["q", None]))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        changes = newest_per_source(stream, "ts", 2, tie_break=("v",), silent="100 seconds")
        out = []
        with list_state(spark):
            query = start(changes.writeStream.outputMode("update").foreachBatch(lambda b, i: out.extend(b.collect())),
                          "newest-test", checkpoint)
        query.awaitTermination()
        return [(r.source, r.status, r.held) for r in out]

    _files(spark, path, [row("a", 0, 1), row("a", 1, 2), row("a", 2, 3), row("b", 50, None), row(None, 30, 9), row("d", None, 1)], schema)
    assert sorted(run(), key=str) == [("a", "active", 2), ("b", "active", 1), (None, "active", 1)]
    _files(spark, path, [row("b", 60, 5), row("b", 60, 5), row("b", 60, 4), row("c", 120, 6)], schema)
    left = run()
    assert ("a", "left", 0) in left and ("b", "left", 0) not in left
    _files(spark, path, [row("b", 10, 7), row("c", 121, None)], schema)  # late within its source, but not too late
    run()
    rows = newest_rows(spark, checkpoint, spark.createDataFrame([], schema).schema)
    assert rows.where("more.t <> ts + interval 7 microseconds or more.w <> double('nan')").count() == 0
    found = sorted((str(r.ingestion_id), str(r.v), r.more.x) for r in rows.collect())
    assert found == [("None", "9", ["q", None]), ("b", "5", ["q", None]), ("b", "5", ["q", None]), ("c", "6", ["q", None]),
                     ("c", "None", ["q", None])]
    assert rows.schema.simpleString() == f"struct<{schema.replace(', ', ',').replace(' ', ':')}>"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_busy_source_is_cut_in_its_tasks(spark):
    rows = spark.range(40_000).select(F.lit("a").alias("s"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).cast("int").alias("v"))
    cut = rows.mapInArrow(latest._trim("s", ["ts", "v"], 3), rows.schema)
    assert cut.count() <= 3 * 8 and cut.agg(F.max("ts")).collect() == rows.agg(F.max("ts")).collect()


def test_small_batches_are_cut_by_task(spark):
    rows = pa.table({"s": ["a"] * 60 + ["b", None, None, None], "ts": [*range(60), 7, 1, 2, None]})
    for held in (5, 1000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(latest, "HELD", held)
            made = list(latest._trim("s", ["ts"], 2)(iter(rows.to_batches(max_chunksize=4))))
        found = sorted((r["s"] or "", -1 if r["ts"] is None else r["ts"]) for b in made for r in b.to_pylist())
        assert {("", 1), ("", 2), ("a", 58), ("a", 59), ("b", 7)} <= set(found) and len(found) <= 6


def test_generated_stream(spark):
    path = fresh_path(spark, "rate")
    counts = rate_source(spark, 50).groupBy().count()
    query = start(write_table(counts, path, "complete"), "rate", fresh_path(spark, "ck"), "1 second")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.5)
    finally:
        query.stop()
    assert read_table(spark, path, "complete").collect()[0][0] > 0


def test_queries_are_found_by_name(spark, raw):
    path = fresh_path(spark, "bronze")
    raw.write.parquet(path)
    stream = spark.readStream.schema(raw.schema).parquet(path).groupBy("ingestion_id").count()
    first = start(write_table(stream, fresh_path(spark, "c"), "update"), "named", fresh_path(spark, "ck"), "1 second")
    assert start(write_table(stream, fresh_path(spark, "c"), "update"), "named", fresh_path(spark, "ck"), "1 second").id == first.id
    first.processAllAvailable()
    rows = stream_progress([first]).collect()
    assert sum(r.input_rows for r in rows) == 60 and rows[0].name == "named"
    assert stop(spark, "named") and find_query(spark, "named") is None and not stop(spark, "named")
