"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sensorlake import demo  # noqa: E402
from sensorlake.demo import views as v  # noqa: E402
from sensorlake.operators.normalize import lower_columns, to_union, to_union_fixed  # noqa: E402
from sensorlake.storage import fresh_path  # noqa: E402
from sensorlake.streaming.enrich import accept, enrich  # noqa: E402

HEADLINE = [
    "registered_hourly_average", "to_union", "to_union_with_rules", "normalize_union", "registered_only",
    "transform_chain", "vt_aggregate", "dsl_groupby", "dsl_window", "dsl_topk", "ex_daily_summary",
    "ex_window_avg", "ex_threshold_throttled", "sensitivity", "dataset_profile", "field_profile",
    "merged_schema", "data_quality", "field_coverage", "message_rate", "rate_by_error",
    "latency_percentiles", "value_percentiles", "latency_histogram", "latest_per_source",
    "topic_analysis", "threshold_alerts", "graph_sensor_context", "graph_city_overview",
    "graph_delete_cascade", "dependents", "sensor_slice", "parse_messages", "stream_enrich",
    "stream_window_avg", "reprocess",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def best(run, times: int = 2) -> float:
    return round(min(seconds(run) for _ in range(times)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("sensorlake-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    runs = demo.queries()
    times = {name: best(lambda name=name: runs[name](spark, sf_dir)) for name in HEADLINE}

    # enrichment throughput: readings as they lie in bronze, on all cores, a million of them
    readings = lower_columns(v.bronze(spark, sf_dir))
    copies = max(1, 1_000_000 // readings.count())
    many = readings.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy", "event_id")
    path = fresh_path(spark, "bench-bronze")
    many.repartition(int(cpus) * 2).write.parquet(path)
    bronze = spark.read.parquet(path)
    n = bronze.count()
    rules, devices = v.rules(spark), v.devices(spark)
    rates = {
        "dynamic_schema": lambda: to_union(bronze, rules=rules),
        "fixed_schema": lambda: to_union_fixed(bronze),
        "full_enrichment": lambda: accept(enrich(bronze, rules), devices, []),
    }
    rows_per_second = {name: round(n / best(run, 3)) for name, run in rates.items()}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                      "rows_per_second": rows_per_second, "rows": n, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
