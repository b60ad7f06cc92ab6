"""Counts and ratios over bronze, silver and gold."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sensor_id, stable_avg


def readings_long(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """One row per number of each reading: ``(ingestion_id, metric, value, ts)``."""
    return df.select("ingestion_id", F.explode("normalized_data").alias("metric", "value"),
                     F.col("timestamp").alias("ts"), *keep)


def bronze_stats(df: DataFrame, file: Column | None = None) -> DataFrame:
    """Readings and files per source; ``file`` defaults to the path each row was read from."""
    path = F.col("_metadata.file_path") if file is None else file
    return (df.select("ingestion_id", path.alias("_file")).groupBy("ingestion_id", "_file")
            .agg(F.count("*").alias("n"))
            .groupBy("ingestion_id").agg(F.sum("n").alias("readings"), F.count("*").alias("files")))


def bronze_totals(stats: DataFrame) -> DataFrame:
    """Totals over ``bronze_stats``."""
    return stats.agg(F.sum("readings").alias("readings"), F.count("*").alias("sources"),
                     F.max("files").alias("most_files"))


def enrichment_summary(silver: DataFrame, gold: DataFrame, devices: DataFrame, minutes: int,
                       as_of: Column) -> DataFrame:
    """One row: recent readings and sensors in silver and gold, five sample sensors, devices. Each table is read once:
    the sample takes the counts per sensor that the totals take, and figures of one table come as one struct."""
    since = as_of.cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    recent = silver.where(F.col("ingest_ts") >= since).select(sensor_id().alias("sensorId"))
    by_sensor = recent.groupBy("sensorId").agg(F.count("*").alias("n")).where("n > 0")
    sample = by_sensor.orderBy("sensorId").limit(5).agg(
        F.array_join(F.array_sort(F.collect_list("sensorId")), ",").alias("sample")).scalar()
    averages = gold.where(F.col("time_start") >= since).agg(
        F.count("*").alias("rows"), F.count_distinct("sensorId").alias("sensors")).select(F.struct("rows", "sensors")).scalar()
    registered = devices.where("enabled").agg(
        F.count("*").alias("total"), F.max(F.col("ingestion_id").isNull()).alias("any")).select(F.struct("total", "any")).scalar()
    return by_sensor.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("recent_rows"),
                         F.count("*").alias("recent_sensors")).select(
        "recent_rows", "recent_sensors", F.coalesce(sample, F.lit("")).alias("sample_sensors"),
        averages["rows"].alias("gold_rows"), averages["sensors"].alias("gold_sensors"),
        registered["total"].alias("registered_total"),
        F.coalesce(registered["any"], F.lit(False)).alias("registered_any"))


def processing_metrics(df: DataFrame, time: str = "ingest_ts") -> DataFrame:
    """Readings, failures (nothing normalised), time span, rate and error share, in one pass."""
    failed = F.col("normalized_data").isNull() | (F.size("normalized_data") == 0)
    totals = df.agg(F.count("*").alias("records_processed"), F.count_if(failed).alias("records_failed"),
                    F.min(time).alias("earliest"), F.max(time).alias("latest"))
    seconds = (F.unix_micros("latest") - F.unix_micros("earliest")) / 1e6
    return totals.select(
        "records_processed", "records_failed", F.col("latest").alias("last_processing_time"),
        F.round(seconds, 2).alias("processing_duration_seconds"),
        F.round(F.try_divide("records_processed", seconds), 2).alias("records_per_second"),
        F.round(F.try_divide("records_failed", "records_processed") * 100, 2).alias("error_rate_percent"))


def source_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Readings per source; ``approx`` counts a tenth of the rows and scales up."""
    if approx:
        return df.sample(fraction=0.1, seed=42).groupBy("ingestion_id").agg(
            (F.count("*") * 10).alias("readings"))
    return df.groupBy("ingestion_id").agg(F.count("*").alias("readings"))


def field_coverage(df: DataFrame) -> DataFrame:
    """Per field: readings carrying it, and readings where it is a number."""
    numbers = F.map_keys("normalized_data")
    pairs = df.select(F.explode(F.array_union(F.map_keys("sensor_data"), numbers)).alias("field"),
                      "normalized_data")
    return pairs.groupBy("field").agg(
        F.count("*").alias("readings"),
        F.count_if(F.col("normalized_data")[F.col("field")].isNotNull()).alias("normalized"))


def data_quality(df: DataFrame) -> DataFrame:
    """One row: sources, readings, fields seen, fields normalised, share of the two.

    One pass: a reading gives a row per field and one without, counted per source and field; the rest is counted over that.
    """
    keys = F.array_union(F.map_keys("sensor_data"), F.map_keys("normalized_data"))
    fields = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(keys, F.array().cast("array<string>")))
    number = F.col("normalized_data")[F.col("field")].isNotNull()
    counted = (df.select("ingestion_id", F.explode(fields).alias("field"), "normalized_data")
               .groupBy("ingestion_id", "field").agg(F.count("*").alias("n"), F.max(number).alias("number")))
    source = F.col("field").isNull()
    return counted.agg(
        F.count_if(source).alias("unique_ingestion_ids"), F.coalesce(F.sum(F.when(source, F.col("n"))), F.lit(0)).alias("readings"),
        F.count_distinct("field").alias("fields_with_data"),
        F.count_distinct(F.when(F.col("number"), F.col("field"))).alias("fields_normalized")).withColumn(
        "schema_compliance_rate", F.round(F.try_divide("fields_normalized", "fields_with_data") * 100, 2))


def normalization_stats(rules: DataFrame) -> DataFrame:
    """Active rules, applications, canonical names, share of applications with a known last use."""
    used = F.when(F.col("last_applied_at").isNotNull(), F.col("applied_count"))
    return rules.where("enabled").agg(
        F.count("*").alias("active_rules"), F.coalesce(F.sum("applied_count"), F.lit(0)).alias("total_applied"),
        F.count_distinct("canonical_key").alias("canonical_fields"),
        F.round(F.try_divide(F.sum(used), F.sum("applied_count")) * 100, 2).alias("success_rate"))


def global_mean(df: DataFrame, value: str) -> DataFrame:
    return df.agg(stable_avg(F.col(value), scale=4).alias("mean"), F.count(value).alias("n"))


def hourly_mean(df: DataFrame, value: str, time: str) -> DataFrame:
    """Mean per date and hour of day, in time order."""
    return (df.groupBy(F.to_date(time).alias("date"), F.hour(time).alias("hour"))
            .agg(stable_avg(F.col(value)).alias("mean")).orderBy("date", "hour"))


def approx_files(df: DataFrame, time: str) -> DataFrame:
    """Approximate number of source files, and the latest time, in one pass."""
    return df.agg(F.approx_count_distinct("_metadata.file_path").alias("files"),
                  F.max(time).alias("latest"))


def append_quality_metrics(metrics: DataFrame, path: str) -> None:
    """Add rows ``(ingestion_id, metric_name, metric_value, measurement_time)`` to the log."""
    metrics.write.mode("append").parquet(path)


def quality_log(metrics: DataFrame, ingestion_id: str | None = None) -> DataFrame:
    """Measured metrics, newest first."""
    chosen = metrics if ingestion_id is None else metrics.where(F.col("ingestion_id") == ingestion_id)
    return chosen.orderBy(F.desc("measurement_time"), "ingestion_id", "metric_name")
