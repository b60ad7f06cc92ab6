"""Windowed averages and threshold alerts: the same plan for a batch and for a stream."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract_field, sensor_id, stable_avg, valid_reading

# Fixed values of the gold layer.
WINDOW = "1 minute"
WATERMARK = "2 minutes"
THRESHOLD = 30.0
ALERT_TYPE = "TEMP_OVER_LIMIT"


def sensor_readings(df: DataFrame, field: str = "temperature") -> DataFrame:
    """Valid readings of one field of an enriched frame: sensorId, the field, both times."""
    return df.select(sensor_id().alias("sensorId"), extract_field(field).alias(field),
                     "event_time", "ingest_ts").where(valid_reading(F.col(field)))


def windowed_average(df: DataFrame, field: str = "temperature", window: str = WINDOW,
                     slide: str | None = None, watermark: str | None = WATERMARK,
                     time: str = "ingest_ts", name: str = "avg_temp") -> DataFrame:
    """Mean of a field per sensor and window, rounded to cents.

    On a stream the watermark bounds the state: rows later than it are dropped, closed windows
    leave. Partial sums are taken before the shuffle, so one busy sensor costs one row per task
    and window.
    """
    rows = sensor_readings(df, field)
    if rows.isStreaming and watermark:
        rows = rows.withWatermark(time, watermark)
    return (rows.groupBy(F.window(time, window, slide).alias("_window"), "sensorId")
            .agg(stable_avg(F.col(field)).alias(name), F.min(time).alias("min_enrichment_ts"))
            .select("sensorId", F.col("_window.start").alias("time_start"), name,
                    "min_enrichment_ts"))


def threshold_alerts(df: DataFrame, threshold: float | Column = THRESHOLD, field: str = "temperature",
                     mode: str = "period", period: str = WINDOW,
                     watermark: str | None = WATERMARK) -> DataFrame:
    """Readings above a threshold, throttled.

    'period' gives one alert per sensor and period (the highest reading), with bounded state.
    'once' gives one alert per sensor for ever: in a batch its earliest reading over the limit,
    on a stream the first to arrive, with state that grows with the number of sensors.
    """
    hot = sensor_readings(df, field).where(F.col(field) > threshold)
    if mode == "once":
        if hot.isStreaming:
            one = hot.dropDuplicates(["sensorId"])
        else:
            first = F.min_by(F.struct(field, "event_time"), F.struct("event_time", field))
            one = hot.groupBy("sensorId").agg(first.alias("_first")).select("sensorId", "_first.*")
        return one.select("sensorId", field, "event_time", F.lit(ALERT_TYPE).alias("alert_type"))
    if mode != "period":
        raise ValueError("mode is 'period' or 'once'")
    if hot.isStreaming and watermark:
        hot = hot.withWatermark("ingest_ts", watermark)
    return (hot.groupBy(F.window("ingest_ts", period).alias("_window"), "sensorId")
            .agg(F.max(field).alias(field), F.max("event_time").alias("event_time"))
            .select("sensorId", field, "event_time", F.lit(ALERT_TYPE).alias("alert_type")))
