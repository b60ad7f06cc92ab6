"""Registered devices: who may send, who is missing, who sends without being registered."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sensor_id


def _normal(name: str):
    return F.lower(F.trim(F.col(name)))


def allowed_ids(devices: DataFrame) -> DataFrame:
    """Distinct, cleaned ids of enabled devices; blanks and 'unknown' do not count."""
    return devices.where("enabled").select(_normal("ingestion_id").alias("device_id")) \
        .where("device_id not in ('', 'unknown')").distinct()


def _wildcard(devices: DataFrame):
    """Scalar: is there an enabled registration without an id, accepting every source?"""
    return F.coalesce(devices.where("enabled").agg(F.max(F.col("ingestion_id").isNull())).scalar(),
                      F.lit(False))


#: ids up to which the registered ones are sent to every task; more are joined by a shuffle
BROADCAST_IDS = 100_000


def registered_only(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows whose source is an enabled device; nothing registered keeps nothing.

    The device table is read once, for whether a registration accepts every source and for how many ids there are: that
    many at most are broadcast, so that readings stay where they are.
    """
    enabled = devices.where("enabled")
    seen = enabled.agg(F.max(F.col("ingestion_id").isNull()).alias("any"), F.count_distinct(_normal("ingestion_id")).alias("ids")).first()
    if seen["any"]:
        return df
    allowed = allowed_ids(devices)
    if seen["ids"] <= BROADCAST_IDS:
        allowed = F.broadcast(allowed)
    keyed = df.withColumn("_device", _normal("ingestion_id"))
    return keyed.join(allowed, keyed["_device"] == F.col("device_id"), "left_semi").drop("_device")


def unlinked_devices(devices: DataFrame, links: DataFrame) -> DataFrame:
    """A warning row per owned device (``owner, ingestion_id, name``) absent from ``links``."""
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("ingestion_id"))
    return (devices.where("ingestion_id <> ''")
            .join(links.select("ingestion_id"), "ingestion_id", "left_anti")
            .select("owner", F.concat(F.lit("unlinked-"), "ingestion_id").alias("id"),
                    F.concat(F.lit('"'), label, F.lit('" is not linked to any building.'))
                    .alias("message"),
                    F.lit("warning").alias("variant")))


def sensors_per_source(df: DataFrame) -> DataFrame:
    """Distinct known sensors and readings of each source of a union frame."""
    own = sensor_id(fallback=False)
    return (df.select("ingestion_id", own.alias("sensorId"))
            .groupBy("ingestion_id", "sensorId").agg(F.count("*").alias("n"))
            .groupBy("ingestion_id")
            .agg(F.sum("n").alias("readings"),
                 F.count_if(F.col("sensorId") != "unknown").alias("sensors")))


def unregistered_sources(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Sources in the data that no enabled device names."""
    seen = df.groupBy("ingestion_id").agg(F.count("*").alias("readings"))
    named = devices.where("enabled").select("ingestion_id")
    return seen.join(named, "ingestion_id", "left_anti")


def unseen_devices(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Enabled devices that sent nothing."""
    seen = df.select("ingestion_id").distinct()
    named = devices.where("enabled and ingestion_id is not null").select("ingestion_id").distinct()
    return named.join(seen, "ingestion_id", "left_anti")


def diagnose_registration(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Findings ``(issue, ingestion_id, n)``: wildcards, mismatches both ways, shared sources.

    Readings are counted once by source and sensor; every finding starts from those counts.
    """
    enabled = devices.where("enabled")
    wildcard = _wildcard(devices)
    counted = (df.select("ingestion_id", sensor_id(fallback=False).alias("sensorId"))
               .groupBy("ingestion_id", "sensorId").agg(F.count("*").alias("n")).where("n > 0"))
    by_source = counted.groupBy("ingestion_id").agg(
        F.sum("n").alias("readings"), F.count_if(F.col("sensorId") != "unknown").alias("sensors")).where("readings > 0")
    named = enabled.select("ingestion_id")
    unregistered = by_source.join(named, "ingestion_id", "left_anti")
    unseen = named.where("ingestion_id is not null").distinct().join(by_source, "ingestion_id", "left_anti")

    def finding(frame: DataFrame, issue: str, n) -> DataFrame:
        return frame.select(F.lit(issue).alias("issue"), "ingestion_id", n.cast("long").alias("n"))

    total = counted.where("sensorId <> 'unknown'").groupBy("sensorId").agg(F.sum("n").alias("n")).agg(F.count("*").alias("sensors"))
    registered = enabled.agg(F.count("*")).scalar()
    mismatch = total.where((F.col("sensors") > registered) & ~wildcard) \
        .withColumn("ingestion_id", F.lit(None).cast("string"))
    return (finding(enabled.where("ingestion_id is null"), "wildcard", F.lit(1))
            .unionByName(finding(unregistered, "unregistered", F.col("readings")))
            .unionByName(finding(unseen, "unseen", F.lit(0)))
            .unionByName(finding(by_source.where("sensors > 1"), "several_sensors", F.col("sensors")))
            .unionByName(finding(mismatch, "fewer_devices_than_sensors", F.col("sensors"))))
