"""A city's sensor archive (CSV) as messages: filter, units, topics, ISO times."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_SCHEMA = ("timestamp string, node_id string, subsystem string, sensor string, parameter string, "
              "value_raw string, value_hrf string")

# Sensing subsystems (the rest is system telemetry), topic per parameter, and unit
# per subsystem, sensor and parameter.
SUBSYSTEMS = ("metsense", "chemsense", "lightsense", "alphasense", "plantower", "audio")
TOPIC_PREFIX = "smartcity/sensors/aot_"
# (parameter, topic)
TOPICS = (
    ("temperature", "smartcity/sensors/aot_temperature"),
    ("humidity", "smartcity/sensors/aot_humidity"),
    ("pressure", "smartcity/sensors/aot_pressure"),
    ("concentration", "smartcity/sensors/aot_air_quality"),
    ("intensity", "smartcity/sensors/aot_light"),
    ("ir_intensity", "smartcity/sensors/aot_light"),
    ("uv_intensity", "smartcity/sensors/aot_light"),
    ("visible_light_intensity", "smartcity/sensors/aot_light"),
    ("magnetic_field_x", "smartcity/sensors/aot_magnetic"),
    ("magnetic_field_y", "smartcity/sensors/aot_magnetic"),
    ("magnetic_field_z", "smartcity/sensors/aot_magnetic"),
    ("pm1", "smartcity/sensors/aot_particulates"),
    ("pm2_5", "smartcity/sensors/aot_particulates"),
    ("pm10", "smartcity/sensors/aot_particulates"),
    ("pm1_atm", "smartcity/sensors/aot_particulates"),
    ("pm25_atm", "smartcity/sensors/aot_particulates"),
    ("pm10_atm", "smartcity/sensors/aot_particulates"),
    ("bins", "smartcity/sensors/aot_particulates"),
    ("acceleration_x", "smartcity/sensors/aot_vibration"),
    ("acceleration_y", "smartcity/sensors/aot_vibration"),
    ("acceleration_z", "smartcity/sensors/aot_vibration"),
)
# (subsystem, sensor, parameter, unit)
UNITS = (
    ("metsense", "bmp180", "pressure", "hPa"),
    ("metsense", "bmp180", "temperature", "C"),
    ("metsense", "hih4030", "humidity", "RH"),
    ("metsense", "htu21d", "humidity", "RH"),
    ("metsense", "htu21d", "temperature", "C"),
    ("metsense", "mma8452q", "acceleration_x", "mg"),
    ("metsense", "mma8452q", "acceleration_y", "mg"),
    ("metsense", "mma8452q", "acceleration_z", "mg"),
    ("metsense", "pr103j2", "temperature", "C"),
    ("metsense", "spv1840lr5h_b", "intensity", "dB"),
    ("metsense", "tmp112", "temperature", "C"),
    ("metsense", "tsl250rd", "intensity", "uW/cm^2"),
    ("metsense", "tsys01", "temperature", "C"),
    ("chemsense", "at0", "temperature", "C"),
    ("chemsense", "at1", "temperature", "C"),
    ("chemsense", "at2", "temperature", "C"),
    ("chemsense", "at3", "temperature", "C"),
    ("chemsense", "co", "concentration", "ppm"),
    ("chemsense", "h2s", "concentration", "ppm"),
    ("chemsense", "lps25h", "pressure", "hPa"),
    ("chemsense", "lps25h", "temperature", "C"),
    ("chemsense", "no2", "concentration", "ppm"),
    ("chemsense", "o3", "concentration", "ppm"),
    ("chemsense", "oxidizing_gases", "concentration", "ppm"),
    ("chemsense", "reducing_gases", "concentration", "ppm"),
    ("chemsense", "sht25", "humidity", "RH"),
    ("chemsense", "sht25", "temperature", "C"),
    ("chemsense", "si1145", "ir_intensity", "uW/cm^2"),
    ("chemsense", "si1145", "uv_intensity", "uW/cm^2"),
    ("chemsense", "si1145", "visible_light_intensity", "uW/cm^2"),
    ("chemsense", "so2", "concentration", "ppm"),
    ("lightsense", "apds_9006_020", "intensity", "lux"),
    ("lightsense", "hih6130", "humidity", "RH"),
    ("lightsense", "hih6130", "temperature", "C"),
    ("lightsense", "hmc5883l", "magnetic_field_x", "mG"),
    ("lightsense", "hmc5883l", "magnetic_field_y", "mG"),
    ("lightsense", "hmc5883l", "magnetic_field_z", "mG"),
    ("lightsense", "ml8511", "intensity", "uW/cm^2"),
    ("lightsense", "mlx75305", "intensity", "uW/cm^2"),
    ("lightsense", "tmp421", "temperature", "C"),
    ("lightsense", "tsl250rd", "intensity", "uW/cm^2"),
    ("lightsense", "tsl260rd", "intensity", "uW/cm^2"),
    ("alphasense", "opc_n2", "bins", "counts"),
    ("alphasense", "opc_n2", "pm1", "ug/m^3"),
    ("alphasense", "opc_n2", "pm10", "ug/m^3"),
    ("alphasense", "opc_n2", "pm2_5", "ug/m^3"),
    ("plantower", "pms7003", "pm10_atm", "ug/m^3"),
    ("plantower", "pms7003", "pm1_atm", "ug/m^3"),
    ("plantower", "pms7003", "pm25_atm", "ug/m^3"),
)


def read_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """The archive as text columns; ``NA`` is null."""
    return spark.read.csv(path, schema=CSV_SCHEMA, header=True, nullValue="NA")


def sensor_slice(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Sensor readings of an archive, each with its topic and unit.

    The value is the human-readable one, else the raw one. ``max_rows`` takes the earliest rows.
    """
    spark = rows.sparkSession
    # broadcast: constants of a few dozen rows
    units = F.broadcast(spark.createDataFrame(UNITS, "subsystem string, sensor string, parameter string, unit string"))
    topics = F.broadcast(spark.createDataFrame(TOPICS, "parameter string, topic string"))
    kept = rows.where(F.col("subsystem").isin(*SUBSYSTEMS) & (F.col("parameter") != "id"))
    if max_rows is not None:
        kept = kept.orderBy("timestamp", "node_id", "sensor", "parameter").limit(max_rows)
    return (kept.join(units, ["subsystem", "sensor", "parameter"], "left").join(topics, "parameter", "left")
            .select(F.coalesce("topic", F.concat(F.lit(TOPIC_PREFIX), "parameter")).alias("topic"),
                    F.concat_ws("_", F.lit("aot"), "node_id", "sensor").alias("sensor_id"),
                    F.concat(F.translate("timestamp", "/", "-"), F.lit("Z")).alias("timestamp"),
                    "node_id", "subsystem", "sensor", "parameter",
                    F.coalesce("value_hrf", "value_raw").alias("value"),
                    F.coalesce("unit", F.lit("")).alias("unit"), "value_raw", "value_hrf"))


def sensor_slice_stats(messages: DataFrame) -> DataFrame:
    """Readings and distinct sensors, subsystems and nodes per topic."""
    return messages.groupBy("topic").agg(
        F.count("*").alias("n"), F.count_distinct("sensor").alias("sensors"),
        F.count_distinct("subsystem").alias("subsystems"), F.count_distinct("node_id").alias("nodes"))


def as_messages(messages: DataFrame) -> DataFrame:
    """``(topic, ts, value)`` with the reading under its parameter's name, ready for bronze."""
    named = F.create_map(F.col("parameter"), F.col("value"))
    fixed = F.create_map(*[x for c in ("sensor_id", "timestamp", "node_id", "subsystem", "sensor", "parameter", "unit")
                           for x in (F.lit(c), F.col(c))])
    return messages.select("topic", F.try_to_timestamp("timestamp").alias("ts"),
                           F.to_json(F.map_concat(fixed, named)).alias("value"))
