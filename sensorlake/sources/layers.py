"""Reading and writing the lake: bronze partitions, silver and gold tables, retention."""

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize_event_time, parse_timestamp
from ..operators.quality import readings_long
from ..plans.compute import check_dataset
from ..schema import LAYERS, check_stream_schema, empty_frame
from .commits import Folder

# Stream pacing and days kept per layer.
MAX_FILES_PER_TRIGGER = 500
RETENTION_DAYS = {"bronze": 7, "silver": 30, "gold": 90, "quality": 30}
PARTITIONS = ("ingestion_id", "date", "hour")


# ---------------------------------------------------------------- bronze

def bronze_columns(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Integers widened to double, and each row's own date and hour for the directory layout."""
    integers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in integers else F.col(f"`{c}`")
                       for c in df.columns])
    time = parse_timestamp(F.col("timestamp"), as_of)
    return wide.withColumns({"date": F.to_date(time), "hour": F.date_format(time, "HH")})


def write_bronze(df: DataFrame, path: str, as_of: Column | None = None, mode: str = "append",
                 partitions: Sequence[str] = PARTITIONS, max_records_per_file: int = 5_000_000) -> None:
    """Append readings under ``ingestion_id=/date=/hour=``.

    Rows are rebalanced by partition first: adaptive execution splits a busy source over several
    tasks and merges small ones, so there are neither giant nor tiny files. Leave ``hour`` out of
    ``partitions`` where sources send too little to fill a file an hour.
    """
    (bronze_columns(df, as_of).hint("rebalance", *partitions)
     .write.mode(mode).partitionBy(*partitions)
     .option("compression", "snappy").option("maxRecordsPerFile", max_records_per_file).parquet(path))


def read_bronze(spark: SparkSession, base: str, ingestion_id: str | None = None, date: str | None = None,
                hour: int | str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Bronze readings; the filters prune directories. Give the merged schema where it is known:
    without it Spark has to read the footers of all files."""
    reader = spark.read.option("basePath", base)
    df = (reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")).parquet(base)
    if ingestion_id is not None:
        df = df.where(F.col("ingestion_id") == ingestion_id)
    if date is not None:
        df = df.where(F.col("date") == F.lit(date).cast("date"))
    if hour is not None:  # a number where it is a directory, two digits where it is a column
        df = df.where(F.col("hour").cast("int") == int(hour))
    return df


def stream_bronze(spark: SparkSession, base: str, schema: T.StructType,
                  max_files: int = MAX_FILES_PER_TRIGGER, **options: str) -> DataFrame:
    """Bronze files as they land. A stream never infers: it gets the merged schema."""
    check_stream_schema(schema)
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=max_files, **options).parquet(base)


# ---------------------------------------------------------------- silver and gold

def read_layer(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of the lake, or an empty frame of its schema while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_frame(spark, schema)


def stream_layer(spark: SparkSession, path: str, schema: T.StructType,
                 max_files: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create the table, empty, unless it is there."""
    empty_frame(spark, schema).write.mode("ignore").parquet(path)


def resolve_dataset(name: str, paths: Mapping[str, str], spark: SparkSession) -> DataFrame:
    """The frame behind a data set name; ``paths`` has bronze, enriched, averages and alerts."""
    name = check_dataset(name)
    if name == "bronze":
        return read_bronze(spark, paths["bronze"])
    if name == "sensors":
        return readings_long(read_layer(spark, paths["enriched"], LAYERS["enriched"]))
    layer = {"silver": "enriched", "enriched": "enriched", "gold": "averages", "gold_temp_avg": "averages",
             "alerts": "alerts", "gold_alerts": "alerts"}[name]
    return read_layer(spark, paths[layer], LAYERS[layer])


def available_datasets(spark: SparkSession, paths: Mapping[str, str]) -> list[str]:
    """Layers that hold at least one file."""
    found = []
    for name, path in paths.items():
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
                .option("pathGlobFilter", "*.parquet").load(path)
            if not files.select("path").limit(1).isEmpty():
                found.append(name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


# ---------------------------------------------------------------- retention

def _oldest(df: DataFrame, layer: str, as_of: Column, devices: DataFrame | None) -> tuple[DataFrame, Column]:
    """The rows with their device's days, and the first day to keep."""
    days = F.lit(RETENTION_DAYS[layer])
    if devices is not None:
        own = devices.where("ingestion_id is not null").groupBy(F.lower(F.trim("ingestion_id")).alias("_device")) \
            .agg(F.min("retention_days").alias("_days"))
        df = df.join(own, F.lower(F.trim("ingestion_id")) == F.col("_device"), "left").drop("_device")
        days = F.coalesce("_days", days)
    else:
        df = df.withColumn("_days", F.lit(None).cast("int"))
    return df, F.date_sub(F.to_date(as_of), days)


def _day(df: DataFrame, time: str) -> Column:
    """The day of a time; of text or epoch seconds that are no time, null."""
    if isinstance(df.schema[time].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(time)
    return F.to_date(normalize_event_time(F.col(time), F.lit(None)))


def apply_retention(df: DataFrame, layer: str, as_of: Column, time: str = "timestamp",
                    devices: DataFrame | None = None) -> DataFrame:
    """Rows still to be kept: the layer's days, or the device's own (``retention_days``). Rows whose
    time does not parse stay. Name the ``date`` partition as ``time`` to prune directories."""
    rows, oldest = _oldest(df, layer, as_of, devices)
    day = _day(df, time)
    return rows.where(day.isNull() | oldest.isNull() | (day >= oldest)).drop("_days")


def expired_partitions(df: DataFrame, layer: str, as_of: Column, time: str = "date",
                       devices: DataFrame | None = None) -> DataFrame:
    """(source, date) directories that hold only expired rows, for the storage to drop."""
    rows, oldest = _oldest(df, layer, as_of, devices)
    day = _day(df, time)
    return rows.where(day < oldest).select("ingestion_id", day.alias("date")).distinct()


def partition_folders(spark: SparkSession, base: str, levels: Sequence[str] = ("ingestion_id", "date")) -> list[tuple]:
    """(value of each level, folder) of the folders ``a=x/b=y`` below a table: names only, no file is opened."""
    folder, found = Folder(spark, base), [((), "")]
    for level in levels:
        found = [((*values, unquote(name.partition("=")[2])), f"{path}/{name}".lstrip("/"))
                 for values, path in found for name in folder.names(path) if name.startswith(f"{level}=")]
    return [(*(None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values), path) for values, path in found]


def enforce_retention(spark: SparkSession, base: str, layer: str, as_of: Column, devices: DataFrame | None = None,
                      levels: Sequence[str] = ("ingestion_id", "date")) -> DataFrame:
    """Drops the expired day folders of a table that is partitioned by ``levels``, the last of which is ``date``.

    A day is dropped or kept as a whole, so no file is read or rewritten. Returns what was dropped: (levels, folder).
    Folders whose day does not parse stay.
    """
    schema = ", ".join(f"{c} string" for c in (*levels, "folder"))
    folders = spark.createDataFrame(partition_folders(spark, base, levels), schema)
    days = folders.withColumn("_day", F.col("date").try_cast("date"))
    if "ingestion_id" not in levels:
        days = days.withColumn("ingestion_id", F.lit(None).cast("string"))
    rows, oldest = _oldest(days, layer, as_of, devices)
    gone = rows.where(F.col("_day") < oldest).select(*levels, "folder").collect()
    folder = Folder(spark, base)
    for r in gone:
        folder.drop(r.folder)
    return spark.createDataFrame(gone, schema)


def rewrite_retention(df: DataFrame, base: str, layer: str, as_of: Column, time: str = "timestamp",
                      devices: DataFrame | None = None) -> list[str]:
    """Takes expired rows out of a table partitioned by ``ingestion_id`` only; ``df`` is its rows.

    Only sources that have expired rows are read again and replaced, by dynamic overwrite; one with nothing left loses
    its folder; rows without a source stay. Returns the sources that changed.
    """
    spark = df.sparkSession
    rows, oldest = _oldest(df, layer, as_of, devices)
    gone = _day(df, time) < oldest
    touched = rows.groupBy("ingestion_id").agg(F.count_if(gone).alias("gone"), F.count("*").alias("n")).where("gone > 0 and ingestion_id is not null").collect()
    partly = [r.ingestion_id for r in touched if r.gone < r.n]
    if partly:
        kept = apply_retention(df.where(F.col("ingestion_id").isin(partly)), layer, as_of, time, devices)
        (kept.select(*df.columns).hint("rebalance", "ingestion_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("ingestion_id").parquet(base))
    empty = {r.ingestion_id for r in touched if r.gone == r.n}
    for source, path in partition_folders(spark, base, ("ingestion_id",)):
        if source in empty:
            Folder(spark, base).drop(path)
    return sorted([*partly, *empty], key=str)
