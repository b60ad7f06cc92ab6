"""Files of the lake as rows: listing, size classes, previews, samples of the newest."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size classes in bytes.
LARGE, MEDIUM = 10240, 1024

_ORDER = {"name": "path", "size": "length", "date": "modificationTime"}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modificationTime)`` of every file below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root) \
        .select("path", "length", "modificationTime")


def file_inventory(spark: SparkSession, root: str, min_size: int = 0, max_size: int | None = None,
                   suffix: str | None = None, sort_by: str = "name", order: str = "asc",
                   page: int = 1, page_size: int = 100) -> DataFrame:
    """One page of the listing, filtered by size and suffix, with the total as a column."""
    files = list_files(spark, root).where(F.col("length") >= min_size)
    if max_size is not None:
        files = files.where(F.col("length") <= max_size)
    if suffix:
        files = files.where(F.lower("path").endswith("." + suffix.lower().lstrip(".")))
    key = F.col(_ORDER[sort_by])
    total = files.agg(F.count("*")).scalar()
    return files.orderBy(key.desc() if order == "desc" else key.asc(), "path") \
        .offset((page - 1) * page_size).limit(page_size).withColumn("total_items", total)


def size_class(length: Column) -> Column:
    return F.when(length > LARGE, "large").when(length > MEDIUM, "medium").otherwise("small")


def size_classes(files: DataFrame) -> DataFrame:
    """Files and bytes per size class."""
    return files.groupBy(size_class(F.col("length")).alias("size_class")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))


def preview(df: DataFrame, n: int = 50) -> tuple[list[tuple[str, str]], DataFrame]:
    """Column names and types, and the first ``n`` rows."""
    return df.dtypes, df.limit(n)


def sample_latest_files(spark: SparkSession, root: str, max_files: int = 10, limit: int = 100) -> DataFrame:
    """Up to ``limit`` rows of the newest Parquet files below ``root`` (by path, as directories
    carry date and hour). Only the chosen files are read."""
    newest = list_files(spark, root).where(F.endswith("path", F.lit(".parquet"))) \
        .orderBy(F.desc("path")).limit(max_files).collect()
    if not newest:
        raise ValueError(f"no Parquet files below {root}")
    path = F.col("_metadata.file_path")
    return spark.read.parquet(*[f.path for f in newest]).select("*", path.alias("_source_file"),
                       F.regexp_extract(path, "ingestion_id=([^/]+)", 1).alias("_ingestion_id")).limit(limit)
