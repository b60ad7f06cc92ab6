"""Where checkpoints and intermediate tables go: a folder every executor can reach."""

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for an unconfigured local run."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_dir()
    raise RuntimeError(f"set {_SETTING} to a folder shared by all executors")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
