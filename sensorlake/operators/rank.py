"""Newest rows per source, recent windows, pages."""

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..storage import fresh_path

# Above this size Spark no longer trims groups inside each task before the shuffle.
_TRIMMED_IN_TASKS = 1000
_SALTS = 64


def top_per_group(df: DataFrame, keys: Iterable[str], order: Iterable[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group in ``order``, however large a group is.

    For small ``n`` Spark keeps only ``n`` rows per group and task before shuffling. For larger
    ones a group is first spread over salted parts, and only the parts' leaders meet.
    """
    keys, order = list(keys), list(order)
    if n > _TRIMMED_IN_TASKS:
        # by task, not by content: copies of one row must not end up in one part
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
        part = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= n) \
            .drop("_place", "_salt")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def latest_per_source(df: DataFrame, time: str, n: int = 100, source: str = "ingestion_id",
                      tie_break: Iterable[str] = ()) -> DataFrame:
    """The newest ``n`` rows of every source."""
    return top_per_group(df, [source], [F.desc(time), *[F.desc(c) for c in tie_break]], n)


def topic_analysis(df: DataFrame, time: str, tie_break: Iterable[str] = (), last: int = 10,
                   samples: int = 3) -> DataFrame:
    """Topics, sensors and sample payloads among the last messages of every source
    (``ingestion_id, topic, value``). Every list holds at most ``last`` entries."""
    newest = latest_per_source(df, time, last, tie_break=tie_break)
    sensor = F.coalesce(F.get_json_object("value", "$.sensor_id"), F.get_json_object("value", "$.sensorId"))
    in_order = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), *tie_break, "value")))
    return newest.withColumn("_sensor", sensor).groupBy("ingestion_id").agg(
        F.count("*").alias("messages"), F.array_sort(F.collect_set("topic")).alias("topics"),
        F.array_sort(F.collect_set("_sensor")).alias("sensor_ids"),
        F.transform(F.slice(F.reverse(in_order), 1, samples), lambda s: s["value"]).alias("samples"))


def topic_sources(df: DataFrame) -> DataFrame:
    """Distinct (topic, source) pairs."""
    return df.select("topic", "ingestion_id").distinct()


def last_n_points(df: DataFrame, time: str, n: int, tie_break: Iterable[str] = ()) -> DataFrame:
    """The last ``n`` points in ascending order; 0 means all."""
    if n <= 0:
        return df.orderBy(time, *tie_break)
    return df.orderBy(F.desc(time), *[F.desc(c) for c in tie_break]).limit(n).orderBy(time, *tie_break)


def recent(df: DataFrame, time: str, minutes: int, as_of: Column | None = None) -> DataFrame:
    """Rows of the last ``minutes``, oldest first. The bound reaches the scan as a filter."""
    now = F.current_timestamp() if as_of is None else as_of
    return df.where(F.col(time) >= now - F.make_dt_interval(mins=F.lit(minutes))).orderBy(time)


def recent_averages(gold: DataFrame, minutes: int = 30, as_of: Column | None = None) -> DataFrame:
    return recent(gold, "time_start", minutes, as_of)


def recent_alerts(gold: DataFrame, minutes: int = 60, as_of: Column | None = None) -> DataFrame:
    return recent(gold, "event_time", minutes, as_of)


def paginate(df: DataFrame, order: Iterable[Column], page: int = 1, size: int = 100) -> DataFrame:
    """One page (counted from 1) with the total, over all pages, as a column."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total_items", total)


class Pages:
    """A table sorted once, for pages at any depth.

    Rows are dealt into ranges of about ``part_rows`` in the order and counted per range, so that a page reads
    only the ranges it lies in, whatever comes before it. Give an order without ties: rows that it can't tell apart
    share a range.
    """

    def __init__(self, df: DataFrame, order: Iterable[Column], part_rows: int = 100_000):
        self._order, self._spark = list(order), df.sparkSession
        self.path = fresh_path(self._spark, "pages")
        parts = max(1, math.ceil(df.count() / part_rows))
        df.repartitionByRange(parts, *self._order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(self.path)
        self._schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])
        counts = self._table().groupBy("_part").count().collect()
        self._counts = sorted((r["_part"], r["count"]) for r in counts)
        self.total = sum(n for _, n in self._counts)

    def _table(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self.path)

    def parts(self, page: int, size: int) -> tuple[list[int], int]:
        """The ranges that a page lies in, and how many of their rows come before it."""
        start, end = (page - 1) * size, page * size
        chosen, before, seen = [], 0, 0
        for part, n in self._counts:
            if seen < end and start < seen + n:
                before = start - seen if not chosen else before
                chosen.append(part)
            seen += n
        return chosen, before

    def page(self, page: int = 1, size: int = 100) -> DataFrame:
        """One page (counted from 1) with the total, over all pages, as a column."""
        chosen, before = self.parts(page, size)
        rows = self._table().where(F.col("_part").isin(chosen)).drop("_part")
        return rows.orderBy(*self._order).offset(before).limit(size).withColumn("total_items", F.lit(self.total).cast("long"))


def first_per_type(computations: DataFrame, types: Iterable[str], fallback_type: str = "table") -> DataFrame:
    """For each tile type the first computation (``id, tile_type``) recommended for it, else the
    first of all; unknown types count as ``fallback_type``."""
    types = list(types)
    kind = F.when(F.col("tile_type").isin(*types), F.col("tile_type")).otherwise(fallback_type)
    # one pass: the lowest id of each type as a column, then a row per type
    firsts = computations.agg(F.min("id").alias("_any"), *[
        F.min(F.when(kind == t, F.col("id"))).alias(f"_first{i}") for i, t in enumerate(types)])
    rows = F.array(*[F.struct(F.lit(t).alias("tile_type"), F.coalesce(f"_first{i}", "_any").alias("computation_id"))
                     for i, t in enumerate(types)])
    return firsts.select(F.explode(rows).alias("_r")).select("_r.*")
