"""Bronze stream to silver table: layout, renaming, metadata, registration, value rules."""

from collections.abc import Callable, Iterable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.devices import registered_only
from ..operators.normalize import add_enrichment_metadata, lower_columns, to_union, to_union_fixed
from ..operators.transform import apply_transformations
from ..sources.commits import CommittedTable


def enrich(df: DataFrame, rules: DataFrame | Mapping[str, str] | None, as_of: Column | None = None,
           fixed: bool = False) -> DataFrame:
    """Raw readings to enriched rows: the row-wise part, the same for a batch and a stream.

    ``fixed`` skips type patterns and rules, for sources whose layout is known.
    """
    lowered = lower_columns(df)
    union = to_union_fixed(lowered) if fixed else to_union(lowered, rules=rules)
    return add_enrichment_metadata(union, as_of)


def accept(df: DataFrame, devices: DataFrame | None, transformations: Iterable[Mapping],
           on_missing: str = "drop", usage: dict[int, Observation] | None = None) -> DataFrame:
    """The part that depends on registrations and value rules."""
    known = df if devices is None else registered_only(df, devices)
    return apply_transformations(known, transformations, on_missing=on_missing, usage=usage)


def _counted(observation: Observation) -> int:
    """The observed count, or 0 if the counter is gone: a filter known to keep nothing (no device registered) removes its
    whole input from the plan."""
    try:
        return observation.get["n"] or 0
    except Py4JJavaError:
        return 0


class SilverWriter:
    """foreachBatch target: re-reads devices and value rules, filters, transforms, commits.

    Rows in and out and the uses of every value rule are counted by the write itself and entered in the table's commit
    log, so that a batch counts once, in the rows and in the numbers. Nothing grows on the driver.
    """

    def __init__(self, path: str, devices: Callable[[], DataFrame | None],
                 transformations: Callable[[], Iterable[Mapping]] = tuple, on_missing: str = "drop"):
        self.path, self.devices, self.transformations = path, devices, transformations
        self.on_missing = on_missing

    def table(self, spark: SparkSession) -> CommittedTable:
        return CommittedTable(spark, self.path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        received, written, usage = Observation(), Observation(), {}
        rows = batch.observe(received, F.count("*").alias("n"))
        rows = accept(rows, self.devices(), self.transformations(), self.on_missing, usage)
        rows = rows.observe(written, F.count("*").alias("n")).withColumn("enrichment_timestamp", F.current_timestamp())

        def counts() -> dict[str, int]:
            return {"received": _counted(received), "written": _counted(written)} | {f"rule {i}": _counted(o) for i, o in usage.items()}

        self.table(batch.sparkSession).write(rows, batch_id, counts)


def value_rule_usage(table: CommittedTable) -> DataFrame:
    """(rule_id, applied_count, batches, last_batch) over all committed batches, from the log alone."""
    uses = table.counts().where(F.col("name").startswith("rule ") & (F.col("n") > 0))
    return uses.groupBy(F.substring("name", 6, 20).cast("long").alias("rule_id")).agg(
        F.sum("n").alias("applied_count"), F.count("*").alias("batches"), F.max("batch_id").alias("last_batch"))


def batch_counts(table: CommittedTable) -> DataFrame:
    """(batch_id, received, written) of all committed batches, from the log alone."""
    return table.counts().groupBy("batch_id").agg(*[F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in ("received", "written")])


def enrichment_stream(raw: DataFrame, rules: DataFrame | Mapping[str, str] | None, writer: SilverWriter,
                      as_of: Column | None = None, fixed: bool = False) -> DataStreamWriter:
    """The enrichment of a raw stream; rename rules are read when the plan is built, devices and
    value rules with every batch."""
    return enrich(raw, rules, as_of, fixed).writeStream.foreachBatch(writer)
