"""A table of micro-batches with a commit log: a batch counts once, however often it is written.

    <table>/published/batch_id=7/...   rows of batch 7, one folder moved into place as a whole
    <table>/_commits/7.json            the first finished attempt of batch 7, with what was counted while it was written
    <table>/_staged/...                attempts; those that lost stay here, unseen by readers
    <table>/packed/...                 batches rewritten in larger files, see ``compact``

An attempt is written aside, then entered in the log under the batch's number unless an entry is there, then the entry's
folder is moved to ``published``. A repeated batch finds its entry and only finishes what is left to do. Streams read
``published``, where no file is ever replaced; batch readers go through the log, which may point to packed files instead.
One driver writes a table at a time, as one streaming query does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import empty_frame
from ..storage import materialize

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
ENTRY = "kind string, batch_id long, last_id long, folder string, counts map<string,long>"


class Folder:
    """A folder in whatever store Spark's paths reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._root = self._path("")
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def put(self, name: str, text: str) -> bool:
        """Writes a file as a whole unless it is there; tells whether it did."""
        if self.exists(name):
            return False
        aside = f"_staged/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return self.move(aside, name)

    def move(self, name: str, to: str) -> bool:
        """Renames unless the name is taken; tells whether it did."""
        target = self._path(to)
        self._fs.mkdirs(target.getParent())
        return not self._fs.exists(target) and self._fs.rename(self._path(name), target)

    def sizes(self, name: str) -> tuple[int, int]:
        """(files, bytes) below a folder."""
        summary = self._fs.getContentSummary(self._path(name))
        return summary.getFileCount(), summary.getLength()

    def drop(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Partitioned writes inside take rows as they come, for tasks that hold one partition each: Spark would sort a task's
    rows by partition first, in memory that grows with the file. A task that does hold more is sorted from there on."""
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, "1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


class CommittedTable:
    """A table of batches under ``path``, partitioned by ``partitions`` within a batch."""

    def __init__(self, spark: SparkSession, path: str, partitions: Iterable[str] = ("ingestion_id",)):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), list(partitions)
        self._folder = Folder(spark, path)

    @property
    def published(self) -> str:
        """What streams read."""
        return f"{self.path}/published"

    def committed(self, batch_id: int) -> bool:
        return self._folder.exists(f"_commits/{batch_id}.json")

    def write(self, df: DataFrame, batch_id: int, counts: Callable[[], Mapping[str, int]] = dict) -> bool:
        """Writes a batch; ``counts()`` is asked for numbers once the rows are written. False if it was committed before."""
        first = False
        if not self.committed(batch_id):
            aside = f"_staged/{batch_id}-{uuid.uuid4().hex}"
            (df.hint("rebalance", *self.partitions).write.partitionBy(*self.partitions).parquet(f"{self.path}/{aside}"))
            first = self._enter(str(batch_id), kind="batch", batch_id=batch_id, last_id=batch_id, folder=aside, counts=dict(counts()))
        self._publish(batch_id)
        return first

    def _enter(self, name: str, **entry) -> bool:
        return self._folder.put(f"_commits/{name}.json", json.dumps(entry) + "\n")

    def _publish(self, batch_id: int) -> None:
        if not self._folder.exists(f"published/batch_id={batch_id}"):
            entry = self.log().where((F.col("kind") == "batch") & (F.col("batch_id") == batch_id)).first()
            self._folder.move(entry.folder, f"published/batch_id={batch_id}")

    def log(self) -> DataFrame:
        """The entries: ``batch`` for a batch, ``packed`` for a range of batches that one folder replaces."""
        if not self._folder.names("_commits"):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(f"{self.path}/_commits")

    def counts(self) -> DataFrame:
        """(batch_id, name, n): what was counted while each batch was written."""
        return self.log().where("kind = 'batch'").select("batch_id", F.explode("counts").alias("name", "n"))

    def snapshot(self) -> list[str]:
        """The folders that hold every published batch once; a batch after one that is not published yet waits for it."""
        entries = sorted(self.log().collect(), key=lambda e: (e.batch_id, -e.last_id))
        there = {int(name.partition("=")[2]) for name in self._folder.names("published") if name.startswith("batch_id=")}
        folders, done = [], -1
        for e in sorted(entries, key=lambda e: (e.batch_id, -e.last_id)):
            if e.batch_id <= done:
                continue
            if e.kind == "batch" and e.batch_id not in there:
                break
            folders.append(f"{self.path}/{e.folder if e.kind == 'packed' else f'published/batch_id={e.batch_id}'}")
            done = e.last_id
        return folders

    def read(self, schema: T.StructType) -> DataFrame:
        """All committed rows."""
        return self.read_folders(self.snapshot(), schema)

    def read_folders(self, folders: list[str], schema: T.StructType) -> DataFrame:
        """Rows of some folders of the table, without the columns of its layout."""
        reads = []
        for base in (self.published, f"{self.path}/packed"):
            own = [f for f in folders if f.startswith(f"{base}/")]
            if own:
                reads.append(self.spark.read.schema(schema).option("basePath", base).parquet(*own).select(*schema.fieldNames()))
        return reduce(DataFrame.unionAll, reads) if reads else empty_frame(self.spark, schema)

    def stream(self, schema: T.StructType, max_files: int = 500) -> DataFrame:
        """Committed rows as they come; packing does not show them again."""
        self._folder.put("published/_table", "")
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(self.published)

    def compact(self, file_bytes: int = 128 << 20, least: int = 2) -> int:
        """Rewrites the batches after the last packed one in files of about ``file_bytes``; returns how many batches it took.

        Each partition gets as many files as its bytes fill, so a busy source is spread and a quiet one has one file.
        The folders that streams read stay as they are; the new one is entered in the log as a whole.
        """
        entries = self.log().collect()
        after = max((e.last_id for e in entries if e.kind == "packed"), default=-1)
        names = {int(n.partition("=")[2]) for n in self._folder.names("published") if n.startswith("batch_id=")}
        batches = sorted(b for b in names if b > after)
        if len(batches) < least:
            return 0
        folders = [f"published/batch_id={b}" for b in batches]
        rows = self.spark.read.option("mergeSchema", "false").option("basePath", self.published).parquet(
            *[f"{self.path}/{f}" for f in folders]).drop("batch_id")
        parts = [F.col(p).alias(f"_{p}") for p in self.partitions]
        files = rows.select(*parts, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size")).distinct()
        shares = files.groupBy(*[f"_{p}" for p in self.partitions]).agg(
            F.greatest(F.lit(1), F.ceil(F.sum("_size") / file_bytes)).cast("int").alias("_files"))
        # a file number for each share of each partition; the rows of a partition are dealt over its files in turn
        start = (F.sum("_files").over(Window.orderBy(*[f"_{p}" for p in self.partitions])) - F.col("_files")).alias("_start")
        shares = materialize(shares.select("*", start), "packing")
        same = reduce(and_, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in self.partitions])
        number = F.col("_start") + F.pmod(F.monotonically_increasing_id(), F.col("_files"))
        dealt = rows.join(shares, same).withColumn("_number", number.cast("int"))
        total = shares.agg(F.sum("_files")).first()[0] or 1
        aside = f"packed/pack={batches[0]}-{batches[-1]}-{uuid.uuid4().hex}"
        packed = dealt.repartitionById(int(total), "_number").drop("_number", "_files", "_start", *[f"_{p}" for p in self.partitions])
        with unsorted_writes(self.spark):
            packed.write.partitionBy(*self.partitions).parquet(f"{self.path}/{aside}")
        self._enter(f"packed-{batches[0]}-{batches[-1]}", kind="packed", batch_id=batches[0], last_id=batches[-1], folder=aside, counts={})
        return len(batches)
