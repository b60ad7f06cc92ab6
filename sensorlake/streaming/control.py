"""Starting, finding and watching streaming queries."""

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..sources.commits import Folder

PROGRESS_SCHEMA = """name string, id string, batch_id long, timestamp string, input_rows long,
    input_rows_per_second double, processed_rows_per_second double, batch_duration_ms long,
    state_rows long, dropped_late_rows long, sources string, sink string, error string"""


def find_query(spark: SparkSession, name: str) -> StreamingQuery | None:
    return next((q for q in spark.streams.active if q.name == name), None)


def start(writer: DataStreamWriter, name: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Start a named query, or return the one already running under that name.

    Without ``trigger`` it takes what is there now, in batches, and ends.
    """
    spark = SparkSession.getActiveSession()
    running = find_query(spark, name) if spark else None
    if running is not None:
        return running
    pace = {"processingTime": trigger} if trigger else {"availableNow": True}
    return writer.queryName(name).option("checkpointLocation", checkpoint).trigger(**pace).start()


def stop(spark: SparkSession, name: str) -> bool:
    query = find_query(spark, name)
    if query is None:
        return False
    query.stop()
    return True


def write_table(df: DataFrame, path: str, mode: str = "append") -> DataStreamWriter:
    """A writer of a streaming frame into a table folder.

    Appended rows go to the Parquet sink, which keeps its own exactly-once log. A 'complete' or
    'update' result goes to a directory per batch, which a repeated batch replaces;
    ``read_table`` puts such a table together.
    """
    if mode == "append":
        return df.writeStream.outputMode("append").format("parquet").option("path", path)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return df.writeStream.outputMode(mode).foreachBatch(write_batch)


def read_table(spark: SparkSession, path: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """What ``write_table`` wrote: all rows, the last complete result, or the last row per key."""
    df = spark.read.parquet(path)
    if mode == "append":
        return df
    if mode == "complete":
        last = df.agg(F.max("batch_id")).scalar()
        return df.where(F.col("batch_id") == last).drop("batch_id")
    values = [c for c in df.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def _progress_row(p: dict, error: str | None = None) -> dict:
    state = p.get("stateOperators", [])
    return {"name": p.get("name"), "id": p["id"], "batch_id": p["batchId"], "timestamp": p["timestamp"], "input_rows": p["numInputRows"],
            "input_rows_per_second": p.get("inputRowsPerSecond"), "processed_rows_per_second": p.get("processedRowsPerSecond"),
            "batch_duration_ms": p["durationMs"].get("triggerExecution"), "state_rows": sum(s["numRowsTotal"] for s in state),
            "dropped_late_rows": sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
            "sources": ", ".join(s["description"] for s in p["sources"]), "sink": p["sink"]["description"], "error": error}


class ProgressTable(StreamingQueryListener):
    """A listener that appends every update of every query to a table, however many there are.

    Updates are written a file for ``every`` of them, and when a query ends. Use it as a context: it listens inside,
    and has written everything on leaving. An update that is told twice is one row.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self._spark, self.path, self._every = spark, path, every
        self._folder, self._lock = Folder(spark, path), threading.Condition()
        self._rows: list[dict] = []
        self._running: set[str] = set()
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self._rows.append(_progress_row(json.loads(event.progress.json)))
            if len(self._rows) >= self._every:
                self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            if event.exception:
                self._rows.append({"id": str(event.id), "error": event.exception})
            self._flush()
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def _flush(self) -> None:
        if self._rows:
            self._folder.put(f"{uuid.uuid4().hex}.json", "".join(json.dumps(r) + "\n" for r in self._rows))
            self._rows = []

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until everything that an ended query has said is in the table."""
        with self._lock:
            if not self._lock.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError(f"no end of {query.name} was told")

    def __enter__(self) -> "ProgressTable":
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)
        with self._lock:
            self._flush()

    def read(self) -> DataFrame:
        """One row per micro-batch, and one with the error of each query that failed."""
        if not self._folder.names():
            return self._spark.createDataFrame([], PROGRESS_SCHEMA)
        return self._spark.read.schema(PROGRESS_SCHEMA).json(self.path).dropDuplicates(["id", "batch_id", "timestamp"])


def stream_progress(queries: list[StreamingQuery]) -> DataFrame:
    """One row per finished micro-batch of the given queries, as far back as Spark remembers; ``ProgressTable`` keeps all."""
    rows = []
    for q in queries:
        error = str(q.exception()) if not q.isActive and q.exception() else None
        progress = (json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress)
        rows += [_progress_row(p | {"name": q.name, "id": q.id}, error) for p in progress]
    names = [c.split()[0] for c in PROGRESS_SCHEMA.split(",")]
    return SparkSession.getActiveSession().createDataFrame([tuple(r[n] for n in names) for r in rows], PROGRESS_SCHEMA)


def rate_source(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """Spark's built-in test source: ``(timestamp, value)``."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


