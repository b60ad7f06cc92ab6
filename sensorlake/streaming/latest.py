"""The newest rows of every source, held in the state of a stream.

State is one list per source in the state store: a batch reads and writes only the sources it brings rows of, and an event
timer ends a source that has fallen silent. The table is the state itself, read with Spark's state reader, so a
lost output folder loses nothing and a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: rows that a task gathers before it cuts them, and rows of many sources that it holds on to
HELD = 10_000
CHANGES = "status string, held int, newest timestamp"


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that lists and timers need; the session stays as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _nested(field: T.StructField) -> bool:
    """The Python side of the state writes plain values only."""
    return isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))


def _trim(source: str, order: list[str], n: int):
    """Keeps the newest n rows of every source of each task: a busy source sends few rows to its state. Sources that together
    fill more than HELD rows are let go and begin anew, so that a task's memory is bounded."""
    def newest(table: pa.Table) -> pa.Table:
        codes = pc.dictionary_encode(table[source].combine_chunks(), null_encoding="encode").indices
        by = pc.sort_indices(pa.table({"_source": codes, **{c: table[c] for c in order}}),
                             sort_keys=[("_source", "ascending"), *[(c, "descending") for c in order]], null_placement="at_end")
        sorted_codes = codes.to_numpy(zero_copy_only=False)[by.to_numpy()]
        first = np.searchsorted(sorted_codes, sorted_codes)
        keep = np.flatnonzero(np.arange(len(sorted_codes)) - first < n)
        return table.take(by.take(pa.array(keep))).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, rows = None, [], 0
        for batch in batches:
            more.append(batch)
            rows += batch.num_rows
            if rows < HELD:
                continue
            held = newest(pa.Table.from_batches([*(held.to_batches() if held is not None else []), *more]))
            more, rows = [], 0
            if held.num_rows >= HELD:
                yield from held.to_batches()
                held = None
        if held is not None or more:
            yield from newest(pa.Table.from_batches([*(held.to_batches() if held is not None else []), *more])).to_batches()
    return run


class _Newest(StatefulProcessor):
    """List state of at most n rows of a source; a timer that asks at the end of its silence whether it is over."""

    def __init__(self, schema: T.StructType, time: str, order: list[str], n: int):
        self._schema, self._time, self._order, self._n = schema, time, order, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", self._schema)

        self._times = [isinstance(f.dataType, T.TimestampType) for f in self._schema.fields]
        self._make = Row(*self._schema.fieldNames())

    def _utc(self, row: Iterable) -> Row:
        """Times of input rows carry a zone, those of the state do not: all get one, to be compared."""
        return self._make(*[x.astimezone(timezone.utc) if zoned and x is not None else x
                            for x, zoned in zip(row, self._times, strict=True)])

    def _held(self) -> list[Row]:
        return [self._utc(r) for r in self._rows.get()] if self._rows.exists() else []

    def _rank(self, row: Row) -> tuple:
        return tuple((row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in self._order)

    def _millis(self, rows: list[Row]) -> int:
        newest = max(r[self._time] for r in rows)
        newest = newest if newest.tzinfo else newest.replace(tzinfo=timezone.utc)
        return int(newest.timestamp() * 1000)

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        newest = heapq.nlargest(self._n, [*self._held(), *map(self._utc, rows)], key=self._rank)
        self._rows.put([tuple(r) for r in newest])
        last = self._millis(newest)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(last + 1)
        yield self._change(key, "active", len(newest), last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        last = self._millis(held) if held else None
        if last is not None and last >= timerValues.getCurrentWatermarkInMs():
            self._handle.registerTimer(last + 1)
            return
        self._rows.clear()
        yield self._change(key, "left", 0, last)

    @staticmethod
    def _change(key: tuple, status: str, held: int, last: int | None) -> Row:
        newest = None if last is None else datetime.fromtimestamp(last / 1000, timezone.utc)
        return Row(source=key[0], status=status, held=held, newest=newest)

    def close(self) -> None:
        pass


def newest_per_source(stream: DataFrame, time: str, n: int = 100, source: str = "ingestion_id",
                      tie_break: Iterable[str] = (), silent: str = "5 minutes") -> DataFrame:
    """A stream of changes (source, status, held, newest): its state holds the newest n rows of every source.

    Rows are first cut to n per source in each task. A source leaves once its newest row is older than the newest
    of all by more than ``silent``; rows older than that when they arrive are dropped, as are rows without a time.
    Write the changes in update mode; read the rows with ``newest_rows``. Structs, lists and maps
    are held as JSON.
    """
    order = [time, *tie_break]
    stream = stream.select(*[F.to_json(f"`{f.name}`", _JSON).alias(f.name) if _nested(f) else F.col(f"`{f.name}`") for f in stream.schema.fields])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields])
    rows = stream.where(F.col(time).isNotNull()).mapInArrow(_trim(source, order, n), schema).withWatermark(time, silent)
    changes = f"source {stream.schema[source].dataType.simpleString()}, {CHANGES}"
    return rows.groupBy(source).transformWithState(_Newest(schema, time, order, n), changes, "Update", "EventTime")


def newest_rows(spark: SparkSession, checkpoint: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows that the query with this checkpoint holds, as of its last finished batch; with the stream's schema its nested
    columns too are as they were."""
    with list_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
        rows = state.select(*[F.col(f"list_element.`{f}`") for f in state.schema["list_element"].dataType.fieldNames()])
    for field in schema.fields if schema else []:
        if _nested(field):
            rows = rows.withColumn(field.name, F.from_json(f"`{field.name}`", field.dataType, _JSON))
    return rows
