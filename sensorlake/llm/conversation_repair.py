"""Cheapest edits that give every conversation the shape of an optional system turn and user-assistant pairs.

The rows of a conversation are kept, given another role, deleted, or preceded by inserted rows with an empty text. The
role initials that are left must match (s?(ua)+)?, which four states decide. Dynamic programming with square-root
checkpoints finds the edits: rows are sorted once and cut into blocks that grow by one row each, so the n rows that a
conversation has in one sorted partition make about sqrt(2n) blocks of at most that many rows. A block's cost from each state to each other is a 4 x 4 min-plus matrix.
Walking a conversation's matrices backwards leaves the state-cost vector at each block's end, the checkpoint; nothing
else of the backward pass is stored. Each block then recomputes its own vectors from its checkpoint and walks forward,
from every state it may be entered in, always taking the ASCII-least letter that stays on a cheapest path. A pass
over these walks picks the one that is entered. Sorting, matrices and walks are spread over tasks by block, whatever
conversation they belong to; only the two passes over sqrt(2n) blocks follow a conversation through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .common import NULL_ID, id_key, partitions_of

#: rows of the first block of a conversation; each further block has one more
FIRST_BLOCK = 64
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60
#: states: nothing yet, after the system turn, after a user, after an assistant
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER_INITIAL = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: the state after the only row that may be made in a state, by insertion or by a new role
_AFTER_MADE = [USER, USER, ASSISTANT, USER]
#: initials of rows in order, of truncated rows, of rows that must go
_SYMBOLS = {c: (i, t, g) for i, row in zip("suax", zip("suax", "SUAX", "0123"), strict=True)
            for c, t, g in zip(row, (0, TRUNCATED, 0), (False, False, True), strict=True)}
_END = (0, 2 * INSERT, INSERT, 0)


def _close(b: list[int]) -> tuple[int, int, int, int]:
    """Costs to the end, with insertions before the next row."""
    user = min(b[USER], INSERT + b[ASSISTANT])
    return (min(b[START], INSERT + user), min(b[SYSTEM], INSERT + user), user, min(b[ASSISTANT], INSERT + user))


def _before(symbol: str, after: tuple) -> tuple[int, int, int, int]:
    """Costs to the end before a row, from those after it."""
    initial, truncated, gone = _SYMBOLS[symbol]
    b = [DELETE + after[q] for q in range(4)]
    if not gone:
        for q in range(4):
            b[q] = min(b[q], REROLE + truncated + after[_AFTER_MADE[q]])
            if initial in _AFTER_INITIAL[q]:
                b[q] = min(b[q], truncated + after[_AFTER_INITIAL[q][initial]])
    return _close([min(x, NEVER) for x in b])


def _matrix(symbols: str) -> list[int]:
    """matrix[4 * q + r]: least cost through the rows from state q to state r."""
    columns = []
    for r in range(4):
        b = tuple(0 if q == r else NEVER for q in range(4))
        for symbol in reversed(symbols):
            b = _before(symbol, b)
        columns.append(b)
    return [columns[r][q] for q in range(4) for r in range(4)]


_short_matrix = lru_cache(1 << 14)(_matrix)


def matrix(symbols: str) -> list[int]:
    return _short_matrix(symbols) if len(symbols) <= FIRST_BLOCK else _matrix(symbols)


def _walks(symbols: str, end: tuple, last: bool) -> tuple[tuple[int, str], ...]:
    """For each state of entry: the state at the end (-1: never entered) and the letters; all vectors come from `end`.

    Letters in lower case make an assistant, others that make a role a user.
    """
    vectors = [end]
    for symbol in reversed(symbols):
        vectors.append(_before(symbol, vectors[-1]))
    vectors.reverse()
    found = []
    for q in range(4):
        if vectors[0][q] >= NEVER:
            found.append((-1, ""))
            continue
        letters, i = [], 0
        while i < len(symbols):
            initial, truncated, gone = _SYMBOLS[symbols[i]]
            now, after = vectors[i][q], vectors[i + 1]
            if now == DELETE + after[q]:
                letters.append("D")
                i += 1
            elif now == INSERT + vectors[i][_AFTER_MADE[q]]:
                q = _AFTER_MADE[q]
                letters.append("i" if q == ASSISTANT else "I")
            else:
                kept = _AFTER_INITIAL[q].get(initial)
                keep = kept is not None and now == truncated + after[kept]
                q = kept if keep else _AFTER_MADE[q]
                letters.append("K" if keep else "r" if q == ASSISTANT else "R")
                i += 1
        if last:
            while q in (SYSTEM, USER):
                q = _AFTER_MADE[q]
                letters.append("i" if q == ASSISTANT else "I")
        found.append((q, "".join(letters)))
    return tuple(found)


_short_walks = lru_cache(1 << 14)(_walks)


def walks(symbols: str, end: tuple, last: bool) -> tuple[tuple[int, str], ...]:
    return _short_walks(symbols, end, last) if len(symbols) <= FIRST_BLOCK else _walks(symbols, end, last)


def illegal_pairs(symbols: str) -> int:
    initials = [_SYMBOLS[c][0] for c in symbols]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _first_of(k: np.ndarray) -> np.ndarray:
    """Rows of a conversation before its block k."""
    return FIRST_BLOCK * k + k * (k - 1) // 2


def _number(batches):
    """Adds to sorted rows: block (place of its first row among all rows) and index within the block."""
    place, before, seen = TaskContext.get().partitionId() << 33, None, 0
    for batch in batches:
        key = batch.column(0).to_numpy()
        n = len(key)
        if not n:
            continue
        starts = np.flatnonzero(np.concatenate(([key[0] != before], key[1:] != key[:-1])))
        of = np.cumsum(np.bincount(starts, minlength=n)[:n])
        at = np.arange(n, dtype=np.int64)
        row = np.where(of > 0, at - (starts[np.maximum(of - 1, 0)] if len(starts) else 0), at + seen)
        k = ((np.sqrt((2.0 * FIRST_BLOCK - 1) ** 2 + 8.0 * row) - (2 * FIRST_BLOCK - 1)) / 2).astype(np.int64)
        k -= _first_of(k) > row
        k += _first_of(k + 1) <= row
        index = row - _first_of(k)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place + at - index), pa.array(index.astype(np.int32))],
                                         [*batch.schema.names, "block", "index"])
        place, before, seen = place + n, key[-1], int(row[-1]) + 1


def in_blocks(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text, block, index): the rows sorted by conversation, turn (null first), role and text, written once.

    Copies of a row are told apart by a number in the order, so a conversation or a row of any share is split over tasks.
    """
    rows = conversations.select(id_key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.withColumn("_copy", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(partitions_of(rows), *order, "_copy").sortWithinPartitions(*order).drop("_copy")
    return materialize(rows.mapInArrow(_number, "key long, turn long, role string, text string, block long, index int"),
                       "conversation-blocks")


_BLANK = r"\x20\x09-\x0D"


def marked(blocks: DataFrame) -> DataFrame:
    """(key, block, index, turn, initial, fault): fault is the row's first of blank, duplicate, truncated, or null."""
    said = F.sha2(F.col("text").cast("binary"), 256)
    place = F.col("block") + F.col("index")
    first = (blocks.select("key", "role", said.alias("said"), place.alias("place")).groupBy("key", "role", "said")
             .agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first")))
    initial = F.substring("role", 1, 1)
    rows = blocks.select(
        "key", "block", "index", "turn", place.alias("place"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (~F.col("text").rlike(f"[^{_BLANK}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{_BLANK}]*\z")).alias("truncated"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return rows.join(first, "place", "left").select("key", "block", "index", "turn", "initial", fault.alias("fault"))


@F.arrow_udf(T.StructType([T.StructField("matrix", T.ArrayType(T.LongType())), T.StructField("illegal", T.LongType())]))
def _of_symbols(symbols: pa.Array) -> pa.Array:
    texts = symbols.to_pylist()
    return pa.StructArray.from_arrays([pa.array([matrix(s) for s in texts], pa.list_(pa.int64())),
                                       pa.array([illegal_pairs(s) for s in texts], pa.int64())], ["matrix", "illegal"])


def _checkpoints(batches):
    """Blocks of a conversation from its last to its first: the vector at each end, the cost from each beginning."""
    before, vector, first = None, _END, ""
    for batch in batches:
        key, block, symbols, made = (batch.column(i).to_pylist() for i in range(4))
        ends, last, cost, illegal = [], [], [], []
        for k, s, m in zip(key, symbols, made, strict=True):
            if k != before:
                before, vector, first = k, _END, ""
            ends.append(vector)
            last.append(not first)
            illegal.append(m["illegal"] + (illegal_pairs(s[-1] + first) if first else 0))
            m = m["matrix"]
            vector = tuple(min(min(m[4 * q + r] + vector[r] for r in range(4)), NEVER) for q in range(4))
            first = s[0]
            cost.append(vector[START])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(ends, pa.list_(pa.int64())),
             pa.array(last, pa.bool_()), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64())],
            ["key", "block", "symbols", "end", "last", "cost", "illegal"])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("leaves", T.IntegerType()), T.StructField("letters", T.StringType())])))
def _walks_of(symbols: pa.Array, end: pa.Array, last: pa.Array) -> pa.Array:
    rows = zip(symbols.to_pylist(), end.to_pylist(), last.to_pylist(), strict=True)
    return pa.array([[{"leaves": q, "letters": w} for q, w in walks(s, tuple(e), x)] for s, e, x in rows],
                    pa.list_(pa.struct([("leaves", pa.int32()), ("letters", pa.string())])))


def _entered(batches):
    """Blocks of a conversation in order: the letters of the walk from the state in which each is entered."""
    before, q = None, START
    for batch in batches:
        key, found = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        letters = []
        for k, ways in zip(key, found, strict=True):
            way = ways[START if k != before else q]
            before, q = k, way["leaves"]
            letters.append(way["letters"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(letters, pa.string())],
                                         ["key", "block", "letters"])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _rows_of(letters: pa.Array) -> pa.Array:
    """For each letter the index of its row in the block, -1 for an insertion."""
    made = []
    for text in letters.to_pylist():
        uses = np.frombuffer(text.upper().encode(), np.uint8) != ord("I")
        made.append(np.where(uses, np.cumsum(uses) - 1, -1).astype(np.int32))
    return pa.array(made, pa.list_(pa.int32()))


def _table_of(rows: DataFrame) -> DataFrame:
    """(key, block, symbols, matrix, illegal): a block's rows as one letter each."""
    number = F.translate("initial", "suax", "0123")
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), number)
              .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
    grouped = rows.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("index", symbol.alias("c")))).alias("rows"))
    symbols = grouped.select("key", "block", F.array_join(F.transform("rows", lambda r: r["c"]), "").alias("symbols"))
    return symbols.withColumn("made", _of_symbols("symbols"))


class Repair:
    """The repair of a table of conversations; `rows`, `edits` and `report` are frames over tables written once.

    Takes (conv_id, turn, role, text); other columns are not read. A null role or text counts as empty, a null turn comes
    first, a null conv_id is one more conversation. Equal turns are ordered by role and text, so repeated rows follow each
    other and all but the first are duplicates. Texts of any length are read whole. Rows that are blank or say what an
    earlier row of the conversation says in the same role must go; keeping a row whose last character is no full stop,
    exclamation or question mark costs TRUNCATED. An empty table gives empty frames.
    """

    def __init__(self, conversations: DataFrame):
        n = partitions_of(conversations)
        self._blocks = in_blocks(conversations)
        self._rows = materialize(marked(self._blocks), "conversation-rows")
        scanned = (_table_of(self._rows).repartition(n, "key").sortWithinPartitions("key", F.col("block").desc())
                   .mapInArrow(_checkpoints, "key long, block long, symbols string, end array<long>, last boolean, "
                                             "cost long, illegal long"))
        self._checkpoints = materialize(scanned, "conversation-checkpoints")
        walked = self._checkpoints.repartition(n, "block").select("key", "block", _walks_of("symbols", "end", "last").alias("walks"))
        self._letters = materialize(walked.repartition(n, "key").sortWithinPartitions("key", "block").mapInArrow(
            _entered, "key long, block long, letters string"), "conversation-edits")

    @staticmethod
    def _id() -> Column:
        return F.when(F.col("key") != NULL_ID, F.col("key")).alias("conv_id")

    def _keyed(self) -> DataFrame:
        ops = self._letters.select("key", "block", "letters", _rows_of("letters").alias("rows"))
        ops = ops.select("key", "block", F.posexplode(F.arrays_zip(F.split("letters", "").alias("letter"), "rows")))
        ops = ops.select("key", "block", F.col("pos").alias("place"), F.col("col.letter").alias("letter"), F.col("col.rows").alias("index"))
        said = self._blocks.select("block", "index", F.col("role").alias("_role"), "text")
        op, made = F.upper("letter"), F.when(F.col("letter").isin("i", "r"), "assistant").otherwise("user")
        return ops.join(said, ["block", "index"], "left").select(
            "key", "block", "place", op.alias("op"),
            F.when(op.isin("I", "R"), made).when(op == "K", F.col("_role")).alias("role"),
            F.when(op == "I", "").when(op != "D", F.col("text")).alias("text"))

    def edits(self) -> DataFrame:
        """(conv_id, block, place, op, role, text) of every edit, ordered by block and place; K, R and I leave a row, D does not."""
        return self._keyed().select(self._id(), "block", "place", "op", "role", "text")

    def digests(self) -> DataFrame:
        """(conv_id, audit, repaired_sha256): the letters in order, and a digest of what is left, streamed through a task."""
        ordered = self._keyed().repartition(partitions_of(self._letters), "key").sortWithinPartitions("key", "block", "place")
        made = ordered.select("key", "op", "role", "text").mapInArrow(_digest, "key long, audit string, repaired_sha256 string")
        return made.select(self._id(), "audit", "repaired_sha256")

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost): turns missing between the least and the largest,
        rows by first fault, neighbouring initials other than su, ua and au, and the least cost."""
        count = {name: F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")}
        turns = (self._rows.groupBy("key", "turn").agg(*count.values()).groupBy("key")
                 .agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("turns"),
                      *[F.sum(name).alias(name) for name in count]))
        costs = self._checkpoints.groupBy("key").agg(F.min_by("cost", "block").alias("cost"), F.sum("illegal").alias("illegal"))
        span = F.col("most").cast("decimal(20,0)") - F.col("least") + 1 - F.col("turns")
        return turns.join(costs, "key").select(self._id(), F.coalesce(span.try_cast("long"), F.lit(0)).cast("long").alias("gaps"),
                                               *count, "illegal", "cost")


def _digest(batches) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys: the letters, and the digest of the rows that are left."""
    def done():
        return pa.RecordBatch.from_arrays([pa.array([before], pa.int64()), pa.array(["".join(audit)]),
                                           pa.array([digest.hexdigest()])], ["key", "audit", "repaired_sha256"])

    before, audit, digest, empty = None, [], hashlib.sha256(), True
    for batch in batches:
        for key, op, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != before:
                if before is not None:
                    yield done()
                before, audit, digest, empty = key, [], hashlib.sha256(), True
            audit.append(op)
            if op != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
    if before is not None:
        yield done()


def repair(conversations: DataFrame) -> Repair:
    return Repair(conversations)
