"""Hard negatives by Hilbert-ordered blocks of candidates with zone maps.

Rows are sorted along a Hilbert curve through the leading directions of their vectors and stored as Parquet rows of one block
of vectors each, together with the least and largest value of every dimension and the labels that occur: the zone map.
Anchors lie on the same curve and are taken in packs of neighbours. For a pack, interval arithmetic over the zone maps gives
the least and largest inner product that a block can have with each anchor. A block is needed for an anchor's positives if
it holds the anchor's label and its largest product reaches the anchor's k-th best known score, and for its negatives if it holds
another label and its interval meets a window that still lacks better rows. Only row groups with needed blocks are read, and
in them only needed blocks are multiplied with the anchors that need them. Scores are exact integers; the bounds carry a
margin for rounding, so nothing is lost.

Work is packs times zone maps, plus what the bounds leave: a stated set of anchors against all rows, in blocks. The driver holds
one pack with its positives, a bounded sample and at most INTERVALS ranges of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh_path, materialize
from .common import NULL_ID, id_key, partitions_of

#: anchors of a pack, rows of a block, rows of the sample that gives directions and first bounds
PACK, BLOCK_ROWS, SAMPLE = 2048, 256, 4096
#: dimensions and bits of each on the curve
CURVE_DIMS, CURVE_BITS = 8, 5
#: ranges of blocks that a task reports and that one read asks for
TASK_INTERVALS, INTERVALS = 16, 64
#: bytes of a row group, the least that a read can pass over
ROW_GROUP = 8 << 20
#: squared lengths from which scores would no longer be exact
TOO_LONG = 2.0 ** 60


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cells, each 0 to 2 ** bits - 1; bits times dimensions is at most 63."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:  # undo the turns and mirrors of the sub-cubes, from the largest on
        low = bit - 1
        for i in range(len(x)):
            mirror = (x[i] & bit) != 0
            swap = np.where(mirror, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(mirror, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        turn = np.where(x[-1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | (((axis ^ turn) >> b) & 1)
    return place


class Curve:
    """Places of vectors: projected on leading directions of a sample, in equal cells between its extremes."""

    def __init__(self, sample: np.ndarray):
        width = sample.shape[1]
        dims = min(CURVE_DIMS, width)
        self.middle = sample.mean(axis=0) if len(sample) else np.zeros(width)
        moved = sample - self.middle
        self.directions = np.linalg.eigh(moved.T @ moved)[1][:, ::-1][:, :dims] if width else np.zeros((0, 0))
        seen = moved @ self.directions
        self.least = seen.min(axis=0) if len(seen) else np.zeros(dims)
        self.step = np.maximum(((seen.max(axis=0) if len(seen) else np.ones(dims)) - self.least) / (1 << CURVE_BITS), 1e-9)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        if not self.directions.shape[1]:
            return np.zeros(len(vectors), np.int64)
        cells = np.floor(((vectors - self.middle) @ self.directions - self.least) / self.step)
        return hilbert(np.clip(cells, 0, (1 << CURVE_BITS) - 1).astype(np.int64), CURVE_BITS)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of longs, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    made = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    made[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return made


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _read(data: bytes, width: int, n: int) -> np.ndarray:
    """What `_narrow` made, n rows of it."""
    size = len(data) // max(1, n * width)
    return np.frombuffer(data, {2: np.int16, 4: np.int32}.get(size, np.int64)).reshape(n, width)


_BLOCKS = "block long, n int, labels array<int>, low binary, high binary, ids binary, each_label binary, vectors binary"


def _pack_blocks(width: int):
    """Sorted rows (id, label, vector) to blocks; a block's number grows along the curve."""
    def made(number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
        return {"block": (TaskContext.get().partitionId() << 33) + number, "n": len(ids), "labels": np.unique(labels).tolist(),
                "low": _narrow(vectors.min(axis=0)).tobytes(), "high": _narrow(vectors.max(axis=0)).tobytes(),
                "ids": ids.tobytes(), "each_label": labels.tobytes(), "vectors": _narrow(vectors).tobytes()}

    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("labels", pa.list_(pa.int32())), ("low", pa.binary()),
                        ("high", pa.binary()), ("ids", pa.binary()), ("each_label", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        ids, labels, vectors = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, width), np.int64)
        number = 0
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            labels = np.concatenate([labels, batch.column(1).to_numpy()])
            vectors = np.concatenate([vectors, _matrix(batch.column(2), width)])
            full = len(ids) - len(ids) % BLOCK_ROWS
            rows = []
            for at in range(0, full, BLOCK_ROWS):
                cut = slice(at, at + BLOCK_ROWS)
                rows.append(made(number, ids[cut], labels[cut], vectors[cut]))
                number += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
            ids, labels, vectors = ids[full:], labels[full:], vectors[full:]
        if len(ids):
            yield pa.RecordBatch.from_pylist([made(number, ids, labels, vectors)], schema)
    return run


class _Best:
    """The k best (score, then smaller id) of each of n searches, and the score that the next must reach."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.n, self.k, self.least = n, k, least.astype(np.int64).copy()
        self.q, self.ids, self.score = (np.zeros(0, np.int64),) * 3

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = np.maximum(self.least[full], score[first[full] + self.k - 1])
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.ids, self.score = q[keep], ids[keep], score[keep]


class _Pack:
    """Anchors with the scores that rows must reach: one search for positives, or one for each window of negatives.

    least and most are the inclusive bounds of each search, one row per anchor; `same` tells which rows may answer.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int, same: bool,
                 least: np.ndarray, most: np.ndarray):
        self.ids, self.labels, self.vectors, self.k, self.same, self.least, self.most = ids, labels, vectors, k, same, least, most
        self.width = vectors.shape[1]

    def start(self, longest: float) -> None:
        """What each task makes of it once."""
        floats = self.vectors.astype(np.float64)
        self.floats, self.up, self.down = floats, np.maximum(floats, 0), np.minimum(floats, 0)
        norms = np.sqrt((floats ** 2).sum(axis=1))
        self.slack = 1e-9 * (norms * longest * math.sqrt(max(1, self.width)) + 1)
        self.exact = longest * longest < 2.0 ** 52
        self.best = _Best(self.least.size, self.k, self.least.ravel())

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner products of each anchor (rows) with each block."""
        low, high = low.astype(np.float64).T, high.astype(np.float64).T
        return (self.up @ low + self.down @ high - self.slack[:, None], self.up @ high + self.down @ low + self.slack[:, None])

    def needs(self, low: np.ndarray, high: np.ndarray, labels: list[list[int]]) -> np.ndarray:
        """Which anchors (rows) need which blocks, by what is known so far."""
        lower, upper = self.bounds(low, high)
        need = np.zeros(lower.shape, bool)
        least = self.best.least.reshape(self.least.shape)
        for j in range(least.shape[1]):
            need |= (upper >= least[:, j, None]) & (lower <= self.most[:, j, None])
        for b, held in enumerate(labels):
            if self.same:
                need[:, b] &= np.isin(self.labels, held)
            elif len(held) == 1:
                need[:, b] &= self.labels != held[0]
        return need

    def search(self, asks: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Scores the rows with the anchors that ask for them."""
        score = ((self.floats[asks] @ vectors.T.astype(np.float64)).astype(np.int64) if self.exact
                 else self.vectors[asks] @ vectors.T.astype(np.int64))
        fits = self.labels[asks][:, None] == labels if self.same else self.labels[asks][:, None] != labels
        if self.same:
            fits &= self.ids[asks][:, None] != ids
        searches = self.least.shape[1]
        for j in range(searches):
            number = asks * searches + j
            q, row = np.nonzero(fits & (score >= self.best.least[number][:, None]) & (score <= self.most[asks, j][:, None]))
            self.best.add(number[q], ids[row], score[q, row])


def _zones(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    low, high = (np.concatenate([_read(x.as_py(), width, 1).astype(np.int64) for x in batch.column(name)])
                 for name in ("low", "high"))
    return low, high, batch.column("labels").to_pylist()


def merged(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """At most so many ranges that hold all of these, joined over the smallest gaps."""
    spans = sorted(spans)
    if len(spans) <= 1:
        return spans
    gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:], strict=False)]
    cut = set(sorted(range(len(gaps)), key=lambda i: -gaps[i])[:most - 1])
    cut = {i for i in cut if gaps[i] > 1}
    made, start = [], spans[0][0]
    for i in range(len(spans)):
        if i == len(spans) - 1 or i in cut:
            made.append((start, spans[i][1]))
            start = spans[i + 1][0] if i + 1 < len(spans) else start
    return made


class Blocks:
    """The candidate table: written once, read through its zone maps."""

    def __init__(self, rows: DataFrame):
        spark = self.spark = rows.sparkSession
        squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
        stats = rows.agg(F.max(F.size("vector")).alias("width"), F.max(squares).alias("square")).first()
        self.width, self.longest = stats.width or 0, math.sqrt(stats.square or 0.0)
        if (stats.square or 0.0) >= TOO_LONG:
            raise ValueError("vectors are too long for exact 64-bit scores")
        sample = rows.orderBy(F.xxhash64("id", "vector", "label")).limit(SAMPLE).select("id", "label", "vector").toArrow()
        self.sample = (sample["id"].to_numpy(), sample["label"].to_numpy(), _matrix(sample["vector"], self.width))
        curve, width = Curve(self.sample[2].astype(np.float64)), self.width

        @F.arrow_udf("long")
        def place(vectors: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(0, np.int64), *[curve.places(_matrix(vectors.slice(at, 4096), width).astype(np.float64))
                                                                     for at in range(0, len(vectors), 4096)]]))

        self.placed = materialize(rows.withColumn("place", place("vector")), "placed-vectors")
        order = ["place", "id", "_copy"]
        dealt = (self.placed.withColumn("_copy", F.monotonically_increasing_id())
                 .repartitionByRange(partitions_of(rows), *order).sortWithinPartitions(*order).select("id", "label", "vector"))
        self.path = fresh_path(spark, "vector-blocks")
        (dealt.mapInArrow(_pack_blocks(self.width), _BLOCKS).write.option("parquet.block.size", ROW_GROUP)
         .parquet(self.path))

    def table(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(self.path)

    def needed(self, pack: _Pack) -> list[tuple[int, int]]:
        """Ranges of blocks that hold all that the pack needs; reads the zone maps only."""
        width, longest = self.width, self.longest
        sent = self.spark.sparkContext.broadcast(pack)

        def run(batches):
            pack = sent.value
            pack.start(longest)
            spans: list[tuple[int, int]] = []
            for batch in batches:
                if batch.num_rows:
                    wanted = pack.needs(*_zones(batch, width)).any(axis=0)
                    spans = merged(spans + [(b, b) for b in batch.column("block").to_numpy()[wanted].tolist()], TASK_INTERVALS)
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1)], ["first", "last"])

        zones = self.table().select("block", "labels", "low", "high")
        return merged([tuple(r) for r in zones.mapInArrow(run, "first long, last long").collect()], INTERVALS)

    def search(self, pack: _Pack) -> DataFrame:
        """(search, id, score): the k best of each search, over the blocks that need be read."""
        width, longest = self.width, self.longest
        sent = self.spark.sparkContext.broadcast(pack)
        spans = self.needed(pack)

        def run(batches):
            pack = sent.value
            pack.start(longest)
            for batch in batches:
                if not batch.num_rows:
                    continue
                low, high, labels = _zones(batch, width)
                _, upper = pack.bounds(low, high)
                for b in np.argsort(-upper.max(axis=0, initial=-np.inf), kind="stable").tolist():  # blocks that raise the bounds first
                    asks = np.flatnonzero(pack.needs(low[b:b + 1], high[b:b + 1], labels[b:b + 1])[:, 0])
                    if len(asks):
                        n = batch.column("n")[b].as_py()
                        pack.search(asks, np.frombuffer(batch.column("ids")[b].as_py(), np.int64),
                                    np.frombuffer(batch.column("each_label")[b].as_py(), np.int32),
                                    _read(batch.column("vectors")[b].as_py(), width, n))
            best = pack.best
            yield pa.RecordBatch.from_arrays([pa.array(best.q), pa.array(best.ids), pa.array(best.score)], ["search", "id", "score"])

        asked = [F.col("block").between(a, b) for a, b in spans] or [F.lit(False)]
        while len(asked) > 1:
            asked = [a if b is None else a | b for a, b in zip(asked[::2], [*asked[1::2], None], strict=False)]
        found = self.table().where(asked[0]).mapInArrow(run, "search long, id long, score long")
        best = Window.partitionBy("search").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= pack.k)


def _numbered(anchors: DataFrame) -> DataFrame:
    """Anchors along the curve with a number from 0 on."""
    def count(batches):
        at = 0
        for batch in batches:
            part = np.full(batch.num_rows, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(np.arange(at, at + batch.num_rows))],
                                             [*batch.schema.names, "part", "at"])
            at += batch.num_rows

    sorted_ = anchors.repartitionByRange(partitions_of(anchors), "place", "id").sortWithinPartitions("place", "id")
    made = materialize(sorted_.select("id", "label", "vector").mapInArrow(
        count, "id long, label int, vector array<long>, part int, at long"), "anchors")
    sizes = {r["part"]: r["count"] for r in made.groupBy("part").count().collect()}
    starts = dict(zip(sorted(sizes), np.cumsum([0, *[sizes[p] for p in sorted(sizes)]]).tolist(), strict=False))
    start = anchors.sparkSession.createDataFrame(list(starts.items()) or [(-1, 0)], "part int, start long")
    return materialize(made.join(start, "part").select("id", "label", "vector", (F.col("start") + F.col("at")).alias("number")),
                       "numbered-anchors")


RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Takes (vec_id, label int, vector array<long>); other columns are not read. An anchor's positives are the `positives`
    best-scoring rows of its label whose vec_id is another, its negatives for a positive the `negatives` best-scoring rows of
    other labels with least_percent * positive_score <= 100 * score <= 100 * positive_score; a score is the inner product with
    the anchor, ties go to the smaller vec_id. Rows with a null label or vector take no part; vectors of unlike widths
    are filled with zeros. Repeated candidates are all ranked; an anchor given twice is answered once. A null vec_id is
    the smallest and no anchor. Fewer rows than asked for give fewer results, empty tables none. Vectors whose squared length
    reaches TOO_LONG raise a ValueError, since their scores would not fit.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vector").isNotNull() & F.col("label").isNotNull()).select(
        id_key("vec_id").alias("id"), F.col("label").cast("int").alias("label"), "vector",
        (F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()).alias("asks"))
    rows = materialize(rows, "vectors")
    blocks = Blocks(rows)
    anchors = _numbered(blocks.placed.where("asks").dropDuplicates(["id", "label", "vector"]))
    out = fresh_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(out)
    n = anchors.count()
    for start in range(0, n, PACK):
        pack = anchors.where(F.col("number").between(start, start + PACK - 1)).orderBy("number").toArrow()
        _mine(blocks, pack, positives, negatives, least_percent).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)


def _first_bounds(blocks: Blocks, pack: _Pack) -> None:
    """Raises what rows must reach by the best rows of the sample, which are rows of the table."""
    pack.start(blocks.longest)
    ids, labels, vectors = blocks.sample
    for at in range(0, len(ids), BLOCK_ROWS):
        cut = slice(at, at + BLOCK_ROWS)
        pack.search(np.arange(len(pack.ids)), ids[cut], labels[cut], vectors[cut])
    pack.least = pack.best.least.reshape(pack.least.shape)
    for name in ("floats", "up", "down", "slack", "exact", "best"):
        delattr(pack, name)


def _mine(blocks: Blocks, anchors: pa.Table, positives: int, negatives: int, least_percent: int) -> DataFrame:
    ids, labels, vectors = anchors["id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["vector"], blocks.width)
    far = np.iinfo(np.int64).max
    pack = _Pack(ids, labels, vectors, positives, True, np.full((len(ids), 1), -far), np.full((len(ids), 1), far))
    _first_bounds(blocks, pack)
    found = blocks.search(pack).toArrow()  # at most `positives` for each anchor of the pack
    anchor, place = found["search"].to_numpy(), found["rank"].to_numpy() - 1
    most, chosen = np.full((len(ids), positives), -far), np.full((len(ids), positives), NULL_ID)
    most[anchor, place], chosen[anchor, place] = found["score"].to_numpy(), found["id"].to_numpy()
    least = np.array([[-(-least_percent * s // 100) if s != -far else far for s in row] for row in most.tolist()],
                     dtype=np.int64).reshape(most.shape)
    windows = _Pack(ids, labels, vectors, negatives, False, least, most)
    _first_bounds(blocks, windows)
    made = blocks.search(windows)
    of = {"anchor_id": np.repeat(ids, positives), "positive_id": chosen.ravel(), "positive_score": most.ravel()}
    names = blocks.spark.createDataFrame(pa.table({"search": np.arange(most.size), **of}))
    known = lambda name: F.when(F.col(name) != NULL_ID, F.col(name))
    return made.join(names, "search").select("anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                             known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
