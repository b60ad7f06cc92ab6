"""Exact top-k inner products over norm-sorted vectors.

Vectors are dealt over tasks in order of length and each task works through its share from the longest on. A query's
k-th best score so far bounds what is still of use: by Cauchy-Schwarz a vector whose length times the query's is
below it is passed over, as are all after it. What remains is tested on the leading coordinates of a rotation (the
right singular vectors of a sample): partial sum plus the product of the residual lengths. Only survivors get the exact
integer product. The bounds carry a margin for rounding, so pruning never loses a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh_path, materialize
from .common import NULL_ID, id_key, partitions_of

#: queries sent to the tasks at a time; more queries make more rounds
QUERY_BLOCK = 1024
#: longest vectors that give the first bounds, and sampled vectors that give the rotation
LONGEST, SAMPLE = 2048, 4096
_BLOCK_ROWS = 2048


def scaled(embedding: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as longs; null where the vector takes no part."""
    x = F.col(embedding)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    made = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    made[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return made


class _Queries:
    """A block of queries with what pruning needs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.floats = vectors.astype(np.float64)
        self.norms = np.sqrt((self.floats ** 2).sum(axis=1))
        self.head = rotation.shape[1]
        self.rotation = rotation
        self.rotated = self.floats @ rotation
        self.rest = np.sqrt(np.maximum(self.norms ** 2 - (self.rotated ** 2).sum(axis=1), 0)) + 1e-9 * self.norms
        self.least = np.full(len(ids), -np.inf)

    def scores(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the pairs that may matter; x sorted by descending length, own its ids."""
        floats = x.astype(np.float64)
        lengths = np.sqrt((floats ** 2).sum(axis=1))
        slack = 1e-9 * (lengths.max(initial=0.0) * self.norms + 1)
        live = np.flatnonzero(lengths.max(initial=0.0) * self.norms + slack >= self.least)
        if not len(live):
            return (np.zeros(0, np.int64),) * 3
        y = floats @ self.rotation
        rest = np.sqrt(np.maximum(lengths ** 2 - (y ** 2).sum(axis=1), 0)) + 1e-9 * lengths
        bound = self.rotated[live] @ y.T + self.rest[live][:, None] * rest + slack[live][:, None]
        q, row = np.nonzero(bound >= self.least[live][:, None])
        q = live[q]
        keep = self.ids[q] != own[row]
        q, row = q[keep], row[keep]
        exact = self.norms.max(initial=0.0) * lengths.max(initial=0.0) < 2.0 ** 52
        if exact and len(q) * 8 > len(live) * len(x):
            table = np.zeros((len(self.ids), len(x)))
            table[live] = self.floats[live] @ floats.T
            score = table[q, row].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("ij,ij->i", self.vectors[q[a:a + 65536]], x[row[a:a + 65536]])
                                    for a in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
        keep = score >= self.least[q]
        return q[keep], row[keep], score[keep]

    def best(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray):
        """The k best of each query, ties to the smaller id; raises the bounds of queries that have k."""
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, np.arange(len(self.ids) + 1))
        rank = np.arange(len(q)) - first[q]
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = np.maximum(self.least[full], score[first[full] + self.k - 1])
        keep = rank < self.k
        return q[keep], ids[keep], score[keep]


def _search(block: _Queries, batches, width: int):
    """The k best in these batches (id, vector) for each query of the block."""
    q, ids, score = (np.zeros(0, np.int64),) * 3
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = _matrix(batch.column(1), width)
        for at in range(0, len(own), _BLOCK_ROWS):
            a, row, s = block.scores(vectors[at:at + _BLOCK_ROWS], own[at:at + _BLOCK_ROWS])
            if len(a):
                q, ids, score = block.best(np.concatenate([q, a]), np.concatenate([ids, own[at:][row]]),
                                           np.concatenate([score, s]))
    return q, ids, score


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, head: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with all other rows.

    Takes (vec_id, vector array<long>); other columns are not read. Rows with a null vector take no part; vectors of
    unlike widths are filled with zeros; an empty vector scores 0. A row is a query's own if it has its vec_id, so
    repeated rows of a query are no candidates of it, and a query that is given twice is answered once. Repeated
    candidates are all ranked. Equal scores go to the smaller vec_id; a null vec_id is the smallest and no query.
    Fewer than k candidates give fewer rows, empty tables none. Sums are 64-bit: components must stay below 2 ** 28.
    """
    spark = vectors.sparkSession
    own = vectors.where(F.col("vector").isNotNull()).select(
        id_key("vec_id").alias("id"), "vector",
        F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)).alias("norm"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    dealt = own.repartitionByRange(partitions_of(own), F.col("norm").desc(), F.col("id"))
    own = materialize(dealt.sortWithinPartitions(F.col("norm").desc(), F.col("id")), "vectors")
    stats = own.agg(F.max(F.size("vector")).alias("width"), F.sum(F.col("asks").cast("long")).alias("asked")).first()
    out = fresh_path(spark, "top-k")
    schema = "block int, number int, query_id long, vec_id long, score long"
    width, asked = stats.width or 0, stats.asked or 0
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation = _rotation(own, width, head)
    longest = own.orderBy(F.col("norm").desc(), "id").limit(LONGEST).select("id", "vector").toArrow().to_batches()
    n_blocks = math.ceil(asked / QUERY_BLOCK)
    queries = own.where("asks").dropDuplicates(["id", "vector"]).select(
        "id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(n_blocks)).alias("block"))
    for number in range(n_blocks):
        rows = queries.where(F.col("block") == number).select("id", "vector").orderBy("id", "vector").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids = rows["id"].to_numpy()
        asked_vectors = _matrix(rows["vector"].combine_chunks() if isinstance(rows["vector"], pa.ChunkedArray)
                                else rows["vector"], width)
        block = _Queries(ids, asked_vectors, rotation, k)
        _search(block, longest, width)  # leaves the first bounds
        sent = spark.sparkContext.broadcast((ids, asked_vectors, rotation, block.least))

        def search(batches, number=number, sent=sent):
            ids, asked_vectors, rotation, least = sent.value
            block = _Queries(ids, asked_vectors, rotation, k)
            block.least = least.copy()
            q, found, score = _search(block, batches, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), number, np.int32)), pa.array(q.astype(np.int32)), pa.array(ids[q]),
                 pa.array(found), pa.array(score)], ["block", "number", "query_id", "vec_id", "score"])

        own.select("id", "vector").mapInArrow(search, schema).write.mode("append").parquet(out)
    best = Window.partitionBy("block", "number").orderBy(F.col("score").desc(), "vec_id")
    ranked = spark.read.schema(schema).parquet(out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"),
                         F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score")


def _rotation(own: DataFrame, width: int, head: int) -> np.ndarray:
    """Leading right singular vectors of a sample of at most SAMPLE rows; it only sharpens the pruning."""
    rows = own.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    sample = _matrix(rows, width).astype(np.float64)
    _, directions = np.linalg.eigh(sample.T @ sample / max(1.0, np.abs(sample).max(initial=0.0) ** 2)) if width else (None, np.zeros((0, 0)))
    return np.ascontiguousarray(directions[:, ::-1][:, :head])
