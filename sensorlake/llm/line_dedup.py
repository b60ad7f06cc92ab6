"""Line dedup with two Bloom filters.

One filter holds the keys seen once, the other those seen again. Tasks fill a pair each; the pairs are merged piece by
piece on the executors (seen again: in a task's second filter, or in the first filters of two tasks). Only lines whose
key may have been seen again are shuffled; counting them by their 128-bit hash confirms exactly which keys are in
enough documents, and which document keeps its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import id_key, unused

#: bits of a filter; more keys than this make more lines suspects, never a wrong result
FILTER_BITS = 1 << 24
_PIECE_BITS = 1 << 16
_BLANK = b" \t\n\x0b\x0c\r"
_BLANK_TEXT = _BLANK.decode()


def _keys(text: str | None, least: int) -> Iterator[bytes | None]:
    """The key of each line, None for lines too short to count."""
    for line in (text or "").split("\n"):
        line = line.strip(_BLANK_TEXT)
        yield line.encode().lower() if len(line) >= least else None


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places per hash."""
    mask = np.uint64(bits - 1)
    return np.stack([(hashes & mask), (hashes >> np.uint64(32)) & mask]).astype(np.int64)


def _distinct_hashes(text: str | None, least: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(k) for k in {k for k in _keys(text, least) if k is not None}]


def _task_filters(least: int, bits: int):
    """Fills the two filters of a task and gives their non-empty pieces."""
    def run(batches):
        once, again = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 512):
                hashes = [h for t in texts.slice(at, 512).to_pylist() for h in _distinct_hashes(t, least)]
                values, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
                places = _places(values, bits)
                repeated = (counts > 1) | once[places].all(axis=0)
                again[places[:, repeated].ravel()] = True
                once[places.ravel()] = True
        packed_once, packed_again = (np.packbits(f).reshape(-1, _PIECE_BITS // 8) for f in (once, again))
        full = np.flatnonzero(packed_once.any(axis=1))
        for at in range(0, len(full), 64):
            pieces = full[at:at + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pieces.astype(np.int32)), pa.array([packed_once[p].tobytes() for p in pieces], pa.binary()),
                 pa.array([packed_again[p].tobytes() for p in pieces], pa.binary())], ["piece", "once", "again"])
    return run


def _merge(batches):
    """Merges rows of a piece, which follow each other, in constant memory; gives (piece, seen again)."""
    piece, once, again = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([again.tobytes()], pa.binary())],
                                          ["piece", "again"])
    for batch in batches:
        for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if p != piece:
                if piece is not None:
                    yield done()
                piece, once, again = p, a.copy(), b.copy()
            else:
                again |= b | (once & a)
                once |= a
    if piece is not None:
        yield done()


def seen_again(docs: DataFrame, least: int, bits: int = FILTER_BITS) -> np.ndarray:
    """The packed filter of keys seen in two or more texts; bits / 8 bytes on the driver."""
    pieces = (docs.select("text").mapInArrow(_task_filters(least, bits), "piece int, once binary, again binary")
              .repartition("piece").sortWithinPartitions("piece").mapInArrow(_merge, "piece int, again binary"))
    filled = np.zeros((bits // _PIECE_BITS, _PIECE_BITS // 8), np.uint8)
    for row in pieces.toArrow().to_pylist():
        filled[row["piece"]] = np.frombuffer(row["again"], np.uint8)
    return filled.ravel()


def repeated_lines(docs: DataFrame, least: int, in_documents: int, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_key, drops array<binary>): hashes of the line keys that a document loses."""
    known = docs.sparkSession.sparkContext.broadcast(seen_again(docs, least, bits))

    @F.arrow_udf("array<binary>")
    def suspects(texts: pa.Array) -> pa.Array:
        again = np.unpackbits(known.value).view(bool)
        made = []
        for at in range(0, len(texts), 512):
            for text in texts.slice(at, 512).to_pylist():
                keys = list({k for k in _keys(text, least) if k is not None})
                places = _places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), bits)
                hit = again[places].all(axis=0) if keys else ()
                made.append([xxhash.xxh3_128_digest(k) for k, h in zip(keys, hit, strict=True) if h])
        return pa.array(made, pa.list_(pa.binary()))

    # called nondeterministic, so that the filter below does not have it called a second time, by workers of its own
    suspects = suspects.asNondeterministic()
    lines = (docs.select(id_key().alias("doc_key"), suspects("text").alias("keys"))
             .where(F.size("keys") > 0).select("doc_key", F.explode("keys").alias("key")).distinct())
    lines = materialize(lines, "suspect-lines")
    confirmed = (lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_key").alias("keeper"))
                 .where(F.col("n") >= in_documents).select("key", "keeper"))
    confirmed = materialize(confirmed, "repeated-lines")  # so that the join below may split a frequent key
    return (lines.join(confirmed, "key").where(F.col("doc_key") != F.col("keeper"))
            .groupBy("doc_key").agg(F.collect_list("key").alias("drops")))


def drop_repeated_lines(docs: DataFrame, least: int = 20, in_documents: int = 3, bits: int = FILTER_BITS,
                        into: str = "lines") -> DataFrame:
    """The documents with one more column, struct(kept string, n_lines long, n_dropped long).

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least `least` code points
    that is in at least `in_documents` documents stays only in the largest doc_id that holds it, there with all its
    lines. A null or empty text is one empty line and is kept as the empty text. Rows with the same doc_id count as one document
    and are treated alike; a null doc_id is one document, smaller than all others. Texts of any length are read
    whole. Other columns stay (one named as `into` is replaced); an empty table gives an empty table.
    """
    own = [c for c in docs.columns if c.lower() != into.lower()]
    key, lost = unused(docs, "_key", into), unused(docs, "_drops", into)

    @F.arrow_udf("struct<kept:string,n_lines:long,n_dropped:long>")
    def apply(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for at in range(0, len(texts), 512):
            for text, gone in zip(texts.slice(at, 512).to_pylist(), drops.slice(at, 512).to_pylist(), strict=True):
                text = text or ""
                n_lines.append(text.count("\n") + 1)
                if gone:
                    gone, lines = set(gone), text.split("\n")
                    left = [x for x, k in zip(lines, _keys(text, least), strict=True)
                            if k is None or xxhash.xxh3_128_digest(k) not in gone]
                    kept.append("\n".join(left))
                    n_dropped.append(len(lines) - len(left))
                else:
                    kept.append(text)
                    n_dropped.append(0)
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()),
                                           pa.array(n_dropped, pa.int64())], ["kept", "n_lines", "n_dropped"])

    drops = repeated_lines(docs, least, in_documents, bits).toDF(key, lost)
    joined = docs.select(*own, id_key().alias(key)).join(drops, key, "left")
    return joined.select(*own, apply(F.col("text"), F.col(lost)).alias(into))
