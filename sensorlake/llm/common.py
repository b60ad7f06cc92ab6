"""Helpers of the operators: flat text buffers, words and hashes as numpy arrays, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: stands for a null id inside joins and orders, below every other id
NULL_ID = -(2 ** 63)
#: bytes of text that one numpy step works on
CHUNK_BYTES = 1 << 20

_POWER_BASE = 0x9E3779B97F4A7C15


def id_key(name: str = "doc_id") -> Column:
    """The id as a never-null long: a null id counts as one more id, smaller than all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def unused(df: DataFrame, name: str, *more: str) -> str:
    """The name, longer if a column of df or one of `more` has it already."""
    taken = {c.lower() for c in [*df.columns, *more]}
    while name.lower() in taken:
        name += "_"
    return name


def hash_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id hashes as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows with whole texts reach Python in small Arrow batches: some MB each, not tens of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a well-known hash, on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_codes(lower: bool = True) -> np.ndarray:
    """A random 64-bit code per byte; A-Z as a-z if wanted."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_POWER_BASE))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """base ** i for i < n, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _POWER_BASE | 1, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


_inverse_powers = np.ones(1, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """base ** -i for i < n, modulo 2**64: takes a run of a sum over powers(n) back to the start."""
    global _inverse_powers
    if len(_inverse_powers) < n:
        steps = np.full(max(n, 2 * len(_inverse_powers)), pow(_POWER_BASE | 1, -1, 1 << 64), dtype=np.uint64)
        steps[0] = 1
        _inverse_powers = np.multiply.accumulate(steps)
    return _inverse_powers[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying text; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def slices(offsets: np.ndarray, overlap: int, limit: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first row, end row, first byte, end byte, place of the first byte in its row): ranges of rows as in chunks, but a
    row above `limit` comes in slices of that many bytes, each with the next `overlap` bytes."""
    for a, b in chunks(offsets, limit):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= limit or b - a > 1:
            yield a, b, low, high, 0
        else:
            for at in range(low, high - overlap, limit):
                yield a, b, at, min(high, at + limit + overlap), at - low


class Words:
    """Words of a range of texts: `start` and `end` in bytes, `hash`, and `first` word of each text (with the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, codes: np.ndarray):
        inside = ~separators[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[starts] = inside[starts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        lasts = starts[starts > 0] - 1
        ends[lasts] = inside[lasts]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if len(self.start):
            number = np.cumsum(begins, dtype=np.int32) - 1
            place = np.arange(len(data), dtype=np.int32) - self.start.astype(np.int32)[np.maximum(number, 0)]
            place[~inside] = 0
            longest = int((self.end - self.start).max())
            terms = np.where(separators, np.uint64(0), codes)[data] * powers(longest + 1)[place]
            self.hash = mix(np.add.reduceat(terms, self.start) + np.uint64(0x632BE59BD9B4E019))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, across texts too; len(words) - k + 1 values."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * np.uint64(_POWER_BASE) + self.hash[i:i + n]
        return mix(total + np.uint64(k))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: separators of words of the shingle operators: \x20 and \x09-\x0D
BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: bytes outside the words of decontamination: \x00-\x2F, \x3A-\x60 (A-Z count as a-z) and \x7B-\x7F
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()
