"""Benchmark decontamination by winnowing.

From each window of W consecutive K-word grams the smallest hash is kept as a fingerprint, so two texts that share
K + W - 1 words share a fingerprint. With K = 5 and W = 9 that is the contract's 13 words: no shared window is missed.
Fingerprints of the documents that may occur in the benchmark (a bitmap of fixed size says which) join those of the
benchmark; each hit is then extended word by word in the text itself, which decides.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import NOT_ALNUM, Words, byte_codes, chunks, flat, id_key, mix, unused

WINDOW = 13
GRAM = 5
#: the bitmap of benchmark fingerprints has 2 ** FILTER_BITS bits, whatever the benchmark's size
FILTER_BITS = 22

_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").encode().lower().decode())


def _per_text(values: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(values whose `span` words lie in one text, that text's number); values[i] covers words i .. i + span - 1."""
    counts = np.maximum(np.diff(first) - span + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return values[index], text


def _winnowed(words: Words, window: int, gram: int) -> np.ndarray:
    """Smallest gram hash of each run of `window` words."""
    least, width, have = words.grams(gram), window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        if len(least) <= step:
            return np.zeros(0, np.uint64)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least


def _short(words: Words, n: int) -> np.ndarray:
    """Fingerprints of whole items of n words, apart from those of longer ones."""
    return mix(words.grams(n) ^ np.uint64(0x5851F42D4C957F2D + n))


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> pa.ListArray:
    """Distinct values of each of n texts, as signed longs."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def benchmark_fingerprints(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(text, n_words, prints array<long>) of the distinct texts."""
    codes = byte_codes()

    @F.arrow_udf("struct<n_words:int,prints:array<long>>")
    def prints(texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        words = Words(data, offsets, NOT_ALNUM, codes)
        n = np.diff(words.first)
        found = [_per_text(_winnowed(words, window, gram), words.first, window)]
        for length in np.unique(n[(n > 0) & (n < window)]):
            values, text = _per_text(_short(words, int(length)), words.first, int(length))
            mine = n[text] == length
            found.append((values[mine], text[mine]))
        values, text = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), _distinct(values, text, len(n))],
                                          ["n_words", "prints"])

    texts = benchmark.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    return texts.withColumn("p", prints("text")).select("text", "p.n_words", "p.prints")


def candidate_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_key, item_text): documents and benchmark texts with a common fingerprint."""
    items = materialize(benchmark_fingerprints(items, window, gram), "benchmark-prints")
    mask = (1 << FILTER_BITS) - 1
    exploded = items.select("text", F.explode("prints").alias("print"))
    # at most 2 ** FILTER_BITS places and window - 1 lengths reach the driver
    places = exploded.select(F.col("print").bitwiseAND(mask).cast("int").alias("place")).distinct().toArrow()
    lengths = [r.n_words for r in items.where(F.col("n_words").between(1, window - 1)).select("n_words").distinct().collect()]
    bits = np.zeros(mask + 1, bool)
    bits[places["place"].to_numpy()] = True
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    codes = byte_codes()

    @F.arrow_udf("array<long>")
    def prints(texts: pa.Array) -> pa.Array:
        bits = np.unpackbits(known.value).view(bool)
        data, offsets = flat(texts)
        found = []
        for start, end in chunks(offsets):
            part = offsets[start:end + 1]
            words = Words(data[part[0]:part[-1]], part - part[0], NOT_ALNUM, codes)
            tries = [(_winnowed(words, window, gram), window)] + [(_short(words, n), n) for n in lengths]
            for values, span in tries:
                hit = bits[(values & np.uint64(mask)).astype(np.int64)]
                at = np.flatnonzero(hit)
                text = words.text_of[at]
                inside = at + span <= words.first[text + 1]
                found.append((values[at[inside]], text[inside] + start))
        values, text = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        return _distinct(values.astype(np.uint64), text, len(texts))

    # called nondeterministic, so that the filter below does not have it called a second time, by workers of its own
    prints = prints.asNondeterministic()
    hits = (docs.select(id_key().alias("doc_key"), prints("text").alias("prints"))
            .where(F.size("prints") > 0).select("doc_key", F.explode("prints").alias("print")))
    return hits.join(exploded, "print").select("doc_key", F.col("text").alias("item_text")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  into: str = "found") -> DataFrame:
    """The documents with one more column, struct(n_words, n_hit, n_items, items_sha256, contaminated).

    A window is `window` consecutive words of a benchmark text, or all words of a shorter one. Null and empty texts
    have no words: 0, 0, 0, the digest of the empty string, false. An empty benchmark hits nothing. Rows with the same
    doc_id are judged one by one; a null doc_id is allowed; items with equal texts count each by item_id, a repeated
    item_id once, a null item_id as the text `null`. Texts of any length are read whole. Other columns stay (one
    named as `into` is replaced).
    """
    ids = benchmark.select(F.coalesce("text", F.lit("")).alias("item_text"),
                           F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"))
    pairs = candidate_items(docs, benchmark, window, gram).join(ids, "item_text")
    matches = pairs.groupBy("doc_key").agg(F.collect_set(F.struct("item_text", "item_id")).alias("matches"))
    codes = byte_codes()
    empty = hashlib.sha256(b"").hexdigest()

    @F.arrow_udf("struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean>")
    def judge(texts: pa.Array, matched: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        n_words = np.concatenate([np.diff(Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], NOT_ALNUM,
                                                codes).first) for a, b in chunks(offsets)] or [np.zeros(0, np.int64)])
        n_hit, n_items, digests = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [empty] * len(texts)
        valid = np.flatnonzero(np.asarray(matched.is_valid()))
        for row in valid:
            words = _words(texts[int(row)].as_py())
            hit, items = _extend(words, matched[int(row)].as_py(), window)
            n_hit[row], n_items[row] = hit, len(items)
            digests[row] = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        return pa.StructArray.from_arrays(
            [pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array(n_items), pa.array(digests, pa.string()),
             pa.array((n_hit > 0) & (20 * n_hit >= n_words))],
            ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    own = [c for c in docs.columns if c.lower() != into.lower()]
    key, match = unused(docs, "_key", into), unused(docs, "_matches", into)
    keyed = docs.select(*own, id_key().alias(key))
    joined = keyed.join(matches.toDF(key, match), key, "left")
    return joined.select(*own, judge(F.col("text"), F.col(match)).alias(into))


def _extend(words: list[str], matches: list[dict], window: int) -> tuple[int, set[str]]:
    """(words of the document inside an occurring window, ids of the items with one)."""
    by_text: dict[str, set[str]] = defaultdict(set)
    for m in matches:
        by_text[m["item_text"]].add(m["item_id"])
    windows: dict[int, dict[tuple, set[str]]] = defaultdict(dict)
    for text, ids in by_text.items():
        item = _words(text)
        size = min(window, len(item))
        if size:
            for i in range(len(item) - size + 1):
                windows[size].setdefault(tuple(item[i:i + size]), set()).update(ids)
    covered, found = np.zeros(len(words) + 1, np.int64), set()
    for size, known in windows.items():
        heads = {w[0] for w in known}
        for i in range(len(words) - size + 1):
            if words[i] in heads and (ids := known.get(tuple(words[i:i + size]))):
                covered[i] += 1
                covered[i + size] -= 1
                found |= ids
    return int((np.cumsum(covered)[:-1] > 0).sum()), found
