"""Language identification by a string kernel.

Two texts are as alike as the byte n-grams of lengths 1 to 3 that both contain, over the root of the product of their
numbers (the blended-spectrum presence kernel, n-grams hashed into DIMENSION bins). Kernel values against LANDMARKS
sampled texts, whitened by their own kernel matrix (Nyström), are the features of a one-versus-rest kernel ridge
regression. Training takes a bounded sample; scoring is one matrix product per batch of whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES

DIMENSION = 1 << 13
LANDMARKS = 192
#: labelled texts that training sees, over all languages
SAMPLE = 3000
RIDGE = 1e-3
UNKNOWN = "und"
_EDGE = b"\x00\x00\x00"


def has_letter(name: str = "text") -> Column:
    """Whether the text holds a letter, a character of a category L*; never null."""
    return F.coalesce(F.col(name), F.lit("")).rlike(r"\p{L}")


def _slices(texts: pa.Array):
    """Lower-cased texts in slices of bounded size."""
    held, size = [], 0
    for at in range(0, len(texts), 256):
        for text in texts.slice(at, 256).to_pylist():
            coded = (text or "").lower().encode()
            if held and (size + len(coded) > CHUNK_BYTES or len(held) >= 1024):
                yield held
                held, size = [], 0
            held.append(coded)
            size += len(coded)
    if held:
        yield held


def presence(texts: list[bytes]) -> np.ndarray:
    """Boolean texts x DIMENSION: which bins the n-grams of each text fall into."""
    made = np.zeros((len(texts), DIMENSION), bool)
    lengths = np.array([len(t) + len(_EDGE) for t in texts])
    data = np.frombuffer(_EDGE.join(texts) + _EDGE, np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMENSION, lengths)
    shift, flat = np.uint32(32 - DIMENSION.bit_length() + 1), made.reshape(-1)
    gram = np.zeros(len(data), np.uint32)
    for n, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        gram = gram[:len(data) - n] + data[n:] * np.uint32(factor)
        flat[row[:len(gram)] + ((gram + np.uint32(n * 0x27D4EB2F)) * np.uint32(0x2C1B3C6D) >> shift)] = True
    return made


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values; landmarks are rows already divided by the root of their size."""
    counts = x.sum(axis=1)
    return (x.astype(np.float32) @ landmarks.T) / np.sqrt(np.maximum(counts, 1))[:, None].astype(np.float32)


def fit(x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Model of presence rows x with their labels."""
    classes = sorted(set(labels))
    picked = np.random.default_rng(7).permutation(len(x))[:landmarks]
    base = x[picked].astype(np.float32) / np.sqrt(np.maximum(x[picked].sum(axis=1), 1))[:, None].astype(np.float32)
    values, vectors = np.linalg.eigh(_kernel(x[picked], base).astype(np.float64))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    features = _kernel(x, base) @ whiten
    features = np.column_stack([features, np.ones(len(x))])
    target = np.where(np.array(labels)[:, None] == np.array(classes), 1.0, -1.0)
    weight = np.array([1 / labels.count(c) for c in labels])
    gram = features.T @ (features * weight[:, None]) + ridge * len(classes) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (target * weight[:, None]))
    return {"classes": classes, "landmarks": base, "weights": (whiten @ solved[:-1]).astype(np.float32), "bias": solved[-1]}


def train(docs: DataFrame, labelled: Column, sample: int = SAMPLE) -> dict | None:
    """Fits on about `sample` rows, no more, where `labelled` holds and lang and text are given, even over languages; rows
    are chosen by the hash of their ids and texts, rows that repeat both count as one. Only presence bits reach the driver, DIMENSION / 8 bytes a row."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rows = docs.where(labelled & F.col("lang").isNotNull() & has_letter()).select("doc_id", "lang", "text", place.alias("_hash"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("_of"))
    names = counts.count()
    if not names:
        return None
    each = max(1, sample // names)
    # by their hash more of a language's texts than are wanted, whatever its size; copies are one; then the first of these
    wanted = float((2 * each + 30) * (1 << 30))
    near = (rows.join(F.broadcast(counts) if names <= 10_000 else counts, "lang")
            .where(F.col("_hash").cast("double") * F.col("_of") < wanted)
            .groupBy("lang", "doc_id", "_hash").agg(F.min("text").alias("text")))
    order = Window.partitionBy("lang").orderBy("_hash", "doc_id")

    @F.arrow_udf("binary")
    def bits(texts: pa.Array) -> pa.Array:
        found = [row.tobytes() for part in _slices(texts) for row in np.packbits(presence(part), axis=1)]
        return pa.array(found, pa.binary())

    chosen = (near.select("doc_id", "lang", "_hash", bits("text").alias("bits"))
              .withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= each).select("lang", "bits"))
    rows = sorted((r["lang"], r["bits"]) for r in chosen.toArrow().to_pylist())
    if not rows:
        return None
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in rows]), axis=1).view(bool)
    return fit(x, [lang for lang, _ in rows])


def identify(docs: DataFrame, model: dict | None, into: str = "language") -> DataFrame:
    """The documents with one more column, struct(lang_pred string, score double, letter boolean), from the text alone.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text if there was nothing to
    learn from; `letter` tells the two apart, false only where the text holds none. Texts are read whole. Equal margins go to the language that sorts first. Other columns stay (one
    named as `into` is replaced); an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,letter:boolean>")
    def predict(texts: pa.Array, letter: pa.Array) -> pa.Array:
        model = sent.value
        if model is None:
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            names = [UNKNOWN]
        else:
            margins = [_kernel(presence(part), model["landmarks"]) @ model["weights"] + model["bias"]
                       for part in _slices(texts)]
            margins = np.concatenate(margins) if margins else np.zeros((0, len(model["classes"])))
            names, best = model["classes"], margins.argmax(axis=1)
            score = np.clip((margins.max(axis=1, initial=-1.0) + 1) / 2, 0, 1)
        known = letter.to_numpy(zero_copy_only=False).astype(bool) & (model is not None)
        return pa.StructArray.from_arrays(
            [pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
             pa.array(np.where(known, score, 0.0).astype(np.float64)), letter], ["lang_pred", "score", "letter"])

    return docs.withColumn(into, predict(F.col("text"), has_letter()))
