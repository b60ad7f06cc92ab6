"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded (shares of character classes, how much of it
repeats, hashed byte pairs, one learned layer), gated attention weighs the passages, and the weighted mean of their
codes is scored. Only document labels are known; encoder, attention and score are learned together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, flat

PASSAGE = 1024
PAIR_BINS = 240
HIDDEN, ATTENTION = 32, 16
#: labelled documents that training sees, whole; bytes of text of all of them together
SAMPLE, SAMPLE_BYTES = 4000, 1 << 25
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.int64)  # 0 control
for _i, _range in enumerate((range(0x20, 0x21), range(0x0A, 0x0B), range(0x61, 0x7B), range(0x41, 0x5B),
                             range(0x30, 0x3A), b".,;:'\"()-", b"!?", range(0x80, 0xC0), range(0xC0, 0x100)), 1):
    _CLASSES[list(_range)] = _i
_CLASSES[[b for b in range(0x21, 0x7F) if _CLASSES[b] == 0]] = 10
_N_CLASSES = 11
FEATURES = _N_CLASSES + 4 + PAIR_BINS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text with the end); an empty text has one empty passage."""
    sizes = np.diff(offsets)
    pieces = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(pieces)])
    n = int(first[-1])
    place = np.arange(n) - np.repeat(first[:-1], pieces)
    start = np.repeat(offsets[:-1], pieces) + place * np.repeat(sizes, pieces) // np.repeat(pieces, pieces)
    end = np.repeat(offsets[:-1], pieces) + (place + 1) * np.repeat(sizes, pieces) // np.repeat(pieces, pieces)
    length = end - start
    owner = np.repeat(np.arange(n, dtype=np.int64), length)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(data))  # bytes to the end of the text: no n-gram reaches into the next
    size = np.maximum(length, 1)[:, None].astype(np.float32)
    lower = data.astype(np.uint32)
    lower += 32 * ((data >= 65) & (data <= 90)).astype(np.uint32)
    shares = np.bincount(owner * _N_CLASSES + _CLASSES[data], minlength=n * _N_CLASSES).reshape(n, -1) / size
    made = [shares]
    pair = lower[:-1] * np.uint32(257) + lower[1:] if len(lower) > 1 else np.zeros(0, np.uint32)
    bins = (pair * np.uint32(0x9E3779B1) >> np.uint32(12)) % np.uint32(PAIR_BINS)
    own = left[:len(bins)] > 1
    hashed = np.bincount((owner[:len(bins)] * PAIR_BINS + bins)[own], minlength=n * PAIR_BINS).reshape(n, -1) / size
    gram = np.zeros(len(lower), np.uint32)
    for i, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646C)):
        gram = gram[:max(0, len(lower) - i)] + lower[i:] * np.uint32(factor)
        if i in (2, 5):  # distinct n-grams of 3 and 6 bytes
            seen = np.zeros((n, 4096), bool)
            places = owner[:len(gram)] * 4096 + (gram * np.uint32(0x2C1B3C6D) >> np.uint32(20))
            seen.reshape(-1)[places[left[:len(gram)] > i]] = True
            made.append(seen.sum(axis=1)[:, None] / size)
    blanks = shares[:, 1:3].sum(axis=1)
    made += [np.log1p(length)[:, None] / 8, np.minimum(1 / np.maximum(blanks, 0.02), 50)[:, None] / 50,
             np.sqrt(hashed)]
    return np.concatenate(made, axis=1).astype(np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """Encodes passages, weighs them within each document, scores the documents."""
    h = np.tanh((x - m["mean"]) / m["scale"] @ m["E"] + m["e"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    raw = (t * g) @ m["w"]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    a = np.exp(raw - np.maximum.reduceat(raw, first[:-1])[owner])
    a /= np.add.reduceat(a, first[:-1])[owner]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "owner": owner, "p": _sigmoid(z @ m["c"] + m["b"])}


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3) -> dict:
    """Trains by Adam on cross-entropy; the same rows always give the same model."""
    rng = np.random.default_rng(11)
    m = {"E": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.2, (HIDDEN, ATTENTION)),
         "w": rng.normal(0, 0.2, ATTENTION), "c": rng.normal(0, 0.2, HIDDEN), "b": np.zeros(())}
    fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 0.02}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step, counts = 0, np.diff(first)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            bag = np.concatenate([[0], np.cumsum(counts[docs])])
            xb, full = x[rows], m | fixed
            f = _forward(full, xb, bag)
            d_out = (f["p"] - labels[docs]) / len(docs)
            d_z = d_out[:, None] * m["c"]
            d_h = f["a"][:, None] * d_z[f["owner"]]
            d_a = (f["h"] * d_z[f["owner"]]).sum(axis=1)
            d_raw = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, bag[:-1])[f["owner"]])
            d_t = d_raw[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2)
            d_g = d_raw[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
            d_h = (d_h + d_t @ m["V"].T + d_g @ m["U"].T) * (1 - f["h"] ** 2)
            scaled = (xb - fixed["mean"]) / fixed["scale"]
            grad = {"E": scaled.T @ d_h, "e": d_h.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g,
                    "w": (f["t"] * f["g"]).T @ d_raw, "c": f["z"].T @ d_out, "b": d_out.sum()}
            step += 1
            for k, g in grad.items():
                g = g + (1e-4 * m[k] if k in "EVUc" else 0)
                one, two = moments[k]
                one = 0.9 * one + 0.1 * g
                two = 0.999 * two + 0.001 * g * g
                moments[k] = (one, two)
                m[k] = m[k] - rate * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.999 ** step)) + 1e-8)
    return {k: np.asarray(v, np.float32) for k, v in (m | fixed).items()}


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> dict | None:
    """Fits on at most `sample` labelled documents where `learn` holds, in the order of the hash of their ids, as long as
    their texts stay within `most` bytes; a single text beyond that is passed over. Each is learned from with all its
    passages; of rows with one id, the one with the smallest hash of its text. What reaches the driver are features, about
    as many bytes as the texts have. None without labelled documents."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    rows = docs.where(learn).select("doc_id", "text")
    ids = rows.select("doc_id").join(marked, "doc_id", "left_semi").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).join(marked, "doc_id")
    whole = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    in_order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over the sample

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        made = []
        for a, b in chunks(offsets):
            x, first = passages(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            made += [x[first[i]:first[i + 1]].tobytes() for i in range(b - a)]
        return pa.array(made, pa.binary())

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    held = (whole.withColumn("_bytes", size).where(F.col("_bytes") <= most)
            .withColumn("_so_far", F.sum("_bytes").over(in_order)).where(F.col("_so_far") <= most))
    chosen = held.select("doc_id", "quality", features("text").alias("x")).toArrow().to_pylist()
    if not chosen:
        return None
    chosen.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in chosen]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return fit(np.concatenate(bags), first, np.array([float(r["quality"] > 0) for r in chosen]))


def score_quality(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD, into: str = "quality_score") -> DataFrame:
    """The documents with one more column, struct(score double, predicted int), from the whole text alone.

    Null and empty texts are one empty passage and are scored like any other. Without a model every score is 0.5.
    Rows with equal texts get equal scores; other columns stay (one named as `into` is replaced); an empty table gives
    an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,predicted:int>")
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        scores = []
        for a, b in chunks(offsets):
            if sent.value is None:
                scores.append(np.full(b - a, 0.5))
            else:
                x, first = passages(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                scores.append(_forward(sent.value, x, first)["p"].astype(np.float64))
        made = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(made), pa.array((made >= threshold).astype(np.int32))],
                                          ["score", "predicted"])

    return docs.withColumn(into, score(F.col("text")))
