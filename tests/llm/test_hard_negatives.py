"""Hard negatives by brute force, the Hilbert curve, zone-map bounds and how much they let a read pass over."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.llm import hard_negatives, topk


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (1, 5), (4, 2)])
def test_curve_goes_from_cell_to_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    places = hard_negatives.hilbert(cells, bits)
    assert sorted(places.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_ranges_are_joined_over_the_smallest_gaps():
    assert hard_negatives.merged([(9, 9), (1, 2), (3, 4), (30, 31)], 2) == [(1, 9), (30, 31)]
    assert hard_negatives.merged([(9, 9), (1, 2), (3, 4), (30, 31)], 9) == [(1, 4), (9, 9), (30, 31)]
    assert hard_negatives.merged([], 4) == []
    assert hard_negatives.merged([(1, 2), (50, 60)], 1) == [(1, 60)]


def brute(rows, scale=256):
    held = []
    for vec_id, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            held.append((vec_id, label, [math.floor(scale * v) for v in x]))
    least = -2 ** 63
    made = []
    for a, label, x in {(i, y, tuple(v)) for i, y, v in held if i is not None and i % 100 == 0}:
        def ranked(others):
            scored = [(sum(p * q for p, q in zip(x, v, strict=False)), i) for i, v in others]
            return sorted(scored, key=lambda r: (-r[0], least if r[1] is None else r[1]))
        positives = ranked((i, v) for i, y, v in held if y == label and i != a)[:5]
        unlike = ranked((i, v) for i, y, v in held if y != label)
        for ps, p in positives:
            for rank, (ns, i) in enumerate([u for u in unlike if 80 * ps <= 100 * u[0] <= 100 * ps][:5], 1):
                made.append((a, p, rank, i, ps, ns))
    return sorted(made, key=str)


def clustered(seed, n, width=16, clusters=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, width))
    of = rng.integers(0, clusters, n)
    x = centers[of] + 0.1 * rng.normal(size=(n, width))
    labels = np.where(rng.random(n) < 0.1, (of + 1) % 5, of % 5)
    return [(i, v, int(y)) for i, (v, y) in enumerate(zip((x / np.linalg.norm(x, axis=1)[:, None]).tolist(), labels, strict=True))]


SCHEMA = "vec_id long, embedding array<float>, label int, vector string, place string"


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "v", "p") for r in rows], SCHEMA).repartition(3)
    vectors = frame.select("vec_id", "label", topk.scaled(scale=256).alias("vector"), F.col("place").alias("id"))
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0).collect()), key=str)


def floats(rows):
    return [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x], y) for i, x, y in rows]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PACK", 7)
    rng = random.Random(2)
    rows = floats(clustered(1, 1500))
    rows += [rows[200], rows[201], (None, rows[5][1], rows[5][2]), (7000, None, 1), (7100, rows[9][1], None), (7200, [], 2),
             (7300, [1.0, None], 1), (7400, [float("nan")] * 16, 1), (7500, [float("inf")], 0), (7600, [0.5, 0.5], 3),
             (7700, [-x for x in rows[100][1]], 4), (7800, [0.0] * 16, 2)]
    rows += [(8000 + i, rows[300][1], rng.randint(0, 1)) for i in range(40)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.1, 1.0], 2)]
    assert mined(spark, rows) == [(0, 1, 1, 2, 65536, 230 * 256)]


def test_zone_maps_spare_reads_and_lose_nothing(spark):
    rows = clustered(3, 6000, clusters=20)
    vectors = spark.createDataFrame([(i, y, [math.floor(256 * v) for v in x], i % 100 == 0) for i, x, y in rows],
                                    "id long, label int, vector array<long>, asks boolean")
    blocks = hard_negatives.Blocks(vectors)
    one = next(x for x in rows if x[0] == 100)
    anchor = np.array([[math.floor(256 * v) for v in one[1]]])
    least = np.full((1, 1), int((anchor ** 2).sum() * 0.9))
    pack = hard_negatives._Pack(np.array([100]), np.array([one[2]], np.int32), anchor, 5, True, least, np.full((1, 1), 2 ** 62))
    spans = blocks.needed(pack)
    asked = [r.block for r in blocks.table().select("block").collect() if any(a <= r.block <= b for a, b in spans)]
    assert 0 < len(asked) <= blocks.table().count() / 2
    found = [tuple(r)[1:3] for r in blocks.search(pack).orderBy("rank").collect()]
    scored = sorted(((sum(a * math.floor(256 * b) for a, b in zip(anchor[0].tolist(), x, strict=True)), i) for i, x, y in rows
                     if y == one[2] and i != 100), key=lambda r: (-r[0], r[1]))
    assert found == [(i, s) for s, i in scored[:5]]
    plan = blocks.table().where(F.col("block").between(*spans[0]))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(block), GreaterThanOrEqual(block" in plan


def test_too_long_vectors(spark):
    vectors = spark.createDataFrame([(0, 1, [2 ** 31, 1])], "vec_id long, label int, vector array<long>")
    with pytest.raises(ValueError, match="too long"):
        hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)
    wide = [(0, 1, [2 ** 29, 1]), (1, 1, [2 ** 29, 3]), (2, 2, [2 ** 29 - 1, 2])]
    made = hard_negatives.hard_negatives(spark.createDataFrame(wide, "vec_id long, label int, vector array<long>"),
                                         F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in made] == [(0, 1, 1, 2, 2 ** 58 + 3, 2 ** 58 - 2 ** 29 + 2)]
