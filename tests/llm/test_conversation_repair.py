"""Conversation repair against a forward search over all edits, and whole tables with nulls, ties, copies and hot conversations."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sensorlake.llm import conversation_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, block int"


def brute(rows):
    """rows (turn, role, text) after damage, in order: what the contract says, by the best path to each state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append(None if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    made = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def widen(best):
        for _ in range(4):
            for q, (cost, audit, out) in list(best.items()):
                r, role = made[q]
                way = (cost + 2, audit + "I", [*out, f"{role}:"])
                if r not in best or way < best[r]:
                    best[r] = way
        return best

    best = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for q, (cost, audit, out) in widen(best).items():
            ways = [(q, (cost + 3, audit + "D", out))]
            if fault in (None, "truncated"):
                more = fault is not None
                if (q, role[:1]) in step:
                    ways.append((step[q, role[:1]], (cost + more, audit + "K", [*out, f"{role}:{text}"])))
                ways.append((made[q][0], (cost + 2 + more, audit + "R", [*out, f"{made[q][1]}:{text}"])))
            for r, way in ways:
                if r not in after or way < after[r]:
                    after[r] = way
        best = after
    cost, audit, out = min(way for q, way in widen(best).items() if q in (0, 3))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, n in sizes:
        for i in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why? ", "", " \t\n", None, "it ends\n.", f"line {i}.", f"line {i}", "é!"])
            rows.append((conv, rng.choice([i, i, i, i + 3, None]), role, text, "x", 1))
    return rows


@pytest.fixture(scope="module")
def rows():
    made = conversations(1, [(i, i % 9) for i in range(60)] + [(None, 7), (1000, 500), (1001, 90)])
    return made + [(1000, 5, "user", "Yes.", "x", 1)] * 400 + [(7, None, None, None, "x", 1)] * 3


def test_matches_a_forward_search(spark, rows):
    found = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA))
    report = {r[0]: tuple(r)[1:] for r in found.report().collect()}
    digests = {r[0]: tuple(r)[1:] for r in found.digests().collect()}
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    assert set(report) == set(digests) == set(groups)
    for conv, group in groups.items():
        assert (*report[conv], *digests[conv]) == brute(group), conv


def test_long_conversations_make_few_checkpoints(spark):
    turns = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                       F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                       F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    found = conversation_repair.repair(turns)
    sizes = [r["count"] for r in found._rows.groupBy("block").count().collect()]
    assert max(sizes) <= 64 + (2 * 20_000) ** 0.5 and len(sizes) <= 4 + (2 * 4 * 20_000) ** 0.5
    assert found.report().first().cost == 0 and found.digests().first().audit == "K" * 20_000
    assert found.edits().count() == 20_000


def test_edits_leave_rows_in_order(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "a long text " * 50_000 + "."), (2, 0, "system", " ")]
    edits = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).edits()
    made = [tuple(r) for r in edits.orderBy("conv_id", "block", "place").select("conv_id", "op", "role", "text").collect()]
    assert made == [(1, "I", "user", ""), (1, "K", "assistant", "Hi."), (1, "K", "user", rows[1][3]), (1, "I", "assistant", ""),
                    (2, "D", None, None)]


def test_empty_tables(spark):
    found = conversation_repair.repair(spark.createDataFrame([], SCHEMA))
    assert [x.count() for x in (found.report(), found.digests(), found.edits())] == [0, 0, 0]


def test_damaged_query(spark, rows, tmp_path):
    import zlib

    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    groups = {}
    for conv, turn, role, text, *_ in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
        group = groups.setdefault(conv, [])
        group += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    made = queries.op12_conversation_repair(spark, str(tmp_path))
    assert {r[0]: tuple(r)[1:] for r in made.collect()} == {conv: brute(group) for conv, group in groups.items()}
