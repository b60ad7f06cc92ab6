"""Near-duplicate join: all pairs of texts whose shingle sets reach a Jaccard similarity, found by T-occurrence search.

Texts with the same shingle set are one node. A partner of a set of n shingles shares at least T = ceil(s n) of them, so
the T - 1 longest inverted lists need no merging: a partner must be on one of the others. Which lists are long is read
from a fixed-size table of counts over all documents; only the short lists are built. The smaller set of a pair shares
at least 2s / (1 + s) of its own size, so a list must be one of even fewer of its lists: the sets it leads. A list that
no set leads is dropped. Within a list one member is the pivot, and the others are first compared with it; components
of the links so far then leave only pairs between components to compare, each leader with larger members, large lists
in blocks: each leader with its most alike partner only, again while that halves the components, which joins the edited
copies of one text without all their pairs, then all pairs that are left between components. Comparing is DivideSkip again: a task holds the inverted lists of a block of members over the
pivot's shingles, merges the short ones, and probes the long ones by binary search for members that are still within
reach of the overlap. The result is exact; pivots only decide the order of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import BLANK, NULL_ID, Words, byte_codes, chunks, flat, id_key, mix

#: counters of the table that orders lists by length; more counters tell shorter lists apart, the result is the same
COUNTERS = 1 << 22
#: members of a pivot that are compared in one block
BLOCK = 1000
#: rows of lists with the same first node, and leaders among them, that one task compares
LIST_BLOCK = 4000
#: nodes that a task remembers so as not to list copies of a text again
REMEMBERED = 1 << 20
#: bytes of text that one numpy step works on; a longer text is a step of its own
STEP_BYTES = 1 << 18
_PIECE = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within each text; first of each text with the end).

    A text of fewer than k words, but not none, has its whole word sequence as its one shingle.
    """
    words = Words(data, offsets, BLANK, codes)
    counts = np.diff(words.first)
    values = words.grams(k)
    inside = words.text_of[:len(values)] == words.text_of[k - 1:] if len(values) else np.zeros(0, bool)
    found, owner = [values[inside]], [words.text_of[:len(values)][inside]]
    for n in range(1, k):
        texts = np.flatnonzero(counts == n)
        if len(texts):
            found.append(words.grams(n)[words.first[texts]])
            owner.append(texts)
    values, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(offsets)))


def _sets(texts: pa.Array, k: int, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = flat(texts)
    for a, b in chunks(offsets, STEP_BYTES):
        yield shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k, codes)


def _signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit sum over each set, times 2: equal sets, equal sums. The last bit is free for a flag."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64) & -2


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Documents per counter of the shingles that fall on it, over all documents; COUNTERS numbers on the driver.

    A task counts to 255, which is long in any order.
    """
    codes = byte_codes()

    def count(batches):
        total = np.zeros(COUNTERS, np.uint8)
        for batch in batches:
            held = [np.zeros(0, np.int32)]
            for values, _ in _sets(batch.column(0), k, codes):
                held.append((values & np.uint64(COUNTERS - 1)).astype(np.int32))
            places, counts = np.unique(np.concatenate(held), return_counts=True)
            total[places] = np.minimum(total[places].astype(np.int64) + counts, 255).astype(np.uint8)
        pieces = total.reshape(-1, _PIECE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)),
                                          pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "counts"])

    def merge(batches):
        piece, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                              ["piece", "counts"])
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != piece:
                    if piece is not None:
                        yield done()
                    piece, total = p, np.zeros(_PIECE, np.uint32)
                total += np.frombuffer(c, np.uint8)
        if piece is not None:
            yield done()

    schema = "piece int, counts binary"
    merged = (docs.select("text").mapInArrow(count, schema).repartition("piece").sortWithinPartitions("piece")
              .mapInArrow(merge, schema))
    made = np.zeros((COUNTERS // _PIECE, _PIECE), np.uint32)
    for row in merged.toArrow().to_pylist():
        made[row["piece"]] = np.frombuffer(row["counts"], np.uint32)
    return made.ravel()


def _parity(values: np.ndarray, n: int) -> bytes:
    """A bit per hash value modulo a power of two of 2 n to 4 n, set if an odd number of values fall on it."""
    bits = max(64, 2 << int(n).bit_length())
    odd = np.bincount((values >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(n_a: int, a: bytes, n_b: int, b: bytes) -> int:
    """The least number of values that sets with these sizes and parity bits differ in: each odd bit of both is one."""
    x, y = sorted((a, b), key=len)
    low, high = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    size = len(y) * 8
    while size > len(x) * 8:  # parities modulo half the size
        size //= 2
        high = (high & ((1 << size) - 1)) ^ (high >> size)
    return max((low ^ high).bit_count(), abs(n_a - n_b))


def may_link(n_a: int, a: bytes, n_b: int, b: bytes, percent: int) -> bool:
    """False only if sets with these sizes and parity bits differ in too many values."""
    return differences(n_a, a, n_b, b) * (100 + percent) <= (n_a + n_b) * (100 - percent)


def features(docs: DataFrame, k: int, *more: Column) -> DataFrame:
    """(doc_key, n, node, parity): size of the set, its signature (equal sets, equal nodes) and its parity bits; before
    them the columns of `more`."""
    codes = byte_codes()

    @F.arrow_udf("struct<n:long,node:long,parity:binary>")
    def describe(texts: pa.Array) -> pa.Array:
        sizes, nodes, parity = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for values, first in _sets(texts, k, codes):
            n = np.diff(first)
            sizes.append(n)
            nodes.append(_signatures(values, first))
            parity += [_parity(values[first[i]:first[i + 1]], n[i]) for i in range(len(n))]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(nodes)),
                                           pa.array(parity, pa.binary())], ["n", "node", "parity"])

    made = docs.select(*more, id_key().alias("doc_key"), describe("text").alias("f"))
    return materialize(made.select(*made.columns[:-1], "f.*"), "shingle-features")


def prefixes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists of a set of n shingles on which all partners are found, lists on which larger or equal partners are)."""
    return (np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0),
            np.where(n > 0, n + (-2 * percent * n) // (100 + percent) + 1, 0))


def short_lists(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(shingle, node) of the lists that are not among the T - 1 longest of the node's set; the last bit of node tells
    whether the node leads the list."""
    counts = shingle_counts(docs, k)
    level = (4 * np.log2(1 + counts / max(0.25, counts.mean()))).astype(np.uint8)
    sent, codes = docs.sparkSession.sparkContext.broadcast(level), byte_codes()

    def choose(batches):
        level, seen = sent.value, np.full(REMEMBERED, -1, np.int64)
        for batch in batches:
            for values, first in _sets(batch.column(0), k, codes):
                n, node = np.diff(first), _signatures(values, first)
                fresh = np.zeros(len(n), bool)
                each, at = np.unique(node, return_index=True)
                slot = (each >> 7) & (REMEMBERED - 1)
                fresh[at[seen[slot] != each]] = True
                seen[slot] = each  # whole values, newer ones in place of older: a forgotten copy is listed again
                owner = np.repeat(np.arange(len(n)), n)
                some = fresh[owner]
                values, owner = values[some], owner[some]
                rank = (level[(values & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (values >> np.uint64(7))
                order = np.lexsort((rank, owner))
                n = np.where(fresh, n, 0)
                place = np.arange(len(values)) - (np.cumsum(n) - n)[owner]
                listed, led = prefixes(n, percent)
                keep = place < listed[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[order][keep].view(np.int64)),
                     pa.array(node[owner[keep]] | (place < led[owner])[keep])], ["shingle", "node"])

    return docs.select("text").mapInArrow(choose, "shingle long, node long")


def _groups(batches, keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Column arrays cut so that rows with equal first columns, which follow each other, stay together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not len(new[0]):
            continue
        held = new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]
        differ = np.zeros(len(held[0]), bool)
        for i in range(keys):
            differ[1:] |= held[i][1:] != held[i][:-1]
        cuts = np.flatnonzero(differ)
        if len(cuts):
            yield tuple(h[:cuts[-1]] for h in held)
            held = [h[cuts[-1]:] for h in held]
    if held is not None:
        yield tuple(held)


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), [len(values)]])


def inverted_lists(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(list, node, lead) of the short lists with two or more nodes that a node leads; equal lists are kept once."""
    def kept(batches):
        for shingle, node in _groups(batches, 1):
            new = np.ones(len(node), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
            shingle, node = shingle[new], node[new]  # copies of a text are one node
            runs = _runs(shingle)
            sizes = np.diff(runs)
            led = np.maximum.reduceat(node & 1, runs[:-1]) > 0
            several = np.repeat((sizes > 1) & led, sizes)
            if several.any():
                alike = np.add.reduceat(mix(node.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), runs[:-1]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(alike, sizes)[several]), pa.array(shingle[several]), pa.array(node[several])],
                    ["list", "shingle", "node"])

    lists = (short_lists(docs, k, percent).repartition("shingle").sortWithinPartitions("shingle", "node")
             .mapInArrow(kept, "list long, shingle long, node long"))
    lists = materialize(lists, "shingle-lists")
    first = lists.groupBy("list").agg(F.min("shingle").alias("shingle"))
    kept_once = lists.join(first, ["list", "shingle"])
    return materialize(kept_once.select("list", F.col("node").bitwiseAND(F.lit(-2)).alias("node"),
                                        (F.col("node").bitwiseAND(F.lit(1)) == 1).alias("lead")), "distinct-lists")


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, far) of the pairs whose sizes and parity bits allow a link; far counts bits that differ."""
    @F.arrow_udf("int")
    def distance(n_a: pa.Array, a: pa.Array, n_b: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(n_a.to_pylist(), a.to_pylist(), n_b.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([abs(na - nb) + (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
                         if may_link(na, x, nb, y, percent) else None for na, x, nb, y in rows], pa.int32())

    # called nondeterministic, so that the filter below does not have it called a second time, by workers of its own
    distance = distance.asNondeterministic()
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    joined = pairs.join(one, "a").join(two, "b").where(near)
    return (joined.select("a", "b", distance("n_a", "parity_a", "n_b", "parity_b").alias("far"))
            .where(F.col("far").isNotNull()))


def _t_occurrences(query: np.ndarray, values: np.ndarray, first: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Shingles that each set of a block shares with the query; exact where it reaches `least`, else less than that."""
    at = np.minimum(np.searchsorted(query, values), len(query) - 1)
    hit = query[at] == values
    member = np.repeat(np.arange(len(first) - 1), np.diff(first))[hit]
    order = np.argsort(at[hit], kind="stable")
    member, sizes = member[order], np.bincount(at[hit], minlength=len(query))
    start = np.concatenate([[0], np.cumsum(sizes)])
    longest = int(sizes.max(initial=1))
    bound = int(least.min())
    n_long = int(min(bound - 1, max(0, bound / (0.01 * np.log2(longest + 1) * len(query) ** 0.5 + 1)))) if bound > 1 else 0
    long = np.argsort(-sizes, kind="stable")[:n_long]
    is_long = np.zeros(len(query), bool)
    is_long[long] = True
    # the short lists are merged: sorting their runs together and counting equal members
    count = np.bincount(member[~np.repeat(is_long, sizes)], minlength=len(first) - 1)
    alive = np.flatnonzero(count >= least - n_long)
    for done, i in enumerate(long, 1):  # binary probes of the long lists, for members still within reach
        run = member[start[i]:start[i + 1]]
        if not len(run) or not len(alive):
            continue
        place = np.minimum(np.searchsorted(run, alive), len(run) - 1)
        count[alive] += run[place] == alive
        alive = alive[count[alive] >= least[alive] - (n_long - done)]
    return count


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int, labels: DataFrame) -> DataFrame:
    """(a, b) of pairs that link, decided on the whole shingle sets of their texts, as many as components need.

    Texts travel once for each pair to their pivot a, of which large groups are dealt into blocks. Members that bear one
    label are linked already: once a block has linked its pivot to one of them, the others are passed over.
    """
    spark = docs.sparkSession
    pairs = materialize(pairs.select("a", "b"), "pairs")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(blocks, "a").select(
        F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"),
        F.col("b").alias("node"))
    pivots = blocks.select(F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                           F.lit(0).alias("kind"), F.col("a").alias("node"))
    low = sets.select("node", F.col("low").alias("doc_key"))
    roles = members.unionByName(pivots).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    roles = materialize(roles.join(low, "node"), "roles")
    # a bitmap of fixed size keeps most other texts out of the join
    places = roles.select((F.xxhash64("doc_key").bitwiseAND((1 << 22) - 1)).cast("int").alias("place")).distinct().toArrow()
    bits = np.zeros(1 << 22, bool)
    bits[places["place"].to_numpy()] = True
    sent = spark.sparkContext.broadcast(np.packbits(bits))

    @F.arrow_udf("boolean")
    def wanted(place: pa.Array) -> pa.Array:
        return pa.array(np.unpackbits(sent.value).view(bool)[place.to_numpy(zero_copy_only=False)])

    # called nondeterministic, so that Spark cannot infer it for the roles on the other side of the join too
    wanted = wanted.asNondeterministic()
    texts = docs.select(id_key().alias("doc_key"), "text")
    texts = texts.where(wanted(F.xxhash64("doc_key").bitwiseAND((1 << 22) - 1).cast("int")))
    codes = byte_codes()

    def compare(batches):
        pivot, query, told = None, None, np.zeros(0, np.int64)
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            kind, node, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            data, offsets = flat(batch.column(5))
            for a, b in chunks(offsets, STEP_BYTES):
                values, first = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k, codes)
                n, same = np.diff(first), _signatures(values, first) == node[a:b]
                at = a
                while at < b:
                    end = at + 1
                    while end < b and keys[end] == keys[at]:
                        end += 1
                    if keys[at] != pivot:
                        pivot, query, told = keys[at], None, np.zeros(0, np.int64)
                    rows = np.arange(at, end)
                    for r in rows[(kind[rows] == 0) & same[rows - a]]:
                        query = values[first[r - a]:first[r - a + 1]]
                    rows = rows[(kind[rows] == 1) & same[rows - a] & ~np.isin(label[rows], told)] - a
                    if query is not None and len(query) and len(rows):
                        some = np.concatenate([values[first[r]:first[r + 1]] for r in rows])
                        starts = np.concatenate([[0], np.cumsum(n[rows])])
                        total = len(query) + n[rows]
                        least = -(-percent * total // (100 + percent))
                        links = rows[_t_occurrences(query, some, starts, least) >= least] + a
                        if len(links):
                            new, which = np.unique(label[links], return_index=True)
                            told, links = np.union1d(told, new), links[which]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(links), pivot[0])), pa.array(node[links])], ["a", "b"])
                    at = end

    moved = (texts.join(roles, "doc_key").select("pivot", "block", "kind", "node", "label", "text")
             .repartition("pivot", "block").sortWithinPartitions("pivot", "block", "kind"))
    return moved.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) lead to; smallest labels travel along links, then jump."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                       "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                         .select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        seen = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen")))
        lower = labels.join(seen, "node").select("node", "label", F.least("label", "seen").alias("next"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        labels_next = materialize(lower.join(jump, "next").select(
            "node", F.col("jump").alias("label"), (F.col("jump") != F.col("label")).alias("moved")), "labels")
        labels = labels_next.select("node", "label")
        if not labels_next.where("moved").head(1):
            return labels


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that still hold nodes of several components, with the nodes' labels. A node that neither leads the list
    nor has another label than its leaders has nothing to find there."""
    rows = lists.join(labels, "node", "left").select("list", "node", "lead", F.coalesce("label", "node").alias("label"))
    rows = materialize(rows, "labelled-lists")
    leader = F.when(F.col("lead"), F.col("label"))
    open_ = (rows.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min(leader).alias("lead_x"),
                                      F.max(leader).alias("lead_y"))
             .where("x <> y").select("list", "lead_x", "lead_y"))
    return materialize(rows.join(open_, "list").where("lead or lead_x <> lead_y or label <> lead_x")
                       .select("list", "node", "lead", "label"), "open-lists")


def _across(lists: DataFrame, sets: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """(a, b): pairs of a leader and a larger or equal node of its list whose labels differ and whose sizes and parity
    bits allow a link; with `nearest`, of each leader b only the pair in which fewest bits differ.

    Lists of one passage mostly begin with the same node and stay together, so that a pair is told once. Where they are
    large, leaders and nodes are dealt into blocks, and each task compares a block of the ones with a block of the others.
    """
    def pairs(batches):
        for pivot, l_block, block, list_, lead, n, node, label, parity in _groups(batches, 3):
            told, of = set(), None  # pairs given already from another list of the block
            best = {}  # of a leader: (bits that differ, node)
            width = np.array([len(p) for p in parity])
            words = {w: np.frombuffer(b"".join(p for p in parity if len(p) == w), np.uint64).reshape(-1, w // 8)
                     for w in np.unique(width)}
            row = np.zeros(len(node), np.int64)
            for w in words:
                row[width == w] = np.arange((width == w).sum())
            new = np.ones(len(node), bool)
            new[1:] = ((list_[1:] != list_[:-1]) | (block[1:] != block[:-1]) | (l_block[1:] != l_block[:-1])
                       | (pivot[1:] != pivot[:-1]))
            runs = np.append(np.flatnonzero(new), len(node))
            for start, end in zip(runs[:-1], runs[1:], strict=True):
                if (here := (pivot[start], l_block[start], block[start])) != of:
                    told, of = set(), here
                leaders = start + int(np.searchsorted(lead[start:end], True))  # after the others
                for i in range(leaders, end):
                    low, high = np.searchsorted(n[start:leaders], [n[i], n[i] * 100 // percent + 1]) + start
                    other = np.flatnonzero(label[low:high] != label[i]) + low
                    same = other[width[other] == width[i]]
                    table = words[width[i]]
                    odd = np.bitwise_count(table[row[same]] ^ table[row[i]]).sum(axis=1, dtype=np.int64)
                    fits = odd * (100 + percent) <= (n[i] + n[same]) * (100 - percent)
                    near, odd = same[fits].tolist(), odd[fits].tolist()
                    for j in other[width[other] != width[i]].tolist():
                        if may_link(int(n[i]), parity[i], int(n[j]), parity[j], percent):
                            near.append(j)
                            odd.append(differences(int(n[i]), parity[i], int(n[j]), parity[j]))
                    if nearest:
                        if near:
                            best[node[i]] = min(best.get(node[i], (np.inf, 0)), min(zip(odd, node[near].tolist(), strict=True)))
                        continue
                    found = {(min(node[i], node[j]), max(node[i], node[j])) for j in near} - told
                    told |= found
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([p[at] for p in found], pa.int64()) for at in (0, 1)],
                                                         ["a", "b"])
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in best.values()], pa.int64()), pa.array(list(best), pa.int64()),
                                                  pa.array([x[0] for x in best.values()], pa.int64())], ["a", "b", "far"])

    begin = lists.groupBy("list").agg(F.min("node").alias("pivot"))
    rows = materialize(lists.join(begin, "list").join(sets.select("node", "n", "parity"), "node"), "members")
    blocks = rows.groupBy("pivot").agg(
        F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"),
        F.ceil(F.greatest(F.lit(1), F.count_if("lead")) / LIST_BLOCK).cast("int").alias("l_blocks"))
    block, l_block = F.pmod(F.xxhash64("node"), "blocks").cast("int"), F.pmod(F.xxhash64("node"), "l_blocks").cast("int")

    def task(l_at, at, lead):
        return F.struct(l_at.alias("l_block"), at.alias("block"), F.lit(lead).alias("lead"))
    as_node = F.transform(F.sequence(F.lit(0), F.col("l_blocks") - 1), lambda x: task(x, block, False))
    as_leader = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: task(l_block, x, True))
    dealt = rows.join(blocks, "pivot").select(
        "pivot", "list", "n", "node", "label", "parity",
        F.explode(F.when(F.col("lead"), F.concat(as_node, as_leader)).otherwise(as_node)).alias("t"))
    found = (dealt.select("pivot", "t.l_block", "t.block", "list", "t.lead", "n", "node", "label", "parity")
             .repartition("pivot", "l_block", "block")
             .sortWithinPartitions("pivot", "l_block", "block", "list", "lead", "n", "node")
             .mapInArrow(pairs, "a long, b long" + (", far long" if nearest else "")))
    return _most_alike(found) if nearest else found.distinct()


def _most_alike(near: DataFrame) -> DataFrame:
    """Of (a, b, far), each b with its most alike a only."""
    return near.groupBy("b").agg(F.min(F.struct("far", "a")).alias("p")).select(F.col("p.a").alias("a"), "b")


def _stars(lists: DataFrame, turn: int) -> DataFrame:
    """(a, b): each list's pivot with the members of other components. First the pivot is the member on most lists, which
    the edited copies of a text share with it; then one by hash."""
    if turn == 0:
        of_node = lists.groupBy("node").agg((-F.count("*")).alias("order"))
        lists = materialize(lists.join(of_node, "node"), "ordered-lists")
    else:
        lists = lists.withColumn("order", F.xxhash64("node", F.lit(turn)))
    pivot = lists.groupBy("list").agg(F.min(F.struct("order", "node", "label")).alias("p"))
    return (lists.join(pivot.select("list", F.col("p.node").alias("pivot"), F.col("p.label").alias("of")), "list")
            .where(F.col("label") != F.col("of"))
            .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())


def _grouped(docs: DataFrame, own: DataFrame, k: int, percent: int, turns: int) -> DataFrame:
    """(node, low, label): of each set of shingles, the smallest doc_key with it and the smallest node reachable by links."""
    sets = own.where("n > 0").groupBy("node").agg(F.min("doc_key").alias("low"), F.first("n").alias("n"),
                                                  F.first("parity").alias("parity"))
    sets = materialize(sets, "sets")
    lists = inverted_lists(docs, k, percent)
    labels = docs.sparkSession.createDataFrame([], "node long, label long")
    links, turn, before, whole = None, 0, None, False
    while not whole:
        open_ = _labelled(lists, labels)
        if turn < turns:  # each node against its most alike pivot only
            tried = _most_alike(plausible(_stars(open_, turn), sets, percent))
        else:  # what components have not settled
            tried = materialize(_across(open_, sets, percent, nearest=True), "most-alike")
            found = tried.join(labels.withColumnRenamed("node", "b"), "b", "left").select(F.coalesce("label", "b"))
            n = found.distinct().count()  # components; where all these pairs link, half of them at most are left
            if n == 0:
                break
            if whole := before is not None and 2 * n > before:
                tried = _across(open_, sets, percent)
            before = n
        new = materialize(verify(tried, sets, docs, k, percent, labels), "verified")
        links = new if links is None else materialize(links.unionByName(new), "all-links")
        labels = components(links)
        turn += 1
    return sets.join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))


def similar_components(docs: DataFrame, k: int = 5, percent: int = 75, turns: int = 2) -> DataFrame:
    """(doc_key, n_shingles, component): a row per document; component is the smallest doc_key reachable by links.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct k-word shingles; fewer words are one
    shingle. A null or empty text, or one of blanks only, has 0 shingles and is its own component. Rows are documents
    each, also those that repeat a doc_id; a null doc_id counts as the id NULL_ID, smaller than all others. Equal texts
    and equal sets link. Other columns are not read; an empty table gives an empty table. Shingles and sets are told
    apart by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    own = features(docs, k)
    whole = _grouped(docs, own, k, percent, turns)
    lowest = whole.groupBy("label").agg(F.min("low").alias("component"))
    found = materialize(whole.join(lowest, "label").select("node", "component"), "components")
    return own.join(found, "node", "left").select(
        "doc_key", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component")), "doc_key").alias("component"))


def first_of_groups(docs: DataFrame, k: int = 5, percent: int = 75, turns: int = 2) -> DataFrame:
    """One row of docs for each group of `similar_components`, whole and with all columns; documents of 0 shingles all stay.

    Groups are told apart by their sets, not by ids: rows that share a doc_id, also a null one, belong together only if
    links lead from one to the other. The row is the one with the smallest doc_id (null first), then the smallest hash of
    the text, then of the other columns; texts of one id are told apart by 64-bit hashes.
    """
    own = features(docs.select("doc_id", "text"), k, F.xxhash64("text").alias("text_hash"))
    whole = _grouped(docs.select("doc_id", "text"), own, k, percent, turns)
    of_set = own.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_key", "text_hash")).alias("first"))
    of_group = whole.join(of_set, "node").groupBy("label").agg(F.min("first").alias("first"))
    firsts = materialize(of_group.select("first.*"), "first-of-groups")

    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.where(worded).select(
        id_key().alias("doc_key"), F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"),
        (F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)).alias("order"))
    # copies under one id meet in each task before the shuffle
    once = keyed.groupBy("doc_key", "text_hash").agg(F.min_by("row", "order").alias("row"))
    kept = once.join(firsts, ["doc_key", "text_hash"], "left_semi").select("row.*")
    return kept.unionByName(docs.where(~worded))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of `similar_components`, with null ids as null."""
    made = similar_components(docs, k, percent)
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return made.select(shown("doc_key").alias("doc_id"), "n_shingles", shown("component").alias("component_id"))
