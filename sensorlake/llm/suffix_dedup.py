"""Removal of repeated byte strings by sorted suffixes.

A window is `length` consecutive bytes. Its smallest GRAM-byte hash says where it is compared, so equal windows meet
and a document is cut into pieces of consecutive windows with the same smallest gram. First only hashes of the pieces
travel: of equal pieces all but the smallest document's are settled, in the task that cuts them where it has both, else
where the gram meets. Then the pieces of grams that differ between documents are cut out of the texts once each, and
a task sorts the suffixes that begin their windows, deep-shallow: multikey quicksort over 8-byte characters down to
SHALLOW bytes, then a blind trie for each group that still agrees. Windows that agree in full stand side by side and
take their smallest document.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import byte_codes, flat, id_key, inverse_powers, mix, powers, slices, unused

LENGTH = 50
GRAM = 24
SHALLOW = 40
#: windows of a piece; longer runs of one gram are cut
PIECE = 64
#: different pieces of one gram beyond which Spark groups their windows one by one, instead of a task sorting them
GROUP = 20_000
#: pieces that a task remembers with their smallest document so far; a forgotten one only travels again
REMEMBERED = 1 << 20
#: bytes that one numpy step cuts into pieces; longer texts are sliced with overlap
STEP_BYTES = 1 << 18
#: tells texts of one doc_id apart
_TAG_BITS = 25
_GRAM_BITS = np.uint64((1 << 48) - 1)


def release(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of finished steps that nothing refers to any more."""
    for _ in range(2):  # the first pass lets go of what Python held, the second of what hung on it
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(1)


def least_grams(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, codes: np.ndarray):
    """(smallest gram, place, text) of every window of `length` bytes that lies in one text."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = mix(_run_hash(codes[data], gram))
    least, have = values & _GRAM_BITS, 1
    while have < length - gram + 1:
        step = min(have, length - gram + 1 - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return least[offsets[text] + place].astype(np.int64), place, text


def _run_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of the n values from each place on, by doubling and one last step."""
    power, have, before = powers(n + 1), 1, [values]
    while 2 * have <= n:
        values, have = values[:-have] * power[have] + values[have:], 2 * have
        before.append(values)
    for bit in reversed(range(len(before) - 1)):
        if n >> bit & 1:
            tail = before[bit][have:]
            values, have = values[:len(tail)] * power[1 << bit] + tail, have + (1 << bit)
    return values


class BlindTrie:
    """Orders byte strings of one length: inner nodes know only where strings part and by which byte."""

    def __init__(self, key: bytes, item: int):
        self.root: list = [None, key, [item]]  # a leaf; an inner node is [depth, children]

    def add(self, key: bytes, item: int) -> None:
        node = self.root
        while node[0] is not None:  # down by the parting bytes alone, to any leaf where none fits
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        known = node[1]
        if known == key:
            node[2].append(item)
            return
        depth = next(i for i in range(len(key)) if key[i] != known[i])  # one comparison tells where the key parts
        above, node = None, self.root
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][key[node[0]]]
        leaf = [None, key, [item]]
        if node[0] == depth:
            node[1][key[depth]] = leaf
            return
        inner = [depth, {known[depth]: node, key[depth]: leaf}]
        if above is None:
            self.root = inner
        else:
            above[1][key[above[0]]] = inner

    def groups(self) -> Iterator[list[int]]:
        """Items of equal strings, in order of the strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack += [child for _, child in sorted(node[1].items(), reverse=True)]


def sort_suffixes(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes at `starts` by their first `length` bytes; equal ones share a group number."""
    padded = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint64)
    word = np.zeros(len(padded) - 8, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i:i + len(word)]
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)  # of the suffix at each place of `order`
    for depth in range(0, min(SHALLOW, length), 8):  # multikey: only groups that still agree are sorted on
        size = np.bincount(group, minlength=1)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        key = word[starts[order[open_]] + depth]
        if depth + 8 > length:
            key >>= np.uint64(8 * (depth + 8 - length))
        inner = np.lexsort((key, group[open_]))
        order[open_] = order[open_[inner]]
        key = key[inner]
        fresh = np.zeros(len(order), bool)
        fresh[1:] = group[1:] != group[:-1]
        fresh[open_[1:]] |= (key[1:] != key[:-1]) & (open_[1:] - open_[:-1] == 1)
        group = np.cumsum(fresh)
    if length <= SHALLOW:
        return order, group
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [len(group)]]) if len(group) else np.zeros(1, int)
    part = np.ones(len(order), bool)  # where a new group begins
    for a in np.flatnonzero(np.diff(bounds) > 1):
        a, b = bounds[a], bounds[a + 1]
        items, at = order[a:b].tolist(), starts[order[a:b]].tolist()
        keys = [data[s + SHALLOW:s + length] for s in at]
        if keys.count(keys[0]) == len(keys):
            part[a + 1:b] = False
            continue
        trie = BlindTrie(keys[0], items[0])
        for key, item in zip(keys[1:], items[1:], strict=True):
            trie.add(key, item)
        place = a
        for same in trie.groups():
            order[place:place + len(same)] = same
            part[place + 1:place + len(same)] = False
            place += len(same)
    return order, np.cumsum(part) - 1


def cut_pieces(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, codes: np.ndarray):
    """(gram, hash, text, start, windows) of the pieces that tile the texts, in order; start counts from the text's."""
    value, place, text = least_grams(data, offsets, length, gram, codes)
    if not len(value):
        return value, np.zeros(0, np.uint64), text, place, place
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    runs = np.flatnonzero(first)
    within = np.arange(len(value)) - np.repeat(runs, np.diff(np.append(runs, len(value))))
    at = np.flatnonzero(within % PIECE == 0)
    windows = np.diff(np.append(at, len(value)))
    value, place, text = value[at], place[at], text[at]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(codes)[data] * powers(len(data)), out=total[1:])
    begin = offsets[text] + place
    piece = (total[begin + windows + length - 1] - total[begin]) * inverse_powers(len(data))[begin]
    return value, mix(piece ^ mix(value.astype(np.uint64) + windows.astype(np.uint64))), text, place, windows


def _deal(length: int, gram: int, step: int = STEP_BYTES):
    """Cuts texts into pieces. Rows: (gram, piece hash, doc_key, at) to be met by gram, or of runs that a smaller document
    of the same task has too, (below 0, end, doc_key, at); `at` holds tag, start and number of windows."""
    codes = byte_codes(lower=False)

    def run(batches):
        seen, seen_doc = np.zeros(REMEMBERED, np.uint64), np.full(REMEMBERED, np.iinfo(np.int64).max)
        for batch in batches:
            keys, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = flat(batch.column(2))
            for a, b, low, high, before in slices(offsets, length - 1, step):
                value, piece, text, start, windows = cut_pieces(
                    data[low:high], np.minimum(offsets[a:b + 1] - offsets[a], high - low), length, gram, codes)
                if not len(value):
                    continue
                start = start + before
                doc, tag = keys[a:b][text], tags[a:b][text]
                order = np.lexsort((doc, piece))
                new = np.ones(len(order), bool)
                new[1:] = piece[order[1:]] != piece[order[:-1]]
                settled = np.empty(len(order), bool)
                settled[order] = doc[order] > doc[order[new]][np.cumsum(new) - 1]
                slot = (piece & np.uint64(REMEMBERED - 1)).astype(np.int64)
                settled |= (seen[slot] == piece) & (seen_doc[slot] < doc)
                go = np.flatnonzero(~settled)
                seen[slot[go]], seen_doc[slot[go]] = piece[go], doc[go]
                at = tag << 38 | start << 6 | windows - 1
                yield _rows(value[go], piece[go].view(np.int64), doc[go], at[go])
                gone = np.flatnonzero(settled)
                if len(gone):  # pieces that follow each other make one run
                    cuts = np.flatnonzero((np.diff(gone) > 1) | (np.diff(text[gone]) > 0))
                    first, last = gone[np.concatenate([[0], cuts + 1])], gone[np.append(cuts, len(gone) - 1)]
                    spread = -1 - (mix(doc[first].view(np.uint64)) >> np.uint64(40)).astype(np.int64)
                    yield _rows(spread, start[last] + windows[last] - 1 + length, doc[first], at[first])
    return run


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "piece", "doc_key", "at"])


def _meet(length: int):
    """Over rows sorted by gram, piece and document: spans (gram -1) of pieces that a smaller document has too, and of
    grams whose pieces still differ between documents one row per piece and place of its smallest document. Holds
    places of one gram in one document."""
    def found(gram, doc, at, end):
        return pa.RecordBatch.from_arrays(
            [pa.array(gram), pa.array(doc), pa.array(at >> 38), pa.array(at >> 6 & (1 << 32) - 1), pa.array(end)],
            ["gram", "doc_key", "tag", "s", "e"])

    def run(batches):
        last = (-1, 0, 0)  # gram, piece and its smallest document
        differs, waiting = -1, [np.zeros(0, np.int64)] * 3  # a gram known to differ; (gram, doc, at) of the open gram
        for batch in batches:
            gram, piece, doc, at = (c.to_numpy() for c in batch.columns)
            ready = int(np.searchsorted(gram, 0))
            if ready:
                yield found(np.full(ready, -1), doc[:ready], at[:ready], piece[:ready])
                gram, piece, doc, at = gram[ready:], piece[ready:], doc[ready:], at[ready:]
            if not len(gram):
                continue
            end = (at >> 6 & (1 << 32) - 1) + (at & 63) + length
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (piece[1:] != piece[:-1])
            new[0] = (gram[0], piece[0]) != last[:2]
            least = np.concatenate([[last[2]], doc[new]])[np.cumsum(new)]
            last = (gram[-1], piece[-1], least[-1])
            gone = doc > least
            if gone.any():
                yield found(np.full(int(gone.sum()), -1), doc[gone], at[gone], end[gone])
            value, owner, where = (np.concatenate([w, c[~gone]]) for w, c in zip(waiting, (gram, doc, at), strict=True))
            if not len(value):
                continue
            runs = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            vary = (np.minimum.reduceat(owner, runs) != np.maximum.reduceat(owner, runs)) | (value[runs] == differs)
            differs = value[-1] if vary[-1] else -1
            asked = np.repeat(vary, np.diff(np.append(runs, len(value))))
            waiting = [c[:0] if vary[-1] else c[runs[-1]:] for c in (value, owner, where)]
            if asked.any():
                at = where[asked]
                yield found(value[asked], owner[asked], at, (at >> 6 & (1 << 32) - 1) + (at & 63) + length)
    return run


def _and_end(batches):
    yield from batches
    yield None


def _pieces(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, piece, doc_key, tag, start): the bytes of the places asked for."""
    def cut(batches):
        for batch in batches:
            lists = batch.column(3)
            data, offsets = flat(batch.column(2))
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            gram, s, e = (lists.flatten().field(i).to_numpy() for i in range(3))
            for i in range(0, len(rows), 1 << 16):
                part = slice(i, i + (1 << 16))
                begin = offsets[rows[part]]
                pieces = [data[a:b].tobytes() for a, b in zip((begin + s[part]).tolist(), (begin + e[part]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[part]), pa.array(pieces, pa.binary()), batch.column(0).take(pa.array(rows[part])),
                     batch.column(1).take(pa.array(rows[part])), pa.array(s[part])],
                    ["gram", "piece", "doc_key", "tag", "start"])

    lists = asked.groupBy("doc_key", "tag").agg(F.collect_set(F.struct("gram", "s", "e")).alias("places"))
    rows = docs.where(_Filter(asked, "doc_key").holds("doc_key")).join(lists, ["doc_key", "tag"])
    return rows.select("doc_key", "tag", "text", "places").mapInArrow(
        cut, "gram long, piece binary, doc_key long, tag long, start long")


def _sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(doc_key, tag, s, e): windows that a smaller document has too, by sorting the suffixes of the pieces of each gram."""
    def spans(batches):
        for batch in _whole_grams(batches):
            doc, tag, start = (batch.column(c).to_numpy() for c in ("doc_key", "tag", "start"))
            known: dict[bytes, int] = {}  # equal pieces have the same gram
            which = np.array([known.setdefault(p, len(known)) for p in batch.column("piece").to_pylist()])
            least = np.full(len(known), np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc)
            pieces = list(known)
            gram = np.zeros(len(pieces), np.int64)
            gram[which] = batch.column("gram").to_numpy()
            windows = np.array([len(p) for p in pieces]) - length + 1
            low, high, varied = least.copy(), least.copy(), {}
            _, of, count = np.unique(gram, return_inverse=True, return_counts=True)
            several = np.flatnonzero(count[of] > 1)  # a gram with one piece is settled
            if len(several):
                size = windows[several]
                edge = np.cumsum(size) - size
                owner = np.repeat(np.arange(len(several)), size)
                begin = np.cumsum(size + length - 1) - (size + length - 1)
                starts = np.arange(len(owner)) - edge[owner] + begin[owner]
                order, group = sort_suffixes(b"".join([pieces[i] for i in several]), starts, length)
                smallest = np.minimum.reduceat(least[several][owner[order]], np.flatnonzero(np.diff(group, prepend=-1)))
                found = np.empty(len(starts), np.int64)
                found[order] = smallest[group]
                low[several], high[several] = np.minimum.reduceat(found, edge), np.maximum.reduceat(found, edge)
                varied = {i: found[a:a + n] for i, a, n in zip(several.tolist(), edge.tolist(), size.tolist(), strict=True)}
            whole = np.flatnonzero(high[which] < doc)
            made = [(doc[whole], tag[whole], start[whole], start[whole] + windows[which[whole]] + length - 1)]
            for row in np.flatnonzero((low[which] < doc) & (high[which] >= doc)).tolist():
                gone = np.flatnonzero(varied[int(which[row])] < doc[row])
                cuts = np.flatnonzero(np.diff(gone) > 1)
                first, last = gone[np.concatenate([[0], cuts + 1])], gone[np.append(cuts, len(gone) - 1)]
                made.append((np.full(len(first), doc[row]), np.full(len(first), tag[row]), start[row] + first, start[row] + last + length))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[i] for m in made])) for i in range(4)],
                                             ["doc_key", "tag", "s", "e"])

    return pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(spans, "doc_key long, tag long, s long, e long")


def _whole_grams(batches, limit: int = 8000) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` rows that hold all rows of their grams; rows come sorted by gram."""
    held: list[pa.RecordBatch] = []
    for batch in _and_end(b.slice(i, limit) for b in batches for i in range(0, b.num_rows, limit)):
        if batch is not None:
            held.append(batch)
            if sum(h.num_rows for h in held) < limit:
                continue
        if not held:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        value = table["gram"].to_numpy()
        cut = len(value) if batch is None else int(np.searchsorted(value, value[-1]))
        held = table.slice(cut).to_batches()
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]


def _grouped_spans(pieces: DataFrame, length: int) -> DataFrame:
    """The same for grams of very many different pieces, window by window, so that no task holds a gram."""
    windows = pieces.select("doc_key", "tag", "start", "piece", F.posexplode(F.sequence(F.lit(1), F.length("piece") - (length - 1)))
                            .alias("i", "at"))
    windows = materialize(windows.select("doc_key", "tag", (F.col("start") + F.col("i")).alias("s"),
                                         F.expr(f"substring(piece, at, {length})").alias("window")), "windows")
    least = materialize(windows.groupBy("window").agg(F.min("doc_key").alias("least")), "least-windows")
    return (windows.join(least, "window").where("least < doc_key")
            .select("doc_key", "tag", "s", (F.col("s") + length).alias("e")))


class _Filter:
    """A bitmap of fixed size that holds the values of a column, and by chance some others."""

    def __init__(self, values: DataFrame, column: str, bits: int = 1 << 22):
        self.bits = bits
        places = values.select(self.place(column).alias("place")).distinct().toArrow()
        filled = np.zeros(bits, bool)
        filled[places["place"].to_numpy()] = True
        self.sent = values.sparkSession.sparkContext.broadcast(np.packbits(filled))

    def place(self, column: str) -> Column:
        return F.xxhash64(column).bitwiseAND(self.bits - 1).cast("int")

    def holds(self, column: str) -> Column:
        sent = self.sent

        @F.arrow_udf("boolean")
        def held(place: pa.Array) -> pa.Array:
            return pa.array(np.unpackbits(sent.value).view(bool)[place.to_numpy()])

        return held(self.place(column))


def tagged(docs: DataFrame, *columns: str, key: str = "doc_key", tag: str = "tag") -> DataFrame:
    """The columns with the id as a key and a tag, 0 but for ids that have several texts."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = (docs.select(id_key().alias("doc_key"), text.alias("t")).groupBy("doc_key")
               .agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b"))
    held = _Filter(several, "doc_key").holds(key)
    keyed = docs.select(*columns, id_key().alias(key))
    return keyed.select(*columns, key, F.when(held, F.pmod(text, F.lit(1 << _TAG_BITS))).otherwise(0).cast("long").alias(tag))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_key, tag, spans array<struct<s, e>>): byte ranges covered by a window that a smaller doc_id has too; they
    overlap. `docs` has doc_key, tag and text."""
    kind = "gram long, piece long, doc_key long, at long"
    met = (docs.select("doc_key", "tag", "text").mapInArrow(_deal(length, gram), kind).repartition("gram")
           .sortWithinPartitions("gram", "piece", "doc_key")
           .mapInArrow(_meet(length), "gram long, doc_key long, tag long, s long, e long"))
    met = materialize(met, "met-pieces")
    release(docs)
    asked, spans = met.where("gram >= 0"), met.where("gram < 0").drop("gram")
    large = asked.groupBy("gram").count().where(F.col("count") > group).select("gram")
    large = materialize(large, "large-grams")
    if large.head(1):
        windows = _grouped_spans(_pieces(docs, materialize(asked.join(large, "gram", "left_semi"), "asked-large")), length)
        spans = spans.unionByName(materialize(windows, "large-spans"))
        asked = asked.join(large, "gram", "left_anti")
    sorted_ = materialize(_sorted_spans(_pieces(docs, asked), length), "sorted-spans")
    release(docs)
    spans = spans.unionByName(sorted_).groupBy("doc_key", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return materialize(spans, "repeated-spans")


def drop_repeated_spans(docs: DataFrame, length: int = LENGTH, into: str = "repeats", group: int = GROUP) -> DataFrame:
    """The rows with one more column, struct(n_bytes, n_removed, n_spans, kept binary, kept_sha256).

    Each byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id goes, judged on
    the input; a null text is empty. Strings do not cross documents, so texts shorter than `length` stay whole. A null
    doc_id is one id smaller than all others; rows with the same doc_id count as one document and do not remove each
    other's strings, but each is cut by smaller ids in its own text. The kept bytes may not be UTF-8. Other columns stay (one named as
    `into` is replaced); an empty table gives an empty table.
    """
    own = [c for c in docs.columns if c.lower() != into.lower()]
    key, tag, gone = unused(docs, "_key", into), unused(docs, "_tag", into), unused(docs, "_spans", into)
    spans = repeated_spans(tagged(docs, "text"), length, group=group)
    with_spans = _Filter(spans, "doc_key")  # most documents without spans need no join

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary,kept_sha256:string>")
    def remove(texts: pa.Array, removed: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(texts), 256):
            for text, gone in zip(texts.slice(at, 256).to_pylist(), removed.slice(at, 256).to_pylist(), strict=True):
                rows.append(_remove((text or "").encode(), gone or ()))
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                          ("kept", pa.binary()), ("kept_sha256", pa.string())])
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

    keyed = tagged(docs, *own, key=key, tag=tag)
    hit = with_spans.holds(key)
    spans = spans.toDF(key, tag, gone)
    none = F.lit(None).cast("array<struct<s:long,e:long>>")
    touched = keyed.where(hit).join(spans, [key, tag], "left").select(*own, remove(F.col("text"), F.col(gone)).alias(into))
    clean = keyed.where(~hit).select(*own, remove(F.col("text"), none).alias(into))
    return touched.unionByName(clean)


def _remove(text: bytes, gone) -> tuple:
    merged: list[list[int]] = []
    for span in sorted((g["s"], g["e"]) for g in gone):
        if merged and span[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], min(span[1], len(text)))
        elif span[0] < len(text):
            merged.append([span[0], min(span[1], len(text))])
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    left = b"".join(kept)
    return len(text), len(text) - len(left), len(merged), left, hashlib.sha256(left).hexdigest()
