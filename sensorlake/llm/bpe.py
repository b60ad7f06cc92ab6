"""BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled, one after the other, into a deterministic automaton over tokens. It starts as
one state that reads any base token. A merge of u and v into w is one gadget: the state reached by u is copied
without its v-arc and all u-arcs go to the copy; wherever u and then v could be read, a w-arc leads to where v led. In
the end the automaton accepts just the token sequences that merging produces. A copy shares its arcs with the state it
was made from, so the compiled form is a few integers per token, and an arc is looked up through these tables once and
then kept. Encoding walks a word from left to right: after each prefix one token path of the automaton is alive, and
the next token is the one whose arc leaves the state in which the prefix before it ends. Decoding emits the label of
each arc.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: distinct words whose tokens a task keeps at a time
CACHED_WORDS = 150_000
#: longer words are encoded but not kept
CACHED_LENGTH = 64
#: looked-up arcs that are kept
KEPT_ARCS = 250_000
#: prefixes of words whose path is kept
WALKED_PREFIXES = 100_000


class Automaton:
    """Token automaton of (vocab, merges) with a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.longest = max((len(t) - (len(suffix) if t.endswith(suffix) else 0) if suffix else len(t) for t in vocab), default=1)
        n = max(vocab.values(), default=-1) + 1
        self.left, self.time, self.useful = [-1] * n, [-1] * n, [True] * n
        self.forked, self.owner = [-1], [-1]  # of each state: when and for which token it was copied; 0 reads everything
        self.origin = [0] * n  # state from which the copies of a token's state descend
        self.copies: list[list[int]] = [[] for _ in range(n)]
        self.fork_times: list[list[int]] = [[] for _ in range(n)]
        self.merged: dict[int, int] = {}  # u * n + v -> when the v-arc behind u went
        self.state = [0] * n  # where the arcs of a token lead
        self.arcs: dict[int, bool] = {}
        self.tokens = n
        for time, (a, b) in enumerate(merges):
            self.merge(time, a, b)
        live = {t: i for t, i in vocab.items() if self.reads(0, i)}  # some merges may be reached by no text
        self.inner = {t: i for t, i in live.items() if not suffix or not t.endswith(suffix)}
        self.final = {t.removesuffix(suffix): i for t, i in live.items() if t.endswith(suffix)} if suffix else self.inner
        self.arcs.clear()
        self.walked: dict[str, tuple[int, int]] = {}  # prefix of a word -> its last token and where that starts

    def merge(self, time: int, a: str, b: str) -> None:
        u, v, w = self.vocab[a], self.vocab[b], self.vocab[a + b]
        if self.time[w] < 0 and w not in (u, v):
            self.left[w], self.time[w] = u, time
            self.useful[w] = self.reads(self.state[u], v)
            self.state[w] = self.origin[w] = self.state[v]
        self.forked.append(time)
        self.owner.append(u)
        self.state[u] = len(self.forked) - 1
        self.copies[u].append(self.state[u])
        self.fork_times[u].append(time)
        self.merged.setdefault(u * self.tokens + v, time)

    def reads(self, state: int, token: int) -> bool:
        """Whether the state has an arc of this token."""
        known = self.arcs.get(state * self.tokens + token)
        if known is None:
            known = self.find(state, token)
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            self.arcs[state * self.tokens + token] = known
        return known

    def find(self, state: int, token: int) -> bool:
        while state or self.time[token] >= 0:
            made = self.time[token]
            if made >= self.forked[state]:  # the arc came after the copy, beside the arc of the token's left part
                if not self.useful[token]:
                    return False
                token = self.left[token]
                continue
            u = self.owner[state]
            if self.merged.get(u * self.tokens + token, made) > made and \
                    self.merged[u * self.tokens + token] <= self.forked[state]:
                return False
            i = bisect_right(self.fork_times[u], made) - 1  # the copy of that time has the same answer
            state = self.copies[u][i] if i >= 0 else self.origin[u]
        return True

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given as the vocabulary's characters."""
        if not word:
            return []
        walked = self.walked
        if len(walked) >= WALKED_PREFIXES:
            walked.clear()
        for end in range(1, len(word)):
            prefix = word[:end]
            if prefix not in walked:
                walked[prefix] = self.step(prefix, self.inner)
        token, at = self.step(word, self.final)
        found = [token]
        while at:
            token, at = walked[word[:at]]
            found.append(token)
        return found[::-1]

    def step(self, prefix: str, tokens: dict[str, int]) -> tuple[int, int]:
        """(token, where it starts): the one token that ends the path of the prefix."""
        walked, arcs, state, n = self.walked, self.arcs, self.state, self.tokens
        for start in range(len(prefix) - 1, max(-1, len(prefix) - self.longest - 1), -1):
            token = tokens.get(prefix[start:])
            if token is not None:
                if not start:
                    return token, 0
                before = state[walked[prefix[:start]][0]]
                arc = arcs.get(before * n + token)
                if arc or arc is None and self.reads(before, token):
                    return token, start
        raise ValueError(f"no token path spells {prefix!r}")

    def encode_long(self, word: str) -> list[int]:
        """The same for a word of any length, without keeping its prefixes."""
        state, n = self.state, len(word)
        last, begin = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int64)
        for end in range(1, n + 1):
            tokens = self.final if end == n else self.inner
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                token = tokens.get(word[start:end])
                if token is not None and (not start or self.reads(state[last[start]], token)):
                    last[end], begin[end] = token, start
                    break
            else:
                raise ValueError(f"no token path spells {word[:50]!r}")
        found, at = [], n
        while at:
            found.append(int(last[at]))
            at = int(begin[at])
        return found[::-1]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


#: texts of these characters need no Unicode normalisation beyond lower case and blanks
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xff]")
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


class Encoder:
    """Encodes and decodes texts as a tokenizer file of this shape says: normalise, split, byte letters, BPE."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        model = parts["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.spec, self.library = spec, None
        self.plain, self.spelled = _Known(self, True), _Known(self, False)

    def encode(self, text: str) -> np.ndarray:
        found = []
        for piece in self.specials.split(text) if "<|" in text else (text,):
            if piece in self.special:
                found.append(np.int32(self.special[piece]).tobytes())
            elif not _PLAIN.search(piece):
                known = self.plain
                found += [known[w] for w in _SPLIT.findall(piece.lower())]
            else:  # the library's own normaliser and splitter take texts with rarer characters
                if self.library is None:
                    from tokenizers import Tokenizer
                    self.library = Tokenizer.from_str(self.spec)
                piece = self.library.normalizer.normalize_str(piece)
                known = self.spelled
                found += [known[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
        return np.frombuffer(b"".join(found), np.int32)

    def forget(self) -> None:
        """What a worker that waits for its next task need not hold; the words, at most CACHED_WORDS short ones, stay."""
        for kept in (self.spelled, self.automaton.walked, self.automaton.arcs):
            kept.clear()

    def decode(self, ids) -> str:
        """Labels joined by a space, as without a decoder in the file."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


class _Known(dict):
    """Word -> its ids as bytes; what is missing is encoded, and kept if short."""

    def __init__(self, encoder: Encoder, plain: bool):
        self.automaton, self.letters = encoder.automaton, encoder.letters if plain else None

    def __missing__(self, word: str) -> bytes:
        letters = self.letters
        spelled = "".join([letters[b] for b in word.encode()]) if letters else word
        if len(word) > CACHED_LENGTH:
            return np.array(self.automaton.encode_long(spelled), np.int32).tobytes()
        ids = array("i", self.automaton.encode(spelled)).tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One automaton per worker process and tokenizer file."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: texts whose tokens a task holds at a time
SLICE = 128


def bpe_tokens(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "bpe", keep: list[str] | None = None) -> DataFrame:
    """The frame with one more column: struct(ids array<int>, decoded string) of the text, by the tokenizer file `tokenizer`.

    A null text is empty: no ids, an empty decoded text. Texts are read whole, however long; rows repeat as they are;
    all other columns stay, or those named by `keep` (a column named as `into` is replaced). An empty table gives an
    empty table. The file is read by the driver and broadcast: its size does not depend on the data.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))
    kept = [c for c in docs.columns if c != into and (keep is None or c in keep)]
    fields = [f for c in kept for f in docs.select(F.col(f"`{c}`")).schema.fields]
    made = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def tokens(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = [part.column(i) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, _tokens(_encoder(spec.value), part.column(0))], [*kept, into])
        _encoder(spec.value).forget()

    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(tokens, T.StructType([*fields, T.StructField(into, made)]))


def _tokens(encoder: Encoder, texts: pa.Array) -> pa.Array:
    rows = [encoder.encode(t or "") for t in texts.to_pylist()]
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    decoded = pa.array([encoder.decode(r.tolist()) for r in rows], pa.string())
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
    return pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])


def bpe_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 for each row of (doc_id, text)."""
    made = bpe_tokens(docs.select("doc_id", "text"), tokenizer, into="bpe", keep=["doc_id"])
    return made.select(
        "doc_id", F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("bpe.ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))
