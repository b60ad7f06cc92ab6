"""Quality rules over whole texts, the repetition ones read off a suffix array of words.

A text's words are numbered and their suffixes sorted by prefix doubling, many texts in one numpy step, each within
its own text. The longest common prefix of neighbouring suffixes gives the LCP intervals: each interval whose
occurrences are preceded by different words is a maximal repeated substring. Their spans are united; a text is kept if they
cover a small enough share of its words and none is too long. The same table answers the rule of repeated windows.

Every text is judged by itself, so no row moves between tasks. Memory is some 150 bytes for each byte of a step: steps take
CHUNK_BYTES of text, a longer text is a step of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, Words, byte_codes, chunks, flat

#: words of the windows that the base rule counts
WINDOW = 8
#: words from which on a repeated substring counts, the most per cent of words that such may cover, and its most words
LEAST, MOST_COVERED, LONGEST = 4, 30, 32
#: fewer words fail, as does a larger share of words in repeated windows, in per cent
FEWEST_WORDS, MOST_REPEATED = 20, 30
_CHUNK_BYTES = 1 << 19
_CODES = byte_codes(lower=False)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANKS = " \t\n\x0b\x0c\r"
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "n_covered", "longest_repeat"]
RULES = T.StructType([*[T.StructField(f, T.LongType()) for f in _FIELDS],
                      *[T.StructField(f, T.BooleanType()) for f in ("base_failed", "kept")]])


def suffix_array(ids: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of words by text, then by the words from there to the text's end. `ends`: end of the text of each word."""
    n = len(ids)
    key = text_of.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    slot = np.arange(n)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(new, slot, 0)) if n else slot
    rank = np.empty(n, np.int64)
    rank[order] = group
    open_slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 1
    while len(open_slots):
        at = order[open_slots]
        ahead = at + step
        second = np.where(ahead < ends[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[open_slots] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, open_slots, 0))
        open_slots = open_slots[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def common_prefixes(ids: np.ndarray, ends: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order, 0 where they are fewer than `least`.

    Candidates are found all at once; their lengths follow in the order of the text, where one is at most one word
    shorter than the one before, so that the words compared are linear in all.
    """
    n = len(ids)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    a, b = order[:-1], order[1:]
    alike = np.flatnonzero(ends[a] == ends[b])
    for k in range(least):
        x, y = a[alike] + k, b[alike] + k
        inside = (x < ends[a[alike]]) & (y < ends[b[alike]])
        alike, x, y = alike[inside], x[inside], y[inside]
        alike = alike[ids[x] == ids[y]]
    if not len(alike):
        return shared
    alike = alike[np.argsort(b[alike])]
    words, last, length = ids.tolist(), -1, 0
    found = []
    for x, y, end in zip(a[alike].tolist(), b[alike].tolist(), ends[b[alike]].tolist(), strict=True):
        length = max(least, length - (y - last)) if last >= 0 else least
        last = y
        room = end - max(x, y)
        length = min(length, room)
        while length < room and words[x + length] == words[y + length]:
            length += 1
        found.append(length)
    shared[alike + 1] = found
    return shared


def maximal_repeats(ids: np.ndarray, order: np.ndarray, shared: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """(place of one occurrence, words) of each LCP interval whose occurrences follow different words or a text's start."""
    inner = np.flatnonzero((shared > 0) | np.append(shared[1:] > 0, False))
    places = order[inner]
    before = np.where(starts[places] == places, -1 - places, ids[places - 1])
    found: list[tuple[int, int]] = []
    stack: list[list] = []  # [words, place, the word before all occurrences, or None if they differ]
    place = left = None
    for length, next_place, next_left in zip([*shared[inner].tolist(), 0], [*places.tolist(), None], [*before.tolist(), None], strict=True):
        while stack and stack[-1][0] > length:
            words, place, one = stack.pop()
            left = one if one == left else None
            if left is None:
                found.append((place, words))
        if length and stack and stack[-1][0] == length:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == left else None
        elif length:
            stack.append([length, place, left])
        place, left = next_place, next_left
    return found


def _covered(places: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a span of so many words from a place on."""
    change = np.bincount(places, minlength=n + 1)[:n + 1] - np.bincount(places + lengths, minlength=n + 1)[:n + 1]
    return np.cumsum(change)[:n] > 0


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _judge(data: np.ndarray, offsets: np.ndarray, least: int, most_covered: int, longest: int) -> dict[str, np.ndarray]:
    """The fields of RULES but n_dup_lines for some texts."""
    words = Words(data, offsets, BLANK, _CODES)
    n, first = len(words.hash), words.first
    n_words = np.diff(first)
    text_of = words.text_of
    starts, ends = first[:-1][text_of], first[1:][text_of]
    _, ids = np.unique(words.hash, return_inverse=True)
    order = suffix_array(ids, text_of, ends)
    shared = common_prefixes(ids, ends, order, least)
    longer = np.maximum(shared, np.append(shared[1:], 0))[:n]
    held = np.flatnonzero(longer)
    places, lengths = order[held], longer[held]
    wide = lengths >= WINDOW
    n_repeat = _sums(_covered(places[wide], lengths[wide], n), first)
    n_covered = _sums(_covered(places, lengths, n), first)
    most = np.zeros(len(n_words), np.int64)
    np.maximum.at(most, text_of[places], lengths)
    repeats = maximal_repeats(ids, order, shared, starts)
    n_repeats = np.bincount(text_of[[p for p, _ in repeats]], minlength=len(n_words)) if repeats else np.zeros(len(n_words), np.int64)
    failed = (n_words < FEWEST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    kept = ~failed & (100 * n_covered <= most_covered * n_words) & (most <= longest)
    inside = ~BLANK[data] & ((data & 0xC0) != 0x80)
    return {"n_words": n_words, "word_chars": _sums(inside, offsets), "n_symbols": _sums(_SYMBOL[data], offsets),
            "n_repeat_words": n_repeat, "n_repeats": n_repeats, "n_covered": n_covered, "longest_repeat": most,
            "base_failed": failed, "kept": kept}


def rules(text: str | Column = "text", least: int = LEAST, most_covered: int = MOST_COVERED, longest: int = LONGEST) -> Column:
    """A struct of RULES for a text; words are parted by blanks and compared with their case.

    n_repeat_words: words in windows of WINDOW words that the text holds twice or more. n_repeats: maximal repeated
    substrings of `least` words or more; n_covered: words in one of them; longest_repeat: words of the longest, 0 without
    any. base_failed: fewer than FEWEST_WORDS words, or more than MOST_REPEATED per cent in repeated windows. kept: not
    so, at most `most_covered` per cent covered and no repeat of more than `longest` words. A null or empty text
    has no words and fails. Only the text is read: copies, ids and other columns don't matter. `least` is at most WINDOW.
    Words are told apart by 64-bit hashes within a text.
    """
    if not 1 <= least <= WINDOW:
        raise ValueError(f"least is between 1 and {WINDOW}")

    @F.arrow_udf(RULES)
    def judge(texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        made = [_judge(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], least, most_covered, longest)
                for a, b in chunks(offsets, _CHUNK_BYTES)]
        fields = {f: np.concatenate([m[f] for m in made]) for f in RULES.names if f != "n_dup_lines"} if made else {}
        lines = [_dup_lines(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).fill_null("").to_pylist()]
        arrays = [pa.array(lines if f == "n_dup_lines" else fields.get(f, []),
                           pa.bool_() if f in ("base_failed", "kept") else pa.int64()) for f in RULES.names]
        return pa.StructArray.from_arrays(arrays, RULES.names)

    return judge(text)
