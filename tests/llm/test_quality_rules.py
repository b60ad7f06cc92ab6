"""Repetition rules against brute force: suffix order, maximal repeats, and whole structs on awkward texts."""

import random
import re

import numpy as np
import pytest

from sensorlake.llm import quality_rules


def table_of(texts):
    """ids, text_of, starts and ends of lists of words."""
    names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    ids = np.array([names[w] for t in texts for w in t], np.int64)
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return ids, text_of, first[:-1][text_of], first[1:][text_of]


def repeats(words, least):
    """All maximal repeated substrings, as tuples of words."""
    found = {}
    for n in range(1, len(words)):
        for i in range(len(words) - n + 1):
            found.setdefault(tuple(words[i:i + n]), []).append(i)
    made = set()
    for said, places in found.items():
        if len(said) >= least and len(places) > 1:
            n = len(said)
            before = {words[i - 1] if i else ("start", i) for i in places}
            after = {words[i + n] if i + n < len(words) else ("end", i) for i in places}
            if len(before) > 1 and len(after) > 1:
                made.add(said)
    return made


def test_suffixes_and_repeats():
    rng = random.Random(3)
    for _ in range(150):
        texts = [[rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        ids, text_of, starts, ends = table_of(texts)
        order = quality_rules.suffix_array(ids, text_of, ends)
        suffix = [(int(text_of[i]), ids[i:ends[i]].tolist()) for i in range(len(ids))]
        assert order.tolist() == sorted(range(len(ids)), key=lambda i: suffix[i])
        for least in (1, 2, 4):
            shared = quality_rules.common_prefixes(ids, ends, order, least)
            for r in range(1, len(ids)):
                (t, a), (u, b) = suffix[order[r - 1]], suffix[order[r]]
                n = 0
                while t == u and n < min(len(a), len(b)) and a[n] == b[n]:
                    n += 1
                assert shared[r] == (n if n >= least else 0)
            names = sorted({w for t in texts for w in t})
            found = quality_rules.maximal_repeats(ids, order, shared, starts)
            got = sorted((int(text_of[p]), tuple(names[i] for i in ids[p:p + n])) for p, n in found)
            assert got == sorted((t, said) for t, words in enumerate(texts) for said in repeats(words, least))


def brute(text, least=4, most=30, longest=32):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def covered(k):
        said, hit = {}, set()
        for i in range(len(words) - k + 1):
            said.setdefault(tuple(words[i:i + k]), []).append(i)
        for places in said.values():
            for i in places if len(places) > 1 else []:
                hit.update(range(i, i + k))
        return len(hit)

    longest_found = 0
    for k in range(least, len(words)):
        if not covered(k):
            break
        longest_found = k
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * covered(8) > 30 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": covered(8), "n_covered": covered(least),
            "longest_repeat": longest_found, "base_failed": failed,
            "kept": not failed and 100 * covered(least) <= most * len(words) and longest_found <= longest}


def test_texts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a " * 300, "#*$%&|<>\n#\n#\n \n \n", "Été ß 漢字 😀 x y " * 5]
    for _ in range(80):
        lines = [" ".join(rng.choice(["x", "y", "zé", "<a>", "ab", "q%"]) + str(rng.randint(0, rng.choice([0, 3, 60])))
                          for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))]
        texts.append("\n".join(rng.choice(lines) if rng.random() < 0.3 else x for x in lines))
    unlike = [f"w{i}" for i in range(200)]
    texts += [" ".join(unlike[:90] + unlike[i:i + 33] + [f"v{i}"] + unlike[100:]) for i in range(10, 14)]
    texts += [texts[9], texts[9]]
    rows = [(i if i % 5 else None, t, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string")
    made = docs.select("text", quality_rules.rules().alias("made")).collect()
    assert len(made) == len(texts)
    for r in made:
        want = brute(r.text)
        assert {k: r.made[k] for k in want} == want, r.text
    assert sum(r.made.kept for r in made) > 5


def test_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(150_000)]
    texts = [" ".join(words), " ".join(words[:50_000] * 3), "same " * 200_000]
    made = [r.made for r in spark.createDataFrame([(t,) for t in texts], "text string").select(quality_rules.rules().alias("made")).collect()]
    assert [(m.n_words, m.kept) for m in made] == [(150_000, True), (150_000, False), (200_000, False)]
    assert [m.longest_repeat for m in made[1:]] == [100_000, 199_999] and made[2].n_repeats == 199_996


def test_bounds_and_empty_table(spark):
    assert spark.createDataFrame([], "text string").select(quality_rules.rules()).count() == 0
    with pytest.raises(ValueError, match="least"):
        quality_rules.rules(least=9)
