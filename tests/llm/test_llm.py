"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns, by brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorlake.llm import bpe, chat, decontamination, jaccard_join, language_id, line_dedup, pii, quality, suffix_dedup, topk

WORDS = "the of and data spark line café straße one two three four five six seven eight nine ten eleven twelve".split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(6)]
    shared = "this line stands in many of the documents"
    texts = [None, "", " \n\t ", "one two", "ONE  two", "a" * 400, "a" * 200]
    for i in range(30):
        words = base[i % 6].split()
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
        texts.append(" ".join(words) + ("\n" + shared.upper() + " \nend " + str(i) if i % 2 else ""))
    texts += [texts[8], texts[9], prose(rng, 30000)]
    made = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return [*made, (None, base[0], "x", "y"), made[8]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _key string, n string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def low(i):
    return -2 ** 63 if i is None else i


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(60):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(60, 300))) * rng.randint(1, 3)
        starts = np.array(sorted(rng.sample(range(len(data) - 49), min(80, len(data) - 49))))
        order, group = suffix_dedup.sort_suffixes(data, starts, 50)
        keys = [data[s:s + 50] for s in starts[order]]
        assert keys == sorted(keys)
        assert all((group[i] == group[i + 1]) == (keys[i] == keys[i + 1]) for i in range(len(keys) - 1))


@pytest.mark.parametrize("group", [20_000, 1])
def test_suffix_dedup(docs, rows, none, group):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(low(i), first.get(b[p:p + 50], low(i)))
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < low(i):
                gone[p:p + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        want.append((low(i), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept)))
    got = suffix_dedup.drop_repeated_spans(docs, group=group).select("doc_id", "repeats.*").drop("kept").collect()
    assert sorted((low(r[0]), *r[1:]) for r in got) == sorted(want)
    assert suffix_dedup.drop_repeated_spans(none).count() == 0


def test_sliced_texts_give_all_windows():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (700, 20, 49, 50, 0, 260, 256, 3000)]
    batch = suffix_dedup.pa.RecordBatch.from_arrays(
        [suffix_dedup.pa.array(c) for c in (list(range(8)), [0] * 8, texts)], ["doc_key", "tag", "text"])
    seen = []
    for made in suffix_dedup._deal(50, 24, step=256)([batch]):
        for r in made.to_pylist():
            start = r["at"] >> 6
            end = start + (r["at"] & 63) + 1 if r["gram"] >= 0 else r["piece"] - 49
            seen += [(r["doc_key"], s) for s in range(start, end)]
    assert sorted(seen) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 49)]


def test_texts_of_one_id_are_cut_on_their_own(spark):
    shared, other = "x1 " * 30, "y2 " * 40
    docs = spark.createDataFrame([(1, shared), (2, shared + other), (2, other + shared), (2, other + shared), (3, other)],
                                 "doc_id long, text string")
    got = suffix_dedup.drop_repeated_spans(docs).select("doc_id", "text", F.expr("cast(repeats.kept as string)")).collect()
    assert all(kept in {1: [shared], 2: [other, other[:-1], other[1:]], 3: ["", "y2 "]}[i] for i, _, kept in got)
    assert len(got) == 5


@pytest.mark.parametrize("names", ["_key _tag _spans", "_KEY _Drops doc_key", "_key _matches matches"])
def test_extra_columns_with_names_of_temporary_ones(spark, names):
    line = "a line that stands in every one of the documents, thirteen words and more of it"
    a, b, c = names.split()
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", i, i, i) for i in range(4)],
                                 f"doc_id long, text string, {a} long, {b} long, {c} long")
    items = spark.createDataFrame([("q", line)], "item_id string, text string")
    for made in (suffix_dedup.drop_repeated_spans(docs), line_dedup.drop_repeated_lines(docs),
                 decontamination.contamination(docs, items)):
        got = made.collect()
        assert sorted(r[a] for r in got) == [0, 1, 2, 3] and all(r[a] == r[b] == r[c] == r.doc_id for r in got)
    assert {r.found.n_items for r in got} == {1}


def test_prefixes():
    for percent in (50, 75, 90):
        for n in range(1, 200):
            listed, led = (int(x[0]) for x in jaccard_join.prefixes(np.array([n]), percent))
            assert listed == n - min(t for t in range(n + 1) if 100 * t >= percent * n) + 1
            assert led == n - min(t for t in range(n + 1) if t * (100 + percent) >= 2 * percent * n) + 1
    assert [int(x[0]) for x in jaccard_join.prefixes(np.array([0]), 75)] == [0, 0]


def test_lists_in_blocks(spark, monkeypatch):
    """No pivots: every link comes from leaders and members of lists dealt into blocks of few rows."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + [f"w{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(0, 14))]) for _ in range(60)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert 1 < len(set(label)) < len(texts)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 7)
    made = jaccard_join.similar_components(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), turns=0)
    assert sorted(tuple(r) for r in made.collect()) == [(i, len(sets[i]), label[i]) for i in range(len(texts))]


def test_edited_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    """All copies of one text but a few words link with each other: a pair for each joins them, not one for every two."""
    rng, words = random.Random(5), [f"p{i}" for i in range(150)]
    texts = [" ".join(words[:i] + ["x%d" % rng.randint(0, 10 ** 6)] + words[i + 1:]) for i in rng.choices(range(150), k=120)]
    tried, verify = [], jaccard_join.verify

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return verify(pairs, *rest)
    monkeypatch.setattr(jaccard_join, "verify", counted)
    made = jaccard_join.similar_components(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), turns=0)
    assert {r.component for r in made.collect()} == {0}
    assert sum(tried) <= 3 * len(texts)


def test_jaccard_join(docs, rows, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").encode().lower().decode())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    want = sorted((low(rows[i][0]), len(sets[i]), min(low(rows[j][0]) for j in range(len(rows)) if label[j] == label[i]))
                  for i in range(len(rows)))
    assert sorted(tuple(r) for r in jaccard_join.similar_components(docs).collect()) == want
    assert jaccard_join.near_duplicates(none).count() == 0


def test_line_dedup(docs, rows, none):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").encode().lower().decode()
    where = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                where.setdefault(key(x), set()).add(low(i))
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(where.get(key(x), ())) < 3 or max(where[key(x)]) == low(i)]
        want.append((low(i), "\n".join(left), len(lines), len(lines) - len(left)))
    got = line_dedup.drop_repeated_lines(docs).select("doc_id", "lines.*", "_key").collect()
    assert sorted((low(r[0]), *r[1:4]) for r in got) == sorted(want)
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_language(spark, docs, none):
    rng = random.Random(2)
    made = [(i, " ".join(rng.choice(v) for _ in range(30)), lang) for i in range(120)
            for lang, v in [(("en", ["the", "of", "thing", "with"]), ("de", ["der", "und", "nicht", "schön"]))[i % 2]]]
    table = spark.createDataFrame([*made, (900, None, "en"), (901, "12 34", None)], "doc_id long, text string, lang string")
    model = language_id.train(table, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: (r.language, r.lang) for r in language_id.identify(table, model).collect()}
    assert got[900][0].lang_pred == got[901][0].lang_pred == "und"
    assert all(p.lang_pred == lang and 0 <= p.score <= 1 for i, (p, lang) in got.items() if i < 900)
    assert language_id.train(none, F.lit(True)) is None
    assert language_id.identify(none, None).count() == 0
    assert {r.language.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_bpe_equals_the_library(spark, none):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), bpe.Encoder(bpe._read(path)), random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzaaeettss''!!..  \n\t12ßéΣσİ́ \u0085\u001c<|>_-中文😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["ab" * 3000, "hahaha" * 20, "x<|endoftext|>y", "", "!" * 200, "é" * 99]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    table = spark.createDataFrame([(1, None, "z"), (2, "a cat", "z"), (2, "a cat", "z")], "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in bpe.bpe_digests(table, path).collect())
    assert got[0] == (1, 0, sha(""), sha("")) and got[1] == got[2] and got[1][1] == 2
    assert bpe.bpe_digests(none, path).count() == 0


def test_decontamination(spark, docs, rows, none):
    words = lambda t: decontamination._words(t)
    items = [(1, rows[10][1]), (2, "eight9 ten10"), (3, None), (4, rows[10][1]), (None, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(13, len(v))
            windows = {tuple(v[a:a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit.update(range(a, a + n))
                    found.add("null" if item is None else str(item))
        want.append((low(i), len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontamination.contamination(docs, bench).select("doc_id", "found.*").collect()
    assert sorted((low(r[0]), *r[1:]) for r in got) == sorted(want)
    assert sum(r.n_hit for r in got) > 0
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs, none.select(F.col("doc_id").alias("item_id"), "text")).where("found.n_hit > 0").count() == 0


def test_personal_data(spark, none):
    rng, plain = random.Random(3), {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                                    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                                    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        found = []
        for kind, pattern in plain.items():
            for m in re.finditer(pattern, t):
                d = re.sub("[^0-9]", "", m.group())
                if {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                        "card": lambda d=d: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[kind]():
                    found.append((kind, m.start(), m.end()))
        return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    for _ in range(4000):
        t = "".join(rng.choice("a.@-+ ()0123456789\n4é_%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute(t)
    seeds = [(i, f"please call me at +1 555 010 {i:04d} today", "z") for i in range(10)]
    more = [(50, "please call me at 555-010-7777 today", "z"), (51, "part number 555-010-7777 is out", "z"), (52, None, "z")]
    table = spark.createDataFrame([*seeds, *more, more[0]], "doc_id long, text string, pattern string")
    got = [(r.doc_id, len(r.pii.base), len(r.pii.added)) for r in pii.personal_data(table).collect()]
    assert sorted(got) == [*((i, 1, 0) for i in range(10)), (50, 0, 1), (50, 0, 1), (51, 0, 0), (52, 0, 0)]
    assert pii.personal_data(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (None, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    vectors = {low(i): np.floor(1024 * np.array(v)).astype(int) for i, v in rows if v and None not in v and v == v and v[0] == v[0]}
    want = []
    for q in (x for x in vectors if x >= 0 and x % 100 == 0):
        best = sorted((-int(v @ vectors[q]), i) for i, v in vectors.items() if i != q)[:10]
        want += [(q, n, None if i < 0 else i, -s) for n, (s, i) in enumerate(best, 1)]
    got = topk.exact_top_k(table.select("vec_id", topk.scaled().alias("vector")), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert topk.exact_top_k(table.where("false").select("vec_id", topk.scaled().alias("vector")), F.lit(True)).count() == 0


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", None), (1, 1, "tool: </turn>x", "a\\"),
            (1, 2, "assistant", "é\\\\</turn>"), (1, 2, "assistant", "é\\\\</turn>"), (None, None, None, "### "), (2, 0, "user", "x" * 100_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    for conv in (-7, 1, 2, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert chat.read_back(chat.format_conversations(table.where("false"))).count() == 0
    assert chat.fold(chat.parse("{% if 'a' == 'b' %}x{% else %}y{{ 'z' | upper }}{% endif %}")) == ("block", ("emit", ("const", "yZ")))
    for bad in ("{{ a.b() }}", "{% for x %}", "{{ x | exec }}", "{% if 'a' %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_quality_learns_from_whole_texts_one_row_an_id(spark, monkeypatch):
    seen = {}

    def fit(x, first, labels):
        seen.update(bags=np.diff(first).tolist(), labels=labels.tolist(), x=x)
        return None
    monkeypatch.setattr(quality, "fit", fit)
    long = "plain words and more of them. " * 1700
    rows = [(1, long), (2, "short"), (2, "other")] + [(2, "other")] * 300 + [(3, None), (4, "x" * 90_000), (None, "no id"), (5, "unlabelled")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    quality.train(table, labels, F.lit(True))
    assert seen["bags"] == [-(-len(long) // quality.PASSAGE), 1, 1, 88] and seen["labels"] == [1, 0, 1, 0]
    data, offsets = np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)])
    assert np.array_equal(seen["x"][:seen["bags"][0]], quality.passages(data, offsets)[0])
    quality.train(table, labels, F.lit(True), most=60_000)  # the text above the bound is passed over, the others stay
    assert seen["bags"] == [-(-len(long) // quality.PASSAGE), 1, 1]


def test_quality_features_do_not_depend_on_neighbours():
    texts = ["", "ab", "héllo wörld " * 200, "x", "tail", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    together, first = quality.passages(data, offsets)
    for i, t in enumerate(texts):
        alone, _ = quality.passages(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert np.array_equal(together[first[i]:first[i + 1]], alone)


def test_quality_gradient():
    """One step of training moves every weight against the numeric gradient of the loss."""
    rng = np.random.default_rng(3)
    x, first, labels = rng.normal(size=(7, quality.FEATURES)).astype(np.float32), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss(m):
        p = quality._forward(m, x.astype(np.float64), first)["p"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean() + 0.5e-4 * sum((m[k] ** 2).sum() for k in "EVUc")

    before = {k: v.astype(np.float64) for k, v in quality.fit(x, first, labels, epochs=0).items()}
    after = quality.fit(x, first, labels, epochs=1, rate=1e-3)
    for k in ("E", "e", "V", "U", "w", "c"):
        for at in rng.choice(before[k].size, 6):
            shift = np.zeros(before[k].size)
            shift[at] = 1e-5
            shift = shift.reshape(before[k].shape)
            slope = (loss(before | {k: before[k] + shift}) - loss(before | {k: before[k] - shift})) / 2e-5
            moved = float(after[k].ravel()[at] - before[k].ravel()[at])
            if abs(slope) > 1e-6:  # the first step of Adam has the size of the rate, against the gradient
                assert np.sign(moved) == -np.sign(slope) and abs(abs(moved) - 1e-3) < 1e-4, (k, at, slope, moved)


def test_quality(spark, docs, none):
    rng = random.Random(6)
    made = [(i, prose(rng, 40) if i % 3 else "buy!! " * 60) for i in range(240)]
    table = spark.createDataFrame([*made, (500, None), (501, "")], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.quality_score for r in quality.score_quality(table, model).collect()}
    right = [got[i].predicted == int(i % 3 > 0) for i in range(0, 240, 5)]
    assert sum(right) >= 0.95 * len(right) and got[500] == got[501]
    assert quality.train(table, labels.where("false"), F.lit(True)) is None
    assert quality.score_quality(none, None).count() == 0
    assert all(r.quality_score.score == 0.5 for r in quality.score_quality(docs, None).collect())


def test_languages_of_copies_are_learned(spark):
    rng = random.Random(9)
    letters = ["abcd", "efgh", "ijkl", "mnop"]
    copies = [(None, " ".join(rng.choice(letters[i]) for _ in range(60)), f"l{i}") for i in range(2)]
    unlike = [(j, " ".join(rng.choice(letters[i]) for _ in range(30)), f"l{i}") for i in (2, 3) for j in range(40)]
    rows = [r for r in copies for _ in range(3000)] + unlike
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame, F.lit(True), sample=40)
    assert list(model["classes"]) == ["l0", "l1", "l2", "l3"]
    one = language_id.train(frame.where("lang = 'l0'"), F.lit(True))
    assert list(one["classes"]) == ["l0"]
    made = language_id.identify(spark.createDataFrame([copies[0], copies[1], unlike[0], unlike[50]], frame.schema), model)
    assert [r.language.lang_pred for r in made.collect()] == ["l0", "l1", "l2", "l3"]


def test_spelled_emails_in_long_texts(spark):
    import time

    began = time.time()
    assert list(pii._spelled_emails("a" * 1_000_000 + " (at) ")) == [] and time.time() - began < 1
    text = "mail joe.x (at) site [dot] org or ann at home dot net, jim@x (at)  and bo[at]b.c.d at z dot y"
    assert [text[a:b] for a, b in pii._spelled_emails(text)] == ["joe.x (at) site [dot] org", "ann at home dot net", "bo[at]b.c.d"]
    assert list(pii._spelled_emails(("x(at)" * 100_000))) == []
    rows = [(1, "a" * 200_000 + " (at) x", "p", 7, "o")]
    made = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, _pii string, _pii_row int, _own string"))
    assert made.columns == ["doc_id", "_pii", "_pii_row", "_own", "pii"] and tuple(made.collect()[0])[:4] == (1, "p", 7, "o")
    assert pii.personal_data(spark.createDataFrame([("x@y.z",)], "text string")).first().pii.base[0].kind == "email"
