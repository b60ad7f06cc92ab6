"""The stages of the pipeline on small tables with null and repeated ids, by brute force."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sensorlake import storage
from sensorlake.llm import decontamination, jaccard_join, language_id, line_dedup


def prose(rng, n):
    return " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(n))


def edited(text, word):
    return " ".join([*text.split()[:-1], word])


def shown(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").encode().lower().decode())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(texts):
    """A label per text, equal for texts that links lead between."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    return label


@pytest.fixture(scope="module")
def repeated():
    """Ids that are null or stand on rows of different groups; no two texts of one group have the same id but for copies."""
    rng = random.Random(3)
    a, b, c = (prose(rng, 40) for _ in range(3))
    near = edited(a, "other")
    made = [(5, a), (5, b), (3, near), (None, c), (None, prose(rng, 30)), (None, prose(rng, 30)), (9, edited(c, "more")),
            (7, a), (7, prose(rng, 20)), (7, None), (7, ""), (None, None), (8, " \n"), (11, "short"), (11, "brief"), (12, "SHORT")]
    made += [(i, edited(b, f"x{i}")) for i in range(20, 30)]
    return made + [made[1], made[3]]


def test_near_duplicates(spark, repeated):
    table = spark.createDataFrame([(*r, "mine") for r in repeated], "doc_id long, text string, _key string")
    low = lambda i: -2 ** 63 if i is None else i
    label, first = groups([t for _, t in repeated]), {}
    for x, r in zip(label, repeated, strict=True):
        first[x] = min(first.get(x, r), r, key=lambda r: low(r[0]))
    got = corpus_pipeline.near_duplicates(spark, table, "").collect()
    assert shown(got) == shown((*r, "mine") for r in first.values())
    assert corpus_pipeline.near_duplicates(spark, table.where("false"), "").collect() == []


def test_one_row_of_a_group(spark):
    """Two texts of one group under its smallest id, in copies with other columns: one row stays, always the same."""
    rng = random.Random(4)
    a = prose(rng, 40)
    rows = [(1, a, "p"), (1, a, "q"), (1, edited(a, "other"), "p"), (1, edited(a, "other"), "r"), (2, a, "p"), (1, prose(rng, 40), "p")]
    found = []
    for at in range(2):
        table = spark.createDataFrame(rows[at:] + rows[:at], "doc_id long, text string, source string").repartition(1 + at)
        found.append(shown(corpus_pipeline.near_duplicates(spark, table, "").collect()))
    assert found[0] == found[1] and len(found[0]) == 2
    assert rows[5] in found[0] and all(r[0] == 1 for r in found[0])


#: of categories No, Nl, Nd, Mn, So and Lo, Lm, Lu outside the first plane
NO_LETTER, LETTER = ["\u00b2", "\u00bd 1", "\u2460", "\u2167", "12 34", "\u0301", "\u24b6", "", " \n", None], ["\u65e5", "\u02b0", "\U00010400 7", "1a"]


@pytest.mark.parametrize("lang", [None, "en"])
def test_language(spark, lang):
    """Without a label there is no model; the stage drops the same documents as with one."""
    rows = [(None if i % 4 == 0 else i, t, lang, "mine") for i, t in enumerate([*NO_LETTER, *LETTER, "plain words", "plain words"])]
    rows += rows[-1:]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(table, F.lit(True))
    assert (model is None) == (lang is None)
    got = corpus_pipeline.language(spark, table, "").collect()
    assert shown(got) == shown(r for r in rows if r[1] not in NO_LETTER)
    told = [(r.text, *r.language) for r in language_id.identify(table, model).collect()]
    assert all(letter == (t not in NO_LETTER) and (p == "und") == (model is None or not letter) for t, p, _, letter in told)
    assert corpus_pipeline.language(spark, table.where("false"), "").collect() == []


#: the last columns are named like those that the stages add for a while
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _language string, _Lines string, _found string"


def low(i):
    return -2 ** 63 if i is None else i


def row(i, text, lang=None):
    return (i, text, lang, "s", len(text or ""), "l", "m", "f")


def after_lines(rows):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").encode().lower().decode()
    where, made = {}, []
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                where.setdefault(key(x), set()).add(low(i))
    for i, t, lang, source, _, *more in rows:
        left = "\n".join(x for x in (t or "").split("\n") if len(where.get(key(x), ())) < 3 or max(where[key(x)]) == low(i))
        made.append((i, left, lang, source, len(left), *more))
    return made


def after_benchmark(rows, items):
    kept = []
    for r in rows:
        w, hit = decontamination._words(r[1]), set()
        for text in items:
            v = decontamination._words(text)
            n = min(13, len(v))
            windows = {tuple(v[a:a + n]) for a in range(len(v) - n + 1)} if n else set()
            hit |= {p for a in range(len(w) - n + 1) if tuple(w[a:a + n]) in windows for p in range(a, a + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    return kept


def after_tokens(rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    made = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        made.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return made


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(rows, benchmark texts, folder of both tables): null and repeated ids, no lang."""
    rng = random.Random(8)
    a, b, item = prose(rng, 40), prose(rng, 40), prose(rng, 20)
    line = "\nThis line stands in several documents"
    rows = [row(5, a), row(5, b + line), row(3, edited(a, "other") + line.upper()), row(None, prose(rng, 30) + line),
            row(None, prose(rng, 30)), row(8, line.strip()), row(9, "12 34"), row(None, None), row(10, ""), row(11, item),
            row(None, "before " + item), row(12, prose(rng, 20) + " " + item.upper()), row(13, prose(rng, 30))]
    rows += [rows[1], rows[4], rows[7]]
    items, folder = [item, None, ""], str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(enumerate(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, folder


def test_other_stages(spark, corpus):
    rows, items, folder = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for stage, want in ((corpus_pipeline.language, [r for r in rows if re.search("[a-z]", r[1] or "")]),
                        (corpus_pipeline.lines, after_lines(rows)), (corpus_pipeline.benchmark, after_benchmark(rows, items)),
                        (corpus_pipeline.tokens, after_tokens(rows))):
        made = stage(spark, table, folder)
        assert stage is corpus_pipeline.tokens or made.columns == table.columns
        assert shown(made.collect()) == shown(want) and want != rows
        assert stage(spark, table.where("false"), folder).collect() == []


def test_run(spark, corpus):
    rows, items, folder = corpus
    left = after_lines([r for r in rows if re.search("[a-z]", r[1] or "")])
    first, loose = {}, []
    for x, r in zip(groups([r[1] for r in left]), left, strict=True):
        if shingles(r[1]):
            first[x] = min(first.get(x, r), r, key=lambda r: low(r[0]))
        else:
            loose.append(r)
    want = after_tokens(after_benchmark([*first.values(), *loose], items))
    assert shown(corpus_pipeline.run(spark, folder).collect()) == shown(want)


def test_a_text_is_fingerprinted_once(spark, corpus, monkeypatch):
    """A filter on what a Python function gives must not call it again, in a second worker of the same task."""
    made, write = {}, storage.materialize

    def watched(df, name):
        made.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython ["))
        return write(df, name)
    for module in (jaccard_join, line_dedup):
        monkeypatch.setattr(module, "materialize", watched)
    folder = corpus[2]
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    corpus_pipeline.lines(spark, docs, folder)
    corpus_pipeline.near_duplicates(spark, docs, folder)
    hits = decontamination.candidate_items(docs, items, 13, 5)
    made["hits"] = [hits._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [prints")]
    assert max(made["suspect-lines"]) == 1 and max(made["pairs"]) == 1 and made["hits"] == [1]
