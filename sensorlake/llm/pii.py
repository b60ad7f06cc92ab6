"""Personal data: base patterns, and contextual patterns bootstrapped from what the base finds.

Base spans (e-mail and IP addresses, card and phone numbers) are the seeds. Every look-alike in a text - an e-mail in words, a
number without its check digit, a short phone number - is a candidate, and the two words before an entity or
candidate are its lexical pattern. Patterns and instances form a graph that Spark scores in rounds: a pattern is as good as the
share of its instances that are believed, an instance as good as its patterns together make it; seeds stay believed.
Candidates that stand behind patterns with enough seeds and a high score are added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

KINDS = ("email", "ip", "card", "phone")
#: rounds of scoring; least distinct seeds of a pattern; least scores that count
ROUNDS, SEEDS, PATTERN_SCORE, INSTANCE_SCORE = 3, 5, 0.8, 0.8

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: a digit before a match would only shorten one that begins earlier, so looking back changes no result
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: look-alikes of each kind: wider than the base, only believed behind a good pattern
_LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}[ .-]?){3}[0-9]{3,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: e-mail look-alikes are looked for from their mark on: the local part back from it, the domain behind it
_MARK = re.compile(r" ?(?:\(at\)|\[at\]) ?| at ")
_MARKED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]+)+")
_SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+")
_HINTS = {"email": ("(at)", "[at]", " dot "), "ip": ("[.]", "(.)")}
_WORD = re.compile(r"[^\W\d_]+")
#: code points before an entity in which its pattern's words are looked for
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        local = text[done:at]
        start = at - len(local) + len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _spelled_emails(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses with their @ spelled out; each character is looked at once or twice, however long the text."""
    done = 0
    for mark in _MARK.finditer(text):
        if mark.start() < done:
            continue
        local = text[done:mark.start()]
        start = mark.start() - len(local) + len(local.rstrip(_LOCAL))
        domain = _SPOKEN_DOMAIN if mark.group() == " at " else _MARKED_DOMAIN
        found = domain.match(text, mark.end()) if start < mark.start() else None
        if found:
            yield start, found.end()
        done = found.end() if found else mark.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                      if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                      if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(found, key=_order)


def _order(span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Look-alikes that no base span touches."""
    if not _DIGIT.search(text) and not any(h in text for h in _HINTS["email"]):
        return []
    found = [("email", a, b) for a, b in _spelled_emails(text)] if any(h in text for h in _HINTS["email"]) else []
    for kind, pattern in _LOOSE.items():
        if kind in _HINTS and not any(h in text for h in _HINTS[kind]):
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    free, at, held = [], 0, sorted(base, key=lambda s: s[1])
    ends = []
    for _, _, end in held:
        ends.append(max(end, ends[-1] if ends else 0))
    for span in sorted(found, key=_order):
        while at < len(held) and held[at][1] < span[2]:
            at += 1
        if not at or ends[at - 1] <= span[1]:
            free.append(span)
    return free


def pattern_of(text: str, kind: str, start: int) -> str | None:
    """The kind and up to two words before the span, A-Z as they sound in lower case; None at the start of a text."""
    before = text[max(0, start - CONTEXT):start].rpartition("\n")[2].lower()
    words = _WORD.findall(before)[-2:]
    return f"{kind}|{' '.join(words)}" if words else None


def find(docs: DataFrame) -> DataFrame:
    """The rows with base spans, candidates and their patterns in one column `_pii`; one pass over the texts."""
    span = "kind:string,start:int,end:int,pattern:string,instance:string"
    schema = f"struct<base:array<struct<{span}>>,more:array<struct<{span}>>>"
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()),
                      ("instance", pa.string())])

    def described(text, spans):
        return [{"kind": k, "start": a, "end": b, "pattern": pattern_of(text, k, a),
                 "instance": hashlib.md5(f"{k}|{text[a:b].lower()}".encode()).hexdigest()} for k, a, b in spans]

    @F.arrow_udf(schema)
    def spans(texts: pa.Array) -> pa.Array:
        base, more = [], []
        for at in range(0, len(texts), 256):
            for text in texts.slice(at, 256).to_pylist():
                text = text or ""
                found = base_spans(text)
                base.append(described(text, found))
                more.append(described(text, candidates(text, found)))
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(kind)), pa.array(more, pa.list_(kind))],
                                          ["base", "more"])

    return docs.withColumn("_pii", spans(F.col("text")))


def believed_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern): those with SEEDS distinct seeds and a final score of PATTERN_SCORE or more."""
    def edges(column: str, seed: bool) -> DataFrame:
        return (found.select(F.explode(f"_pii.{column}").alias("s")).where(F.col("s.pattern").isNotNull())
                .select("s.pattern", "s.instance", F.lit(seed).alias("seed")))
    graph = edges("base", True).unionByName(edges("more", False))
    graph = materialize(graph.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    # only patterns that also have candidates can add anything, and only with enough seeds
    useful = (graph.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds"),
                                           F.sum((~F.col("seed")).cast("int")).alias("others"))
              .where((F.col("seeds") >= SEEDS) & (F.col("others") > 0)).select("pattern"))
    graph = materialize(graph.join(useful, "pattern"), "pii-useful")
    instances = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(rounds):
        patterns = (graph.join(instances, "instance").groupBy("pattern")
                    .agg((F.sum("score") / (F.count("*") + F.lit(0.5))).alias("good")))
        patterns = materialize(patterns, "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("good")))))
        instances = graph.join(patterns, "pattern").groupBy("instance").agg(
            F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("score"))
        instances = materialize(instances.where(F.col("score") >= 0), "pii-instances")
    return patterns.where(F.col("good") >= PATTERN_SCORE).select("pattern")


def personal_data(docs: DataFrame) -> DataFrame:
    """The rows with one more column `pii`: struct(base, added), arrays of struct(kind, start, end) in code points.

    A null or empty text has no spans. Rows are judged one by one, also those with equal or null ids. Texts are read
    whole, in time linear in their length. `base` has what the base patterns match, leftmost and without overlap within a
    kind; `added` what the bootstrapped patterns find. The text is left out, all other columns stay, whatever their names (one
    named pii is replaced); an empty table gives an empty table.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "pii")]
    narrow = docs.select("text", (F.struct(*own) if own else F.lit(None)).alias("_own")).withColumn("_pii_row", F.monotonically_increasing_id())
    found = materialize(find(narrow).drop("text").withColumn("_own", F.col("_own") if own else F.lit(0)), "pii-spans")
    patterns = believed_patterns(found)
    hits = (found.select("_pii_row", F.explode("_pii.more").alias("s")).where(F.col("s.pattern").isNotNull())
            .withColumn("pattern", F.col("s.pattern")).join(patterns, "pattern", "left_semi")
            .groupBy("_pii_row").agg(F.collect_list(F.struct("s.kind", "s.start", "s.end")).alias("_added")))
    plain = F.transform("_pii.base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return (found.join(hits, "_pii_row", "left")
            .withColumn("pii", F.struct(plain.alias("base"), F.coalesce("_added", none).alias("added")))
            .select(*(["_own.*"] if own else []), "pii"))


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), place(s).alias("b"),
                                                               s["end"].alias("c"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
