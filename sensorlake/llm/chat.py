"""Chat formatting: templates compiled to Python closures that render conversations turn by turn.

The template language has text, `{{ expression }}` and the tags `for NAME in NAME ... endfor`,
`if EXPR ... elif EXPR ... else ... endif`, `generation ... endgeneration`. Expressions are string literals, names,
`name.field`, `==`, `!=`, `and`, `or`, `not`, `+`, `in`, parentheses and the filters `escape`, `title`, `upper`,
`lower`, `trim`. Nothing else can be reached: no calls, no attributes of Python objects. Constant parts are
folded when the template is compiled. Rendering is lazy: a `for` over the turns pulls one row at a time, so a
conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: strings that have a meaning in the output, and so are escaped inside texts and roles
CONTROL = ("\\", "### ", "</turn>")
_ESCAPE = re.compile("|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(" + "|".join(map(re.escape, CONTROL)) + ")")

TEMPLATE = (
    "{% for message in messages %}"
    "{% if message.role == 'assistant' %}### Assistant: {% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% elif message.role == 'user' %}### User: {{ message.text | escape }}"
    "{% elif message.role == 'system' %}### System: {{ message.text | escape }}"
    "{% else %}### Role={{ message.role | escape }}: </turn>{{ message.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group(1), text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "title": str.title, "upper": str.upper, "lower": str.lower, "trim": str.strip,
}


class TemplateError(ValueError):
    pass


# ---- syntax tree: tuples of a kind and its parts ----

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[|.+()]))")
_TAG = re.compile(r"\{%-?(.*?)-?%\}|\{\{(.*?)\}\}", re.S)


def _tokens(source: str) -> list[tuple[str, str]]:
    found, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        literal, name, sign = m.groups()
        if literal is not None:
            found.append(("text", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), literal[1:-1])))
        else:
            found.append(("name", name) if name is not None else ("sign", sign))
        at = m.end()
    return found


class _Expression:
    """Recursive descent over or, and, not, comparison, +, filters, atoms."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind != "text" and value in values:
            self.at += 1
            return value
        return None

    def parse(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.sum()
        while sign := self.take("==", "!=", "in"):
            tree = (sign, tree, self.sum())
        return tree

    def sum(self):
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        kind, value = self.peek()
        self.at += 1
        if kind == "text":
            return ("const", value)
        if kind != "name":
            raise TemplateError(f"unexpected {value or 'end'!r}")
        tree = ("name", value)
        while self.take("."):
            kind, field = self.peek()
            if kind != "name":
                raise TemplateError("a field name is missing")
            self.at += 1
            tree = ("field", tree, field)
        return tree


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts.append(("text", source[at:m.start()]))
        parts.append(("tag", m[1].strip()) if m[1] is not None else ("print", m[2]))
        at = m.end()
    parts.append(("text", source[at:]))
    parts = [p for p in parts if p != ("text", "")]
    place = 0

    def block(*stops: str) -> tuple[tuple, str]:
        nonlocal place
        body: list[tuple] = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                body.append(("emit", ("const", value)))
            elif kind == "print":
                body.append(("emit", _Expression(value).parse()))
            else:
                word, _, rest = value.partition(" ")
                if word in stops:
                    return ("block", *body), value
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)\s*", rest)
                    if not m:
                        raise TemplateError(f"bad for: {rest!r}")
                    body.append(("for", m[1], m[2], block("endfor")[0]))
                elif word == "if":
                    body.append(condition(rest))
                elif word == "generation":
                    body.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {value!r}")
        if stops:
            raise TemplateError(f"missing {stops[-1]}")
        return ("block", *body), ""

    def condition(test: str) -> tuple:
        then, stop = block("elif", "else", "endif")
        word, _, rest = stop.partition(" ")
        other = condition(rest) if word == "elif" else block("endif")[0] if word == "else" else ("block",)
        return ("if", _Expression(test).parse(), then, other)

    return block()[0]


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b,
}


def fold(tree: tuple) -> tuple:
    """The same template with constant expressions computed, dead branches dropped and texts joined."""
    kind = tree[0]
    if kind in _BINARY:
        a, b = fold(tree[1]), fold(tree[2])
        return ("const", _BINARY[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold(tree[1]), fold(tree[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "not":
        a = fold(tree[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(tree[2])
        return ("const", FILTERS[tree[1]](a[1])) if a[0] == "const" else ("filter", tree[1], a)
    if kind == "emit":
        return ("emit", fold(tree[1]))
    if kind == "for":
        return ("for", tree[1], tree[2], fold(tree[3]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    if kind == "if":
        test, then, other = fold(tree[1]), fold(tree[2]), fold(tree[3])
        return (then if test[1] else other) if test[0] == "const" else ("if", test, then, other)
    if kind == "block":
        body: list[tuple] = []
        for part in map(fold, tree[1:]):
            for p in part[1:] if part[0] == "block" else (part,):
                if body and p[0] == body[-1][0] == "emit" and p[1][0] == body[-1][1][0] == "const":
                    body[-1] = ("emit", ("const", body[-1][1][1] + p[1][1]))
                else:
                    body.append(p)
        return ("block", *body)
    return tree


Scope = dict
Piece = tuple[str, bool]


def _value(tree: tuple) -> Callable[[Scope], object]:
    kind = tree[0]
    if kind == "const":
        return lambda scope, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: scope.get(n, "")
    if kind == "field":
        inner = _value(tree[1])

        def field(scope, name=tree[2]):
            holder = inner(scope)
            return holder.get(name, "") if isinstance(holder, dict) else ""
        return field
    if kind == "filter":
        inner, apply = _value(tree[2]), FILTERS[tree[1]]
        return lambda scope: apply(str(inner(scope)))
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    a, b = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope, f=_BINARY[kind]: f(a(scope), b(scope))


def _closure(tree: tuple, trained: bool) -> Callable[[Scope], Iterator[Piece]]:
    kind = tree[0]
    if kind == "emit":
        if tree[1][0] == "const":
            return lambda scope, piece=(str(tree[1][1]), trained): iter((piece,))
        value = _value(tree[1])
        return lambda scope: iter(((str(value(scope)), trained),))
    if kind == "generation":
        return _closure(tree[1], True)
    if kind == "if":
        test, then, other = _value(tree[1]), _closure(tree[2], trained), _closure(tree[3], trained)
        return lambda scope: then(scope) if test(scope) else other(scope)
    if kind == "for":
        body = _closure(tree[3], trained)

        def loop(scope, name=tree[1], over=tree[2]):
            for item in scope.get(over, ()):
                yield from body({**scope, name: item})
        return loop
    parts = [_closure(p, trained) for p in tree[1:]]

    def block(scope):
        for part in parts:
            yield from part(scope)
    return block


def compile_template(source: str = TEMPLATE) -> Callable[..., Iterator[Piece]]:
    """render(**names) -> pieces (text, whether the loss covers it); names hold strings, dicts, and iterables for `for`."""
    run = _closure(fold(parse(source)), False)
    return lambda **names: run(names)


# ---- reading the default template's output back ----

_HEADS = {"### Assistant: ": "assistant", "### User: ": "user", "### System: ": "system"}
_OTHER = "### Role="
_END = "</turn>"


def _field_end(text: str, at: int) -> int:
    """Where the next unescaped end mark stands."""
    while True:
        end = text.index(_END, at)
        slashes = end - at - len(text[at:end].rstrip("\\"))
        if slashes % 2 == 0:
            return end
        at = end + len(_END)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn of TEMPLATE."""
    for head, role in _HEADS.items():
        if formatted.startswith(head):
            return role, unescape(formatted[len(head):_field_end(formatted, len(head))])
    end = _field_end(formatted, len(_OTHER))
    text_at = end + len(_END)
    return unescape(formatted[len(_OTHER):end - 2]), unescape(formatted[text_at:_field_end(formatted, text_at)])


# ---- Spark ----

FORMATTED = "conv_id long, seq long, formatted string, loss array<struct<start:int,end:int>>"


def _group_rows(frames: Iterable[pd.DataFrame], key: str) -> Iterator[tuple[object, Iterator]]:
    """(key, its rows) over frames sorted by key; rows of a key must be used up before the next is asked for."""
    rows = (r for f in frames for r in f.itertuples(index=False))
    held = next(rows, None)
    while held is not None:
        value = getattr(held, key)

        def mine():
            nonlocal held
            while held is not None and getattr(held, key) == value:
                row, held = held, None
                yield row
                held = next(rows, None)
        group = mine()
        yield value, group
        for _ in group:
            pass


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per turn: (conv_id, seq, formatted, loss): a conversation's formatted rows in order of seq are its text;
    `loss` has the spans, in code points of the row, that training covers.

    Rows are read in order of turn, equal turns in order of role and text, null turns first. Null texts and roles are
    empty; rows with a null conv_id form one conversation, reported as null. Repeated rows are turns of their own.
    Other columns are not read. Text that the template puts after its loop belongs to the last turn's row. Rows of a
    conversation are sorted by Spark and streamed, never gathered.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("conv_id").isNull().alias("no_id"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    rows = (rows.withColumn("key", F.when(F.col("no_id"), "").otherwise(F.col("conv_id").cast("string")))
            .repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text"))
    compile_template(template)  # errors in the template show on the driver

    def render(frames):
        run = compile_template(template)
        out: list[tuple] = []

        def row(key, seq, pieces):
            at, spans = 0, []
            for text, trained in pieces:
                if trained:
                    spans.append({"start": at, "end": at + len(text)})
                at += len(text)
            out.append((int(key) if key else None, seq, "".join(p for p, _ in pieces), spans))

        def frame():
            made = pd.DataFrame(out, columns=["conv_id", "seq", "formatted", "loss"])
            made["conv_id"] = made["conv_id"].astype("Int64")
            out.clear()
            return made

        for key, turns in _group_rows(frames, "key"):
            seq, pieces, started = 0, [], []

            def messages():
                for turn in turns:
                    started.append(1)
                    yield {"role": turn.role, "text": turn.text}

            for piece in run(messages=messages()):
                if len(started) > 1:  # the piece is of the next turn: the one before is complete
                    row(key, seq, pieces)
                    seq, pieces = seq + 1, []
                    del started[:-1]
                pieces.append(piece)
            row(key, seq, pieces)
            if len(out) >= 500 or sum(len(o[2]) for o in out) > 4 << 20:
                yield frame()
        if out:
            yield frame()

    return rows.mapInPandas(render, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation of `format_conversations`, read from its output alone: conv_id, n_turns, turns_sha256
    (role, \\n, text, \\n of each turn), loss_chars, loss_sha256 (unescaped text under the loss spans), formatted_chars.

    Takes the rows as `format_conversations` leaves them: a conversation in one partition, in order of seq.
    """
    def keyed(frames):
        for frame in frames:
            yield frame.assign(key=frame["conv_id"].astype("object").where(frame["conv_id"].notna(), ""))

    def run(frames):
        out = []
        for key, turns in _group_rows(keyed(frames), "key"):
            n = chars = covered = 0
            turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
            for t in turns:
                role, text = read_turn(t.formatted)
                turns_hash.update(f"{role}\n{text}\n".encode())
                for span in t.loss:
                    trained = unescape(t.formatted[span["start"]:span["end"]])
                    loss_hash.update(trained.encode())
                    covered += len(trained)
                n, chars = n + 1, chars + len(t.formatted)
            out.append((None if key == "" else int(key), n, turns_hash.hexdigest(), covered, loss_hash.hexdigest(), chars))
            if len(out) >= 2000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                       "formatted_chars"])
    made["conv_id"] = made["conv_id"].astype("Int64")
    return made
