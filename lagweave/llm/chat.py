"""Chat formatting by a compiled template.

The template language has text, `{{ expression }}`, `{% for x in messages %}`, `{% if %} {% elif %} {% else %}`, `{% set x = .. %}` and
`{% generation %}`, which marks what a model is to learn. Expressions have strings, whole numbers, true, false, none, variables, fields
(`x.role`, `x['role']`), `loop.first`, `loop.index`, `+ ~ == != < > <= >= in and or not`, brackets and the filters `escape`,
`trim`, `upper`, `lower`, `length`. It is a sandbox: there are no calls, no attributes beyond the fields of a message, no
imports and no loops but over the messages, so a template ends and cannot reach Python.

A template is parsed into a syntax tree, constants are folded (text joined, constant expressions computed, dead branches dropped), and the tree
becomes Python closures. Rendering is a stream of (text, is generated) pieces, so a conversation of any length needs the
memory of one message. Output rows hold whole turns, some 2^20 characters at most unless one turn is longer; the spans of generated text are
their loss mask.

`escape` puts a backslash before control strings and backslashes of a text, so that the markers of the template are the only bare
ones and the text can be read back exactly.

Defined cases: NULL roles and texts are empty. Turns go by number, NULL first, equal numbers by role and text; repeated rows are
turns of their own. A NULL conversation id is a conversation. An empty table gives no rows. Further columns are ignored.
"""

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import stored
from .common import ship

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}<s>{{ m.role | escape }}[INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "[/INST]</s>{% endfor %}"
)
PART = 1 << 20


class TemplateError(ValueError):
    pass


def escape(text: str, control: tuple[str, ...] = CONTROL) -> str:
    marks = "|".join(map(re.escape, sorted(control, key=len, reverse=True)))
    return re.sub(rf"\\|{marks}", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


# Syntax tree


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Show:
    value: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: tuple


@dataclass(frozen=True)
class Branch:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generated:
    body: tuple


TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.\[\]()]))", re.S)
WORDS = {"and", "or", "not", "in"}
CONSTANTS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
DEPTH = 50

FILTERS: dict[str, Callable] = {
    "escape": escape,
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
}
OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "~": lambda a, b: _shown(a) + _shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
            string, number, name, sign = found.groups()
            if string is not None:
                self.tokens.append(("constant", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), string[1:-1], flags=re.S)))
            elif number is not None:
                self.tokens.append(("constant", int(number)))
            elif name in CONSTANTS:
                self.tokens.append(("constant", CONSTANTS[name]))
            else:
                self.tokens.append(("sign" if sign or name in WORDS else "name", sign or name))
            at = found.end()
        self.at = self.depth = 0

    def parse(self) -> tuple:
        value = self._either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def _take(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _need(self, sign: str) -> None:
        if not self._take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def _either(self) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        value = self._both()
        while self._take("or"):
            value = ("or", value, self._both())
        self.depth -= 1
        return value

    def _both(self) -> tuple:
        value = self._negated()
        while self._take("and"):
            value = ("and", value, self._negated())
        return value

    def _negated(self) -> tuple:
        if self._take("not"):
            self.depth += 1
            if self.depth > DEPTH:
                raise TemplateError("nested too deeply")
            return ("not", self._negated())
        return self._compared()

    def _compared(self) -> tuple:
        value = self._joined()
        if sign := self._take("==", "!=", "<", ">", "<=", ">=", "in"):
            value = ("operator", sign, value, self._joined())
        return value

    def _joined(self) -> tuple:
        value = self._filtered()
        while sign := self._take("+", "~"):
            value = ("operator", sign, value, self._filtered())
        return value

    def _filtered(self) -> tuple:
        value = self._field()
        while self._take("|"):
            name = self._name()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            value = ("filter", name, value)
        return value

    def _field(self) -> tuple:
        if self._take("("):
            value = self._either()
            self._need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "constant":
            value = ("constant", self.tokens[self.at][1])
            self.at += 1
        else:
            value = ("variable", self._name())
        while sign := self._take(".", "["):
            if sign == ".":
                value = ("field", value, self._name())
                continue
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "constant" or not isinstance(name, str):
                raise TemplateError("a field is a string")
            self.at += 1
            self._need("]")
            value = ("field", value, name)
        return value


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for tag in TAG.finditer(source):
        parts += [("text", source[at : tag.start()]), ("show", tag[1]) if tag[1] is not None else ("tag", tag[2].strip())]
        at = tag.end()
    parts = [p for p in [*parts, ("text", source[at:])] if p != ("text", "")]
    body, rest, stop = _body(parts, 0, (), 0)
    return body


def _body(parts: list, at: int, stops: tuple[str, ...], depth: int) -> tuple[tuple, int, str]:
    """Nodes up to one of the closing tags: (nodes, index after it, the tag)."""
    if depth > DEPTH:
        raise TemplateError("nested too deeply")
    out = []
    while at < len(parts):
        kind, value = parts[at]
        at += 1
        if kind == "text":
            out.append(Text(value))
            continue
        if kind == "show":
            out.append(Show(_Expression(value).parse()))
            continue
        word, _, rest = value.partition(" ")
        if word in stops:
            return tuple(out), at, value
        if word == "for":
            named = re.fullmatch(r"(\w+)\s+in\s+messages", rest.strip())
            if not named:
                raise TemplateError("loops go over messages")
            body, at, _ = _body(parts, at, ("endfor",), depth + 1)
            out.append(Loop(named[1], body))
        elif word == "if":
            arms, condition = [], _Expression(rest).parse()
            while True:
                body, at, stop = _body(parts, at, ("elif", "else", "endif"), depth + 1)
                arms.append((condition, body))
                if stop == "endif":
                    break
                condition = ("constant", True) if stop == "else" else _Expression(stop.partition(" ")[2]).parse()
            out.append(Branch(tuple(arms)))
        elif word == "generation":
            body, at, _ = _body(parts, at, ("endgeneration",), depth + 1)
            out.append(Generated(body))
        elif word == "set":
            named = re.fullmatch(r"(\w+)\s*=(?!=)(.*)", rest.strip(), re.S)
            if not named or named[1] in ("messages", "loop"):
                raise TemplateError("set needs a name and a value")
            out.append(Assign(named[1], _Expression(named[2]).parse()))
        else:
            raise TemplateError(f"unexpected tag {value!r}")
    if stops:
        raise TemplateError(f"{stops[-1]} is missing")
    return tuple(out), at, ""


# Constant folding


def fold_value(value: tuple) -> tuple:
    kind, *rest = value
    if kind in ("constant", "variable"):
        return value
    if kind == "field":
        return (kind, fold_value(rest[0]), rest[1])
    if kind == "filter":
        inner = fold_value(rest[1])
        return ("constant", FILTERS[rest[0]](inner[1])) if inner[0] == "constant" else (kind, rest[0], inner)
    if kind == "not":
        inner = fold_value(rest[0])
        return ("constant", not inner[1]) if inner[0] == "constant" else (kind, inner)
    if kind in ("and", "or"):
        a, b = map(fold_value, rest)
        if a[0] == "constant":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    a, b = fold_value(rest[1]), fold_value(rest[2])
    if a[0] == b[0] == "constant":
        try:
            return ("constant", OPERATORS[rest[0]](a[1], b[1]))
        except TypeError as error:
            raise TemplateError(str(error)) from error
    return (kind, rest[0], a, b)


def fold(nodes: tuple) -> tuple:
    out: list = []
    for node in nodes:
        if isinstance(node, Show):
            value = fold_value(node.value)
            new = [Text(_shown(value[1]))] if value[0] == "constant" else [Show(value)]
        elif isinstance(node, Assign):
            new = [Assign(node.name, fold_value(node.value))]
        elif isinstance(node, Loop):
            new = [Loop(node.name, fold(node.body))]
        elif isinstance(node, Generated):
            new = [Generated(fold(node.body))]
        elif isinstance(node, Branch):
            arms = []
            for condition, body in node.arms:
                condition = fold_value(condition)
                if condition[0] == "constant" and not condition[1]:
                    continue
                arms.append((condition, fold(body)))
                if condition[0] == "constant":
                    break
            always = arms and arms[0][0][0] == "constant"
            new = list(arms[0][1]) if always else [Branch(tuple(arms))] if arms else []
        else:
            new = [node]
        for one in new:
            if isinstance(one, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + one.value)
            elif one != Text(""):
                out.append(one)
    return tuple(out)


# Closures

Piece = tuple[str, bool]
TURN = ("", None)  # between two turns of a loop


def _value(value: tuple) -> Callable[[dict], object]:
    kind, *rest = value
    if kind == "constant":
        return lambda scope, c=rest[0]: c
    if kind == "variable":
        return lambda scope, name=rest[0]: scope.get(name)
    if kind == "field":
        return lambda scope, of=_value(rest[0]), name=rest[1]: (lambda x: x.get(name) if isinstance(x, dict) else None)(of(scope))
    if kind == "filter":
        return lambda scope, f=FILTERS[rest[0]], of=_value(rest[1]): f(of(scope))
    if kind == "not":
        return lambda scope, of=_value(rest[0]): not of(scope)
    if kind == "and":
        return lambda scope, a=_value(rest[0]), b=_value(rest[1]): a(scope) and b(scope)
    if kind == "or":
        return lambda scope, a=_value(rest[0]), b=_value(rest[1]): a(scope) or b(scope)
    return lambda scope, f=OPERATORS[rest[0]], a=_value(rest[1]), b=_value(rest[2]): f(a(scope), b(scope))


def _closure(nodes: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
    made = [_node(n) for n in nodes]

    def run(scope: dict, generated: bool) -> Iterator[Piece]:
        for one in made:
            yield from one(scope, generated)

    return run


def _node(node) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, Text):
        return lambda scope, generated: iter(((node.value, generated),))
    if isinstance(node, Show):
        value = _value(node.value)
        return lambda scope, generated: iter(((_shown(value(scope)), generated),))
    if isinstance(node, Generated):
        inner = _closure(node.body)
        return lambda scope, generated: inner(scope, True)
    if isinstance(node, Assign):
        value = _value(node.value)

        def assign(scope, generated):
            scope[node.name] = value(scope)
            return iter(())

        return assign
    if isinstance(node, Branch):
        arms = [(_value(c), _closure(b)) for c, b in node.arms]

        def branch(scope, generated):
            return next((body(scope, generated) for test, body in arms if test(scope)), iter(()))

        return branch
    body = _closure(node.body)

    def loop(scope, generated):
        for index, message in enumerate(scope["messages"]):
            scope[node.name], scope["loop"] = message, {"first": index == 0, "index": index + 1, "index0": index}
            yield from body(scope, generated)
            yield TURN

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages, read once, to (text, is generated) pieces; `TURN` stands after every turn of a loop."""
    run = _closure(fold(parse(source)))
    return lambda messages: run({"messages": messages}, False)


# Tables

FORMATTED = "conv_id bigint, part int, formatted string, spans array<struct<start:int,stop:int>>"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _out(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _format(batches, template: str, size: int):
    """Conversations arrive one after another, each in order."""
    render, ready, held = compile_template(template), [], 0
    names, kinds = ["conv_id", "part", "formatted", "spans"], [pa.int64(), pa.int32(), pa.string(), SPANS]
    for conversation, own in groupby(_rows(batches), key=lambda r: r[0]):
        pieces, spans, length, part = [], [], 0, 0
        for text, generated in render({"role": role or "", "text": text or ""} for _, role, text in own):
            if generated is None:
                if length >= size:
                    ready.append((conversation, part, "".join(pieces), spans))
                    held += length
                    pieces, spans, length, part = [], [], 0, part + 1
                if held >= size:
                    yield _out(ready, names, kinds)
                    ready, held = [], 0
                continue
            if generated:
                spans.append({"start": length, "stop": length + len(text)})
            pieces.append(text)
            length += len(text)
        if pieces or not part:
            ready.append((conversation, part, "".join(pieces), spans))
            held += length + 1
        if len(ready) >= 10_000:
            yield _out(ready, names, kinds)
            ready, held = [], 0
    if ready:
        yield _out(ready, names, kinds)


def format_chats(conversations: DataFrame, template: str = TEMPLATE, part: int = PART) -> DataFrame:
    """(conv_id, part, formatted, spans): the formatted conversations in parts of whole turns.

    A conversation goes through one task as a stream, because its text is one sequence; the task holds one part of it.
    """
    compile_template(template)  # errors show here, not in a task
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(partial(_format, template=template, size=part), FORMATTED)


MARKS = re.compile(r"(?:\\.|[^\\<\[])+|" + "|".join(map(re.escape, CONTROL)) + r"|[<\[]", re.S)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a text in the default template."""
    role, field = "", []
    for mark in MARKS.finditer(formatted):
        found = mark[0]
        if found == "[INST]":
            role, field = "".join(field), []
        elif found == "[/INST]":
            yield unescape(role), unescape("".join(field))
            field = []
        elif found not in CONTROL:
            field.append(found)


def _read(batches):
    out = []
    names, kinds = [c.split()[0] for c in READ.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for conversation, parts in groupby(_rows(batches), key=lambda r: r[0]):
        turns, loss, n, learned, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, _, formatted, spans in parts:
            length += len(formatted)
            for role, text in turns_of(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for span in spans:
                text = unescape(formatted[span["start"] : span["stop"]])
                loss.update(text.encode())
                learned += len(text)
        out.append((conversation, n, turns.hexdigest(), learned, loss.hexdigest(), length))
        if len(out) >= 10_000:
            yield _out(out, names, kinds)
            out = []
    if out:
        yield _out(out, names, kinds)


def read_chats(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, per conversation: turns, text under the loss mask, length."""
    ship(formatted.sparkSession)
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_read, READ)


def format_and_read(conversations: DataFrame) -> DataFrame:
    """The conversations and one of control strings (id -1), formatted, written, and read back."""
    hard = "</s>[INST] ok [/INST]"
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = rows.sparkSession.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)
    return read_chats(stored(format_chats(rows.unionByName(extra)), "chats"))
