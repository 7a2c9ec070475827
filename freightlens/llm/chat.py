"""Chat formatting with a small sandboxed template language.

A template is parsed to a tree, constants are folded, and the tree becomes Python
closures. It has ``{{ expression | filter }}``, ``{% for x in y %}``, ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% set x = expression %}`` and
``{% generation %} ... {% endgeneration %}``, which marks what a model is to learn.
Expressions know strings, numbers, names, fields (``x.y``, ``x["y"]``), ``+``,
comparisons, ``and``, ``or``, ``not`` and brackets. There are no calls, and fields
are looked up in dictionaries only, so a template reaches nothing but its input.

Conversations are sorted by turn and streamed through the closures: a turn is
rendered as it comes, so no conversation is ever held whole, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>"
TURN_START = "### "
ROLE_END = ": "
CONTROL = (TURN_START.strip(), TURN_END)

TEMPLATE = (
    "{% for message in messages %}"
    "### {{ message.role | name }}: "
    "{% if message.role == 'assistant' %}"
    "{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}")


def escape(text: Any) -> str:
    """Control strings and the backslash itself get a backslash before them."""
    out = str(text or "").replace("\\", "\\\\")
    for mark in CONTROL:
        out = out.replace(mark, "\\" + mark)
    return out


def escape_name(text: Any) -> str:
    """A role: as a text, and the colon that would end it too."""
    return escape(text).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape, "name": escape_name, "trim": lambda x: str(x or "").strip(),
    "upper": lambda x: str(x or "").upper(), "lower": lambda x: str(x or "").lower(),
}

_TOKEN = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<mark>==|!=|<=|>=|[-+<>()\[\].|=]))""")
_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}", re.S)


class TemplateError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        match = _TOKEN.match(source, at)
        if not match:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((match.lastgroup, match.group(match.lastgroup)))
        at = match.end()
    return out


class _Expression:
    """Tree of one expression: ``("const", v)``, ``("name", x)``, ``("field", e, e)``,
    ``("not", e)``, ``(operator, e, e)`` or ``("filter", name, e)``."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">="), ("+",))

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted and self.peek() != wanted:
            raise TemplateError(f"expected {wanted or 'a value'}, found {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.level(0)
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return folded(tree)

    def level(self, depth: int):
        if depth == len(self.LEVELS):
            return self.value()
        if depth == 2 and self.peek() == "not":
            self.take()
            return ("not", self.level(depth))
        tree = self.level(depth + 1)
        while self.peek() in self.LEVELS[depth]:
            tree = (self.take()[1], tree, self.level(depth + 1))
        return tree

    def value(self):
        kind, text = self.take()
        if kind == "string":
            tree = ("const", text[1:-1])
        elif kind == "number":
            tree = ("const", int(text))
        elif kind == "name":
            named = {"true": True, "false": False, "none": None}
            tree = ("const", named[text]) if text in named else ("name", text)
        elif text == "(":
            tree = self.level(0)
            self.take(")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                tree = ("field", tree, ("const", self.take()[1]))
            else:
                tree = ("field", tree, self.level(0))
                self.take("]")
        return tree


def folded(tree):
    """The tree with every part that depends on no name replaced by its value."""
    if tree[0] in ("const", "name"):
        return tree
    tree = tuple(folded(x) if isinstance(x, tuple) else x for x in tree)
    if all(x[0] == "const" for x in tree[1:] if isinstance(x, tuple)):
        return ("const", compiled(tree)({}))
    return tree


_OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int)
    else f"{'' if a is None else a}{'' if b is None else b}",
    "field": lambda a, b: a.get(b) if isinstance(a, dict) else None,
}


def compiled(tree) -> Callable[[dict], Any]:
    """A closure that evaluates an expression tree in an environment."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "filter":
        function, inner = FILTERS[tree[1]], compiled(tree[2])
        return lambda env: function(inner(env))
    if kind == "not":
        inner = compiled(tree[1])
        return lambda env: not inner(env)
    left, right = compiled(tree[1]), compiled(tree[2])
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "or":
        return lambda env: left(env) or right(env)
    operation = _OPERATIONS[kind]
    return lambda env: operation(left(env), right(env))


Pieces = Iterator[tuple[str, bool]]
Body = Callable[[dict, bool], Pieces]


class Template:
    """A compiled template. ``render(env)`` gives pieces ``(text, learned)``."""

    def __init__(self, source: str) -> None:
        self._parts, at = [], 0
        for match in _TAG.finditer(source):
            if match.start() > at:
                self._parts.append(("text", source[at:match.start()]))
            self._parts.append(("tag", match[1]) if match[1] is not None else ("value", match[2]))
            at = match.end()
        if source[at:]:
            self._parts.append(("text", source[at:]))
        self._at = 0
        self.body, stop = self._block(())
        if stop:
            raise TemplateError(f"unexpected {stop!r}")

    def render(self, env: dict) -> Pieces:
        return self.body(dict(env), False)

    def _block(self, stops: tuple[str, ...]) -> tuple[Body, str | None]:
        """Statements up to a tag that begins with one of ``stops``, and that tag."""
        steps: list[Body] = []
        while self._at < len(self._parts):
            kind, source = self._parts[self._at]
            self._at += 1
            if kind == "text":
                steps.append(_constant(source))
            elif kind == "value":
                tree = _Expression(source).whole()
                steps.append(_constant(_shown(tree[1])) if tree[0] == "const"
                             else _value(compiled(tree)))
            else:
                word = source.split()[0] if source.split() else ""
                if word in stops:
                    return _sequence(steps), source
                steps.append(self._statement(word, source))
        if stops:
            raise TemplateError(f"no {' or '.join(stops)}")
        return _sequence(steps), None

    def _statement(self, word: str, source: str) -> Body:
        if word == "for":
            match = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", source, re.S)
            if not match:
                raise TemplateError(f"cannot read {source!r}")
            items = compiled(_Expression(match[2]).whole())
            body, _ = self._block(("endfor",))
            return _loop(match[1], items, body)
        if word == "if":
            branches, otherwise = [], _sequence([])
            while True:
                test = _Expression(source.split(None, 1)[1]).whole()
                body, stop = self._block(("elif", "else", "endif"))
                branches.append((test, body))
                if stop.startswith("elif"):
                    source = stop
                    continue
                if stop.startswith("else"):
                    otherwise, _ = self._block(("endif",))
                return _choice(branches, otherwise)
        if word == "set":
            match = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)", source, re.S)
            if not match:
                raise TemplateError(f"cannot read {source!r}")
            return _assignment(match[1], compiled(_Expression(match[2]).whole()))
        if word == "generation":
            body, _ = self._block(("endgeneration",))
            return lambda env, learned: body(env, True)
        raise TemplateError(f"unknown tag {source!r}")


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _constant(text: str) -> Body:
    return lambda env, learned: iter([(text, learned)])


def _value(expression: Callable[[dict], Any]) -> Body:
    return lambda env, learned: iter([(_shown(expression(env)), learned)])


def _sequence(steps: list[Body]) -> Body:
    def run(env: dict, learned: bool) -> Pieces:
        for step in steps:
            yield from step(env, learned)

    return run


def _loop(name: str, items: Callable[[dict], Any], body: Body) -> Body:
    def run(env: dict, learned: bool) -> Pieces:
        for i, item in enumerate(items(env) or ()):
            env[name], env["loop"] = item, {"index": i + 1, "first": i == 0}
            yield from body(env, learned)

    return run


def _choice(branches: list, otherwise: Body) -> Body:
    """A branch whose test is constant false is dropped, what follows a true one too."""
    live = []
    for tree, body in branches:
        if tree[0] != "const":
            live.append((compiled(tree), body))
        elif tree[1]:
            otherwise = body
            break

    def run(env: dict, learned: bool) -> Pieces:
        for test, body in live:
            if test(env):
                return body(env, learned)
        return otherwise(env, learned)

    return run


def _assignment(name: str, value: Callable[[dict], Any]) -> Body:
    def run(env: dict, learned: bool) -> Pieces:
        env[name] = value(env)
        return iter(())

    return run


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _packed(rows: Iterator[tuple], schema: pa.Schema, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about so many characters."""
    kept: list[tuple] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)


def render(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted conversations as pieces ``conv_id, piece, text, learned``: the
    pieces of a conversation, in order, are its text; ``learned`` is the loss mask.

    A conversation is the rows of one ``conv_id`` (null is one, too) by ``turn``,
    nulls first; rows of the same turn by role and text. Null texts and roles are
    empty. Repeated rows are turns of their own. Other columns are ignored; an empty
    table gives no piece. Rows of a conversation come one after the other in one
    partition, and pieces too.
    """
    Template(template)  # mistakes show here and not in a task
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()),
                        ("learned", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template(template)

        def pieces():
            rows = _rows(batches, ["conv_id", "role", "text"])
            for conv, turns in groupby(rows, key=lambda r: r[0]):
                messages = ({"role": role or "", "text": text or ""} for _, role, text in turns)
                shown = made.render({"messages": messages})
                for i, (text, learned) in enumerate(shown):
                    yield conv, i, text, learned

        return _packed(pieces(), schema)

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition(
        "conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"),
        F.asc_nulls_first("text"))
    return ordered.mapInArrow(run, "conv_id long, piece long, text string, learned boolean")


class Reader:
    """Reads a formatted conversation back, piece by piece, holding one turn."""

    def __init__(self) -> None:
        self.turns = self.chars = self.loss_chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.held: list[str] = []
        self.learned: list[str] = []

    _TURN = re.compile(
        re.escape(TURN_START) + r"((?:\\.|[^\\:])*)" + re.escape(ROLE_END)
        + r"((?:\\.|[^\\])*?)" + re.escape(TURN_END) + "\n", re.S)

    def take(self, text: str, learned: bool) -> None:
        self.chars += len(text)
        if learned:
            self.learned.append(text)
        elif self.learned:
            self._learn()
        self.held.append(text)
        if text.endswith(TURN_END + "\n"):
            whole = "".join(self.held)
            match = self._TURN.fullmatch(whole)
            if match:
                self.turns += 1
                self.turn_hash.update(
                    f"{unescape(match[1])}\n{unescape(match[2])}\n".encode())
                self.held = []

    def _learn(self) -> None:
        text = unescape("".join(self.learned))
        self.loss_chars += len(text)
        self.loss_hash.update(text.encode())
        self.learned = []

    def result(self) -> tuple:
        self._learn()
        if self.held:
            raise ValueError(f"not a turn: {''.join(self.held)[:80]!r}")
        return (self.turns, self.turn_hash.hexdigest(), self.loss_chars,
                self.loss_hash.hexdigest(), self.chars)


def digests(rendered: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of
    what :func:`render` gives for the default template, parsed from its text."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read():
            rows = _rows(batches, ["conv_id", "text", "learned"])
            for conv, pieces in groupby(rows, key=lambda r: r[0]):
                reader = Reader()
                for _, text, learned in pieces:
                    reader.take(text, learned)
                yield conv, *reader.result()

        return _packed(read(), schema)

    return rendered.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long")
