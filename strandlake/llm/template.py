"""A sandboxed template language, compiled to Python closures.

    {{ expression }}                     the value as text
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% for name in e %} .. {% endfor %}  with loop.index0, loop.first and loop.last
    {% generation %} .. {% endgeneration %}  marks what a model is to learn

Expressions: names, ``a.b`` and ``a['b']`` (keys of mappings only, never Python
attributes), text and whole-number literals, true, false, none, ``+``, ``==``, ``!=``,
``not``, ``and``, ``or``, ``in``, parentheses, and filters ``e | name`` from a given
table.  Nothing else can be called, so a template reaches only its variables.

The text is parsed into a syntax tree, constants are folded (operators and
filters of literals, branches with a known condition, neighbouring text), and the
tree becomes closures.  A rendering is a generator of (text, marked) parts;
loops take any iterator and look one item ahead, so a long conversation is
never held as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


# ---- syntax tree


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Call:
    """An operator, or a filter if its name starts with '|'."""

    operator: str
    arguments: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Branch:
    condition: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().\[\]]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class _Expression:
    """A recursive-descent parser of one expression."""

    source: str
    filters: Mapping[str, Callable[[Any], Any]]
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def parse(self) -> Any:
        end = 0
        text = self.source.rstrip()
        while end < len(text):
            if not (m := _TOKEN.match(text, end)):
                raise TemplateError(f"can't read {text[end:]!r}")
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.tokens.append((" snw+"[kind], m[kind]))
            end = m.end()
        out = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return out

    def _next(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in "w+" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, value: str) -> None:
        if not self._next(value):
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def _or(self) -> Any:
        left = self._and()
        while self._next("or"):
            left = Call("or", (left, self._and()))
        return left

    def _and(self) -> Any:
        left = self._not()
        while self._next("and"):
            left = Call("and", (left, self._not()))
        return left

    def _not(self) -> Any:
        return Call("not", (self._not(),)) if self._next("not") else self._compare()

    def _compare(self) -> Any:
        left = self._sum()
        while operator := self._next("==", "!=", "in"):
            left = Call(operator, (left, self._sum()))
        return left

    def _sum(self) -> Any:
        left = self._filtered()
        while self._next("+"):
            left = Call("+", (left, self._filtered()))
        return left

    def _filtered(self) -> Any:
        value = self._value()
        while self._next("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "w" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Call(f"|{name}", (value,))
        return value

    def _value(self) -> Any:
        if self._next("("):
            value = self._or()
            self._need(")")
        elif self.at >= len(self.tokens):
            raise TemplateError(f"a value is missing in {self.source!r}")
        else:
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "s":
                value = Literal(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
            elif kind == "n":
                value = Literal(int(text))
            elif kind == "w" and text in ("true", "false", "none"):
                value = Literal({"true": True, "false": False, "none": None}[text])
            elif kind == "w" and text not in ("and", "or", "not", "in"):
                value = Name(text)
            else:
                raise TemplateError(f"unexpected {text!r} in {self.source!r}")
        while True:
            if self._next("."):
                kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "w":
                    raise TemplateError(f"a key is missing in {self.source!r}")
                self.at += 1
                value = Key(value, text)
            elif self._next("["):
                key = self._or()
                self._need("]")
                if not isinstance(key, Literal) or not isinstance(key.value, str):
                    raise TemplateError("a key is a text literal")
                value = Key(value, key.value)
            else:
                return value


def parse(source: str, filters: Mapping[str, Callable[[Any], Any]]) -> tuple:
    """The syntax tree: a tuple of Output, Branch, Loop and Generation."""
    pieces: list[tuple[str, str]] = []
    end = 0
    for m in _PIECE.finditer(source):
        pieces.append(("text", source[end : m.start()]))
        if m[1] is not None:
            pieces.append(("value", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        end = m.end()
    pieces.append(("text", source[end:]))
    if any(mark in text for kind, text in pieces if kind == "text" for mark in ("{{", "{%", "{#")):
        raise TemplateError("a tag isn't closed")
    at = 0

    def expression(text: str) -> Any:
        return _Expression(text, filters).parse()

    def body(*ends: str) -> tuple[tuple, str]:
        """Nodes up to a tag that starts with one of ends; that tag."""
        nonlocal at
        nodes: list[Any] = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            word, _, rest = text.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "text":
                if text:
                    nodes.append(Output(Literal(text)))
            elif kind == "value":
                nodes.append(Output(expression(text)))
            elif word in ends:
                return tuple(nodes), text
            elif word == "if":
                nodes.append(branch(rest))
            elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                over = expression(m[2])
                nodes.append(Loop(m[1], over, body("endfor")[0]))
            elif word == "generation":
                nodes.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    def branch(condition: str) -> Branch:
        then, tag = body("elif", "else", "endif")
        word, _, rest = tag.partition(" ")
        other: tuple = ()
        if word == "elif":
            other = (branch(rest),)
        elif word == "else":
            other, _ = body("endif")
        return Branch(expression(condition), then, other)

    return body()[0]


# ---- constants


def as_text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)


def _plus(a: Any, b: Any) -> Any:
    return a + b if type(a) is int and type(b) is int else as_text(a) + as_text(b)


_OPERATORS: dict[str, Callable[..., Any]] = {"+": _plus, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in (b or ()), "not": lambda a: not a}


def _folded(e: Any, filters: Mapping[str, Callable[[Any], Any]]) -> Any:
    if isinstance(e, Key):
        return Key(_folded(e.of, filters), e.key)
    if not isinstance(e, Call):
        return e
    arguments = tuple(_folded(a, filters) for a in e.arguments)
    if e.operator in ("and", "or"):
        if isinstance(arguments[0], Literal):
            return arguments[bool(arguments[0].value) == (e.operator == "and")]
    elif all(isinstance(a, Literal) for a in arguments):
        f = filters[e.operator[1:]] if e.operator[0] == "|" else _OPERATORS[e.operator]
        return Literal(f(*(a.value for a in arguments)))
    return Call(e.operator, arguments)


def fold(nodes: tuple, filters: Mapping[str, Callable[[Any], Any]]) -> tuple:
    out: list[Any] = []
    for node in nodes:
        if isinstance(node, Output):
            value = _folded(node.value, filters)
            new: tuple = (Output(Literal(as_text(value.value))),) if isinstance(value, Literal) else (Output(value),)
        elif isinstance(node, Branch):
            condition = _folded(node.condition, filters)
            then, other = fold(node.then, filters), fold(node.other, filters)
            new = (then if condition.value else other) if isinstance(condition, Literal) else (Branch(condition, then, other),)
        elif isinstance(node, Loop):
            new = (Loop(node.name, _folded(node.over, filters), fold(node.body, filters)),)
        else:
            new = (Generation(fold(node.body, filters)),)
        for x in new:
            if isinstance(x, Output) and isinstance(x.value, Literal):
                if not x.value.value:
                    continue
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Literal):
                    out[-1] = Output(Literal(out[-1].value.value + x.value.value))
                    continue
            out.append(x)
    return tuple(out)


# ---- closures

Part = tuple[str, bool]


def _value_of(e: Any, filters: Mapping[str, Callable[[Any], Any]]) -> Callable[[dict], Any]:
    if isinstance(e, Literal):
        constant = e.value
        return lambda scope: constant
    if isinstance(e, Name):
        name = e.name
        return lambda scope: scope.get(name)
    if isinstance(e, Key):
        of, key = _value_of(e.of, filters), e.key
        return lambda scope: v.get(key) if isinstance(v := of(scope), Mapping) else None
    a = [_value_of(x, filters) for x in e.arguments]
    if e.operator == "and":
        return lambda scope: a[0](scope) and a[1](scope)
    if e.operator == "or":
        return lambda scope: a[0](scope) or a[1](scope)
    f = filters[e.operator[1:]] if e.operator[0] == "|" else _OPERATORS[e.operator]
    if len(a) == 1:
        one = a[0]
        return lambda scope: f(one(scope))
    left, right = a
    return lambda scope: f(left(scope), right(scope))


def _ahead(items: Iterable[Any]) -> Iterator[tuple[Any, bool]]:
    """Items, and whether each is the last."""
    items = iter(items)
    for item in items:
        for following in items:
            yield item, False
            item = following
        yield item, True


def _closure(nodes: tuple, filters: Mapping[str, Callable[[Any], Any]]) -> Callable[[dict, bool], Iterator[Part]]:
    steps: list[Callable[[dict, bool], Iterable[Part]]] = []

    def output(value: Callable[[dict], Any]) -> Callable[[dict, bool], Iterable[Part]]:
        return lambda scope, marked: ((as_text(value(scope)), marked),)

    def branch(condition: Callable[[dict], Any], then: Callable, other: Callable) -> Callable[[dict, bool], Iterable[Part]]:
        return lambda scope, marked: (then if condition(scope) else other)(scope, marked)

    def loop(name: str, over: Callable[[dict], Any], body: Callable) -> Callable[[dict, bool], Iterable[Part]]:
        def run(scope: dict, marked: bool) -> Iterator[Part]:
            for k, (item, last) in enumerate(_ahead(over(scope) or ())):
                yield from body({**scope, name: item, "loop": {"index0": k, "first": k == 0, "last": last}}, marked)

        return run

    for node in nodes:
        if isinstance(node, Output):
            steps.append(output(_value_of(node.value, filters)))
        elif isinstance(node, Branch):
            steps.append(branch(_value_of(node.condition, filters), _closure(node.then, filters), _closure(node.other, filters)))
        elif isinstance(node, Loop):
            steps.append(loop(node.name, _value_of(node.over, filters), _closure(node.body, filters)))
        else:
            inner = _closure(node.body, filters)
            steps.append(lambda scope, marked, inner=inner: inner(scope, True))

    def run(scope: dict, marked: bool) -> Iterator[Part]:
        for step in steps:
            yield from step(scope, marked)

    return run


class Template:
    def __init__(self, source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None):
        self.filters = dict(filters or {})
        self.tree = fold(parse(source, self.filters), self.filters)
        self._run = _closure(self.tree, self.filters)

    def parts(self, **variables: Any) -> Iterator[Part]:
        """The rendering as (text, whether it is marked) parts, lazily."""
        return self._run(variables, False)

    def render(self, **variables: Any) -> str:
        return "".join(text for text, _ in self.parts(**variables))
