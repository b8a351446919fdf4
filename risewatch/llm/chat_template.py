"""A small sandboxed template language, compiled: tokens, syntax tree, folded constants, Python closures.

Text is copied. ``{{ expression }}`` writes a value, ``{# … #}`` nothing. Statements: ``{% for m in messages %}…{% endfor %}``,
``{% if … %}…{% elif … %}…{% else %}…{% endif %}``, ``{% set name = expression %}`` and ``{% generation %}…{% endgeneration %}``,
which marks what a model should learn to write. A dash inside a delimiter (``{%-``, ``-}}``) takes the white space beside it.
Expressions: strings, whole numbers, true, false, none, names, ``a.b``, ``a['b']``, ``not``, ``and``, ``or``, comparisons, ``in``,
``+ - % ~`` and filters ``value | filter``. A loop knows ``loop.index``, ``index0``, ``first`` and ``last``.

The sandbox: fields are keys of the given messages, never Python attributes; nothing can be called; filters are a closed
set; names beginning with an underscore are refused; ``messages`` is a stream that is read once, so rendering is linear in
the conversation; depth and length of a template are bounded. Errors are ``TemplateError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

#: Most characters of a template, most nested constructs, and most characters a template may join into one value.
LONGEST, DEEPEST, LARGEST = 100_000, 40, 1 << 28

_TAG = re.compile(r"\{#.*?#\}|\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<number>\d{1,15})|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<sign>==|!=|<=|>=|[<>+\-%~.|()\[\]=]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "if", "elif", "else", "endif", "for", "endfor", "set", "generation", "endgeneration"}
_VALUES = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class TemplateError(ValueError):
    """The template or what it asks for is outside the language."""


# Syntax tree. Expressions: Const, Name, Field, Unary, Binary, Filtered. Statements: Text, Output, Choice, Loop, Assign, Marked.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    owner: object
    key: object


@dataclass(frozen=True)
class Unary:
    sign: str
    of: object


@dataclass(frozen=True)
class Binary:
    sign: str
    left: object
    right: object


@dataclass(frozen=True)
class Filtered:
    of: object
    name: str


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Choice:
    branches: tuple  # of (test, body)


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Marked:
    body: tuple


class Reader:
    """Recursive descent over the tokens of one expression or statement."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = self.depth = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, not {self.peek()!r}")

    def identifier(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or text in _WORDS or text in _VALUES or text.startswith("_"):
            raise TemplateError(f"a name expected, not {text!r}")
        self.at += 1
        return text

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")

    def chain(self, signs: tuple[str, ...], below: Callable):
        left = below()
        while sign := self.take(*signs):
            left = Binary(sign, left, below())
        return left

    def expression(self):
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("expression too deep")
        out = self.chain(("or",), lambda: self.chain(("and",), self.negation))
        self.depth -= 1
        return out

    def negation(self):
        n = 0
        while self.take("not"):
            n += 1
        out = self.comparison()
        return out if not n else Unary("not", out) if n % 2 else Unary("not", Unary("not", out))

    def comparison(self):
        left = self.chain(("+", "-", "~", "%"), self.postfix)
        while True:
            if sign := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                left = Binary(sign, left, self.chain(("+", "-", "~", "%"), self.postfix))
            elif self.peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                left = Unary("not", Binary("in", left, self.chain(("+", "-", "~", "%"), self.postfix)))
            else:
                return left

    def postfix(self):
        out = self.primary()
        while sign := self.take(".", "[", "|"):
            if sign == ".":
                out = Field(out, Const(self.identifier()))
            elif sign == "[":
                out = Field(out, self.expression())
                self.need("]")
            else:
                out = Filtered(out, self.identifier())
        return out

    def primary(self):
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind == "number":
            self.at += 1
            return Const(int(text))
        if kind == "string":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "name" and text in _VALUES:
            self.at += 1
            return Const(_VALUES[text])
        return Name(self.identifier())


def parse(template: str) -> tuple:
    """Template text -> statements."""
    if len(template) > LONGEST:
        raise TemplateError("template too long")
    parts, at = [], 0
    for m in _TAG.finditer(template):
        text = template[at : m.start()]
        parts.append(("text", text.rstrip() if m[0][2] == "-" else text))
        if m[1] is not None or m[2] is not None:
            parts.append(("output", m[1]) if m[1] is not None else ("statement", m[2]))
        at = m.end()
        if m[0][-3] == "-":
            while at < len(template) and template[at].isspace():
                at += 1
    parts.append(("text", template[at:]))
    parts.reverse()

    def body(ends: tuple[str, ...], depth: int, marked: bool) -> tuple[tuple, str | None, Reader | None]:
        if depth > DEEPEST:
            raise TemplateError("template too deep")
        out = []
        while parts:
            kind, source = parts.pop()
            if kind == "text":
                if source:
                    out.append(Text(source))
                continue
            reader = Reader(source)
            if kind == "output":
                out.append(Output(reader.expression()))
                reader.end()
                continue
            word = reader.take(*_WORDS)
            if word in ends:
                return tuple(out), word, reader
            if word == "set":
                name = reader.identifier()
                reader.need("=")
                out.append(Assign(name, reader.expression()))
                reader.end()
            elif word == "if":
                branches, test = [], reader.expression()
                reader.end()
                while True:
                    inside, word, reader = body(("elif", "else", "endif") if test is not None else ("endif",), depth + 1, marked)
                    branches.append((Const(True) if test is None else test, inside))
                    if word == "endif":
                        break
                    test = reader.expression() if word == "elif" else None
                    reader.end()
                reader.end()
                out.append(Choice(tuple(branches)))
            elif word == "for":
                name = reader.identifier()
                reader.need("in")
                if reader.identifier() != "messages":
                    raise TemplateError("only messages can be looped over")
                reader.end()
                inside, _, reader = body(("endfor",), depth + 1, marked)
                reader.end()
                out.append(Loop(name, inside))
            elif word == "generation" and not marked:
                reader.end()
                inside, _, reader = body(("endgeneration",), depth + 1, True)
                reader.end()
                out.append(Marked(inside))
            else:
                raise TemplateError(f"unexpected statement {source!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} missing")
        return tuple(out), None, None

    return body((), 0, False)[0]


def _plain(x) -> str:
    if isinstance(x, str):
        return x
    if x is None or isinstance(x, (bool, int)):
        return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    raise TemplateError("only texts and numbers can be written")


def _join(a: str, b: str) -> str:
    if len(a) + len(b) > LARGEST:
        raise TemplateError("joined text too long")
    return a + b


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return _join(a, b)
    if type(a) is int and type(b) is int:
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


def _number(f):
    def run(a, b):
        if type(a) is not int or type(b) is not int:
            raise TemplateError("numbers expected")
        return f(a, b)

    return run


def _ordered(f):
    def run(a, b):
        if type(a) is not type(b) or not isinstance(a, (int, str)):
            raise TemplateError("values cannot be ordered")
        return f(a, b)

    return run


def _rest(a, b):
    if b == 0:
        raise TemplateError("remainder by zero")
    return a % b


_BINARY = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _ordered(lambda a, b: a < b), ">": _ordered(lambda a, b: a > b),
    "<=": _ordered(lambda a, b: a <= b), ">=": _ordered(lambda a, b: a >= b), "in": lambda a, b: isinstance(b, (str, dict)) and _plain(a) in b,
    "+": _add, "~": lambda a, b: _join(_plain(a), _plain(b)), "-": _number(lambda a, b: a - b), "%": _number(_rest),
}


def fold(node, filters: dict[str, Callable[[str], str]]):
    """The tree with every constant expression, constant branch and run of texts worked out."""
    if isinstance(node, tuple):
        out: list = []
        for part in (fold(n, filters) for n in node):
            for n in part if isinstance(part, tuple) else (part,):
                if isinstance(n, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + n.text)
                elif n != Text(""):
                    out.append(n)
        return tuple(out)
    again = lambda x: fold(x, filters)
    match node:
        case Field(owner, key):
            return Field(again(owner), again(key))
        case Unary(sign, of):
            of = again(of)
            return Const(not of.value) if isinstance(of, Const) else Unary(sign, of)
        case Binary(sign, left, right):
            left, right = again(left), again(right)
            if sign in ("and", "or") and isinstance(left, Const):
                return right if bool(left.value) == (sign == "and") else left
            if sign in _BINARY and isinstance(left, Const) and isinstance(right, Const):
                return Const(_BINARY[sign](left.value, right.value))
            return Binary(sign, left, right)
        case Filtered(of, name):
            if name not in filters:
                raise TemplateError(f"no filter {name!r}")
            of = again(of)
            return Const(filters[name](_plain(of.value))) if isinstance(of, Const) else Filtered(of, name)
        case Output(value):
            value = again(value)
            return Text(_plain(value.value)) if isinstance(value, Const) else Output(value)
        case Choice(branches):
            kept = []
            for test, body in branches:
                test = again(test)
                if isinstance(test, Const) and not test.value:
                    continue
                kept.append((test, again(body)))
                if isinstance(test, Const):
                    break
            if kept and isinstance(kept[0][0], Const):
                return kept[0][1]
            return Choice(tuple(kept)) if kept else ()
        case Loop(name, body):
            return Loop(name, again(body))
        case Assign(name, value):
            return Assign(name, again(value))
        case Marked(body):
            body = again(body)
            return Marked(body) if body else ()
    return node


def value_of(node, filters) -> Callable[[dict], object]:
    """A closure from the names in scope to the value."""
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):
            return lambda env: env.get(name)
        case Field(owner, key):
            owner, key = value_of(owner, filters), value_of(key, filters)

            def field(env):
                held = owner(env)
                if not isinstance(held, dict):
                    raise TemplateError("only messages and loops have fields")
                return held.get(key(env))

            return field
        case Unary(_, of):
            of = value_of(of, filters)
            return lambda env: not of(env)
        case Binary(sign, left, right):
            left, right = value_of(left, filters), value_of(right, filters)
            if sign == "and":
                return lambda env: left(env) and right(env)
            if sign == "or":
                return lambda env: left(env) or right(env)
            work = _BINARY[sign]
            return lambda env: work(left(env), right(env))
        case Filtered(of, name):
            of, work = value_of(of, filters), filters[name]
            return lambda env: work(_plain(of(env)))
    raise TemplateError(f"not an expression: {node!r}")


Pieces = Iterator[tuple[str, bool]]


def body_of(nodes: tuple, filters) -> Callable[[dict], Pieces]:
    """A closure from the names in scope to pieces of text, each with whether it is marked as generation."""
    steps = tuple(step_of(n, filters) for n in nodes)

    def run(env: dict) -> Pieces:
        for step in steps:
            yield from step(env)

    return run


def step_of(node, filters) -> Callable[[dict], Iterable[tuple[str, bool]]]:
    match node:
        case Text(text):
            piece = ((text, False),)
            return lambda env: piece
        case Output(value):
            value = value_of(value, filters)
            return lambda env: ((_plain(value(env)), False),)
        case Assign(name, value):
            value = value_of(value, filters)

            def assign(env):
                env[name] = value(env)
                return ()

            return assign
        case Choice(branches):
            branches = tuple((value_of(test, filters), body_of(body, filters)) for test, body in branches)

            def choose(env):
                for test, body in branches:
                    if test(env):
                        return body(env)
                return ()

            return choose
        case Marked(body):
            body = body_of(body, filters)
            return lambda env: ((text, True) for text, _ in body(env))
        case Loop(name, body):
            body = body_of(body, filters)

            def loop(env):
                messages = env.pop("messages", None)
                if messages is None:
                    raise TemplateError("messages can be read once only")
                i, none = 0, object()
                now = next(messages, none)
                while now is not none:
                    after = next(messages, none)
                    yield from body(env | {name: now, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is none}})
                    now, i = after, i + 1

            return loop
    raise TemplateError(f"not a statement: {node!r}")


def compiled(template: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[[Iterable[dict]], Pieces]:
    """``render(messages)``: the pieces of one conversation, message by message, with their generation marks."""
    known = {"trim": str.strip, "upper": str.upper, "lower": str.lower} | (filters or {})
    run = body_of(fold(parse(template), known), known)
    return lambda messages: run({"messages": iter(messages)})
