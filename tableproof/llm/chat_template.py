"""A small sandboxed template language, compiled to Python closures.

``{{ expr }}`` writes a value; ``{% for x in xs %}``, ``{% if %} / {% elif %} / {% else %}``,
``{% set x = expr %}`` and ``{% generation %} ... {% endgeneration %}`` are the statements.
Expressions are literals, names, ``a.b`` and ``a['b']`` on mappings, ``+ ~ == != and or not in``, and
filters ``x | name``. A template can reach the values it is given, the loop counters and the filters,
nothing else: there are no calls, no Python attributes and no imports.

``compile_template`` parses to a tree, folds what does not depend on values, and returns a closure
that streams ``(text, generated)`` pieces. A loop reads its sequence once, one element ahead, so
a conversation of any length is rendered from an iterator.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace


class TemplateError(ValueError):
    """The template is malformed, or reaches for what it may not."""


# --- tree -----------------------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Write:
    expr: object


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing --------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[+~|.()\[\]=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:]!r}")
        number, string, name, sign = m.groups()
        kind = "int" if number else "str" if string else "name" if name else "sign"
        out.append((kind, m[0].strip()))
        at = m.end()
    return out


class _Expr:
    """Recursive descent over one tag's tokens; each level binds tighter than the one that calls it."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.tokens[self.at][0] != "str":
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, {self.peek()!r} found")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name":
            raise TemplateError(f"a name expected, {text!r} found")
        self.at += 1
        return text

    def all(self):
        tree = self.either()
        if self.peek() is not None:
            raise TemplateError(f"{self.peek()!r} is left over")
        return tree

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        for op in ("==", "!=", "in"):
            if self.take(op):
                return Op(op, (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while self.peek() in ("+", "~"):
            op = self.peek()
            self.at += 1
            left = Op(op, (left, self.filtered()))
        return left

    def filtered(self):
        left = self.reached()
        while self.take("|"):
            left = Filter(left, self.name())
        return left

    def reached(self):
        left = self.atom()
        while True:
            if self.take("."):
                left = Item(left, Const(self.name()))
            elif self.take("["):
                left = Item(left, self.either())
                self.need("]")
            else:
                return left

    def atom(self):
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "int":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[text]) if text in fixed else Name(text)
        raise TemplateError(f"a value expected, {text!r} found")


def parse(source: str) -> tuple:
    """Template text to a tuple of statements."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("write", m[1]))
        elif m[2] is not None:
            parts.append(("do", m[2]))
        at = m.end()
    parts.append(("text", source[at:]))
    body, end, _ = _block(parts, 0, ())
    if end != len(parts):
        raise TemplateError("a block ends that did not begin")
    return body


def _block(parts, at, until) -> tuple[tuple, int, _Expr | None]:
    """Statements up to a tag named in ``until``; the position behind it and the tag."""
    out = []
    while at < len(parts):
        kind, text = parts[at]
        at += 1
        if kind == "text":
            if text:
                out.append(Write(Const(text)))
            continue
        if kind == "write":
            out.append(Write(_Expr(_tokens(text)).all()))
            continue
        tag = _Expr(_tokens(text))
        word = tag.name()
        if word in until:
            tag.at = 0
            return tuple(out), at, tag
        if word == "set":
            name = tag.name()
            tag.need("=")
            out.append(Set(name, tag.all()))
        elif word == "for":
            name = tag.name()
            tag.need("in")
            over = tag.all()
            body, at, _ = _block(parts, at, ("endfor",))
            out.append(For(name, over, body))
        elif word == "generation":
            body, at, _ = _block(parts, at, ("endgeneration",))
            out.append(Generation(body))
        elif word == "if":
            branch, at = _branches(parts, at, tag)
            out.append(branch)
        else:
            raise TemplateError(f"unknown statement {word!r}")
    if until:
        raise TemplateError(f"{until[-1]} is missing")
    return tuple(out), at, None


def _branches(parts, at, tag) -> tuple[If, int]:
    test = tag.all()
    then, at, end = _block(parts, at, ("elif", "else", "endif"))
    word = end.name()
    if word == "elif":
        other, at = _branches(parts, at, end)
        return If(test, then, (other,)), at
    if word == "else":
        other, at, _ = _block(parts, at, ("endif",))
        return If(test, then, other), at
    return If(test, then, ()), at


# --- constant folding -------------------------------------------------------------

def _apply(op: str, values: list):
    if op == "not":
        return not values[0]
    a, b = values
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "in":
        return a in b
    if op == "~":
        return _text(a) + _text(b)
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(tree, filters: Mapping[str, Callable[[str], str]]):
    """The same tree with constant expressions evaluated, dead branches gone and adjacent texts joined."""
    if isinstance(tree, tuple):
        out: list = []
        for node in tree:
            done = fold(node, filters)
            for n in done if isinstance(done, tuple) else (done,):
                if isinstance(n, Write) and isinstance(n.expr, Const):
                    n = Write(Const(_text(n.expr.value)))
                    if out and isinstance(out[-1], Write) and isinstance(out[-1].expr, Const):
                        n = Write(Const(out.pop().expr.value + n.expr.value))
                    if not n.expr.value:
                        continue
                out.append(n)
        return tuple(out)
    if isinstance(tree, Item):
        return Item(fold(tree.of, filters), fold(tree.key, filters))
    if isinstance(tree, Filter):
        of = fold(tree.of, filters)
        if tree.name not in filters:
            raise TemplateError(f"unknown filter {tree.name!r}")
        return Const(filters[tree.name](_text(of.value))) if isinstance(of, Const) else Filter(of, tree.name)
    if isinstance(tree, Op):
        args = tuple(fold(a, filters) for a in tree.args)
        if tree.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (tree.op == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            return Const(_apply(tree.op, [a.value for a in args]))
        return Op(tree.op, args)
    if isinstance(tree, Write):
        return Write(fold(tree.expr, filters))
    if isinstance(tree, Set):
        return Set(tree.name, fold(tree.expr, filters))
    if isinstance(tree, If):
        test, then, other = (fold(x, filters) for x in (tree.test, tree.then, tree.other))
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(tree, For):
        return replace(tree, over=fold(tree.over, filters), body=fold(tree.body, filters))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body, filters))
    return tree


# --- closures ---------------------------------------------------------------------

Piece = tuple[str, bool]
Render = Callable[[dict, bool], Iterator[Piece]]


def _value(tree, filters) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        constant = tree.value
        return lambda env: constant
    if isinstance(tree, Name):
        name = tree.name
        return lambda env: env.get(name)
    if isinstance(tree, Item):
        of, key = _value(tree.of, filters), _value(tree.key, filters)

        def item(env):
            holder = of(env)
            if not isinstance(holder, Mapping):
                raise TemplateError("only mappings have items")
            return holder.get(key(env))

        return item
    if isinstance(tree, Filter):
        of, apply = _value(tree.of, filters), filters[tree.name]
        return lambda env: apply(_text(of(env)))
    a = _value(tree.args[0], filters)
    if tree.op == "not":
        return lambda env: not a(env)
    b = _value(tree.args[1], filters)
    if tree.op == "and":
        return lambda env: a(env) and b(env)
    if tree.op == "or":
        return lambda env: a(env) or b(env)
    op = tree.op
    return lambda env: _apply(op, [a(env), b(env)])


def _body(tree: tuple, filters) -> Render:
    steps = [_step(node, filters) for node in tree]

    def run(env, generated):
        for step in steps:
            yield from step(env, generated)

    return run


def _step(node, filters) -> Render:
    if isinstance(node, Write):
        value = _value(node.expr, filters)

        def write(env, generated):
            text = _text(value(env))
            if text:
                yield text, generated

        return write
    if isinstance(node, Set):
        value, name = _value(node.expr, filters), node.name

        def put(env, generated):
            env[name] = value(env)
            yield from ()

        return put
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _body(node.then, filters), _body(node.other, filters)
        return lambda env, generated: (then if test(env) else other)(env, generated)
    if isinstance(node, Generation):
        marked = _body(node.body, filters)
        return lambda env, generated: marked(env, True)
    over, inner, name = _value(node.over, filters), _body(node.body, filters), node.name

    def loop(env, generated):
        values = iter(over(env) or ())
        missing = object()
        now = next(values, missing)
        index = 0
        while now is not missing:
            ahead = next(values, missing)
            scope = dict(env)
            scope[name] = now
            scope["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is missing}
            yield from inner(scope, generated)
            now, index = ahead, index + 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable[[str], str]]) -> Callable[[Mapping[str, Iterable]], Iterator[Piece]]:
    """Closure from values to ``(text, generated)`` pieces; ``generated`` marks what a model is to learn."""
    run = _body(fold(parse(source), filters), filters)
    return lambda values: run(dict(values), False)
