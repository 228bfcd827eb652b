"""A sandboxed chat-template language: parsed to a syntax tree, folded, and compiled to Python closures.

    text            {{ expression }}            {% if e %} {% elif e %} {% else %} {% endif %}
    {% for m in messages %} {% endfor %}        {% generation %} {% endgeneration %}

Expressions: names, fields of a loop's message (role, text), loop.first, loop.last, loop.index, 'strings', numbers, true, false, ==, !=,
not, and, or, ~ (joins texts), parentheses, and the filters in FILTERS. There are no calls, no attributes of Python
objects and no assignments: a template can only read what it is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

#: Starts every control string of a template; escaping it makes texts unable to spell one.
CONTROL, ESCAPE = "<", "\\"
FIELDS = ("role", "text")


def escape(text: str) -> str:
    """Reversible: backslashes are doubled, and each start of a control string gets one before it."""
    return text.replace(ESCAPE, ESCAPE * 2).replace(CONTROL, ESCAPE + CONTROL)


def escape_line(text: str) -> str:
    """As escape, and line feeds become backslash n, so that the result is one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    """Pairs of backslashes are read from the left, so that one before a control string or an n is never half of a pair."""
    if ESCAPE not in text:
        return text
    return ESCAPE.join(p.replace(ESCAPE + CONTROL, CONTROL).replace(ESCAPE + "n", "\n") for p in text.split(ESCAPE * 2))


#: Escaped texts hold a backslash n only by escape_line: escape doubles every backslash.
FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    path: tuple[str, ...]


class Op(NamedTuple):
    kind: str
    args: tuple


class Put(NamedTuple):
    expr: Any


class If(NamedTuple):
    branches: tuple  # (condition, body)


class For(NamedTuple):
    name: str
    body: tuple


class Marked(NamedTuple):
    body: tuple


class TemplateError(ValueError):
    pass


_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|().]))")


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append(next((kind, text) for kind, text in zip(("string", "number", "word", "sign"), m.groups()) if text is not None))
        at = m.end()
    return out


class _Expression:
    """Recursive descent; names must be in scope."""

    def __init__(self, source: str, scope: frozenset[str]):
        self.tokens, self.at, self.scope = _tokens(source), 0, scope

    def peek(self, text: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] == text and self.tokens[self.at][0] != "string"

    def eat(self, text: str) -> bool:
        hit = self.peek(text)
        self.at += hit
        return hit

    def whole(self):
        e = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def chain(self, sign: str, kind: str, below: Callable):
        args = [below()]
        while self.eat(sign):
            args.append(below())
        return args[0] if len(args) == 1 else Op(kind, tuple(args))

    def either(self):
        return self.chain("or", "or", self.both)

    def both(self):
        return self.chain("and", "and", self.negated)

    def negated(self):
        return Op("not", (self.negated(),)) if self.eat("not") else self.compared()

    def compared(self):
        left = self.joined()
        for sign in ("==", "!="):
            if self.eat(sign):
                return Op(sign, (left, self.joined()))
        return left

    def joined(self):
        return self.chain("~", "join", self.filtered)

    def filtered(self):
        e = self.atom()
        while self.eat("|"):
            name = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            e = Op("filter", (name, e))
        return e

    def atom(self):
        if self.eat("("):
            e = self.either()
            if not self.eat(")"):
                raise TemplateError("missing )")
            return e
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "number":
            return Const(int(text))
        if kind == "word" and text in ("true", "false"):
            return Const(text == "true")
        if kind != "word" or text not in self.scope:
            raise TemplateError(f"unknown name {text!r}")
        path = [text]
        while self.eat("."):
            path.append(self.tokens[self.at][1] if self.at < len(self.tokens) else "")
            self.at += 1
        allowed = ("first", "last", "index") if text == "loop" else FIELDS
        if len(path) != 2 or path[1] not in allowed:
            raise TemplateError(f"no such field: {'.'.join(path)}")
        return Name(tuple(path))


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = [p for p in _TAGS.split(source) if p]
    at = 0

    def body(scope: frozenset[str], ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Put(_Expression(part[2:-2], scope).whole()))
            elif not part.startswith("{%"):
                out.append(Put(Const(part)))
            else:
                tag = part[2:-2].strip()
                word, _, rest = tag.partition(" ")
                if word in ends:
                    return tuple(out), tag
                if word == "if":
                    branches, condition = [], _Expression(rest, scope).whole()
                    while True:
                        inner, end = body(scope, ("elif", "else", "endif"))
                        branches.append((condition, inner))
                        if end == "endif":
                            break
                        condition = Const(True) if end == "else" else _Expression(end.partition(" ")[2], scope).whole()
                    out.append(If(tuple(branches)))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*) in messages", rest.strip())
                    if not m or "loop" in scope:
                        raise TemplateError(f"cannot loop: {tag!r}")
                    out.append(For(m[1], body(scope | {m[1], "loop"}, ("endfor",))[0]))
                elif word == "generation":
                    out.append(Marked(body(scope, ("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown or misplaced tag {tag!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    return body(frozenset(), ())[0]


def _apply(kind: str, values: list) -> Any:
    if kind == "join":
        return "".join(map(str, values))
    if kind == "not":
        return not values[0]
    return values[0] == values[1] if kind == "==" else values[0] != values[1]


def _fold_expression(e):
    if not isinstance(e, Op):
        return e
    if e.kind == "filter":
        inner = _fold_expression(e.args[1])
        return Const(FILTERS[e.args[0]](str(inner.value))) if isinstance(inner, Const) else Op("filter", (e.args[0], inner))
    args = [_fold_expression(a) for a in e.args]
    if e.kind in ("and", "or"):
        stop = e.kind == "or"
        kept = []
        for a in args:
            if isinstance(a, Const):
                if bool(a.value) == stop:
                    kept.append(Const(stop))
                    break
            else:
                kept.append(a)
        if not kept:
            return Const(not stop)
        return kept[0] if isinstance(kept[0], Const) else Op(e.kind, tuple(kept))
    if e.kind == "join":
        merged: list = []
        for a in args:
            if isinstance(a, Const) and merged and isinstance(merged[-1], Const):
                merged[-1] = Const(str(merged[-1].value) + str(a.value))
            else:
                merged.append(a)
        args = merged
        if len(args) == 1:
            return Const(str(args[0].value)) if isinstance(args[0], Const) else Op("join", tuple(args))
        return Op("join", tuple(args))
    if all(isinstance(a, Const) for a in args):
        return Const(_apply(e.kind, [a.value for a in args]))
    return Op(e.kind, tuple(args))


def fold(body: tuple) -> tuple:
    """The tree with constant expressions computed, branches that cannot be taken cut, and neighbouring texts joined."""
    out: list = []
    for node in body:
        if isinstance(node, Put):
            made = [Put(_fold_expression(node.expr))]
        elif isinstance(node, If):
            branches = []
            for condition, inner in node.branches:
                condition = _fold_expression(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, fold(inner)))
                if isinstance(condition, Const):
                    break
            made = list(branches[0][1]) if branches and isinstance(branches[0][0], Const) else [If(tuple(branches))] if branches else []
        elif isinstance(node, For):
            made = [For(node.name, fold(node.body))]
        else:
            made = [Marked(fold(node.body))]
        for m in made:
            if isinstance(m, Put) and isinstance(m.expr, Const) and out and isinstance(out[-1], Put) and isinstance(out[-1].expr, Const):
                out[-1] = Put(Const(str(out[-1].expr.value) + str(m.expr.value)))
            else:
                out.append(m)
    return tuple(out)


def _closure(e) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        value = e.value
        return lambda scope: value
    if isinstance(e, Name):
        a, b = e.path
        return lambda scope: scope[a][b]
    if e.kind == "filter":
        f, inner = FILTERS[e.args[0]], _closure(e.args[1])
        return lambda scope: f(str(inner(scope)))
    parts = [_closure(a) for a in e.args]
    if e.kind == "and":
        return lambda scope: all(p(scope) for p in parts)
    if e.kind == "or":
        return lambda scope: any(p(scope) for p in parts)
    kind = e.kind
    return lambda scope: _apply(kind, [p(scope) for p in parts])


#: What a template yields: a text and whether it lies in a generation block; None ends what belongs to one message.
Piece = tuple[str, bool] | None


def _program(body: tuple, marked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = []
    for node in body:
        if isinstance(node, Put):
            value = _closure(node.expr)
            steps.append(lambda scope, value=value: iter(((str(value(scope)), marked),)))
        elif isinstance(node, Marked):
            steps.append(_program(node.body, True))
        elif isinstance(node, If):
            branches = [(_closure(c), _program(b, marked)) for c, b in node.branches]
            steps.append(lambda scope, branches=branches: next((run(scope) for c, run in branches if c(scope)), iter(())))
        else:
            steps.append(_loop(node.name, _program(node.body, marked)))

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _loop(name: str, run: Callable[[dict], Iterator[Piece]]) -> Callable[[dict], Iterator[Piece]]:
    def loop(scope: dict) -> Iterator[Piece]:
        messages = iter(scope["messages"])
        item, k = next(messages, None), 0
        while item is not None:
            after = next(messages, None)
            yield from run({**scope, name: item, "loop": {"first": k == 0, "last": after is None, "index": k}})
            yield None
            item, k = after, k + 1

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (dicts of role and text) to pieces. It reads one message ahead and holds no other, so a
    conversation of any length renders in bounded memory."""
    run = _program(fold(parse(source)), False)
    return lambda messages: run({"messages": messages})
