"""A small template language, compiled to Python closures.

``{{ expression }}`` prints; ``{% for m in messages %} ... {% endfor %}`` loops once, at the
top; ``{% if %} {% elif %} {% else %} {% endif %}`` chooses; ``{% generation %} ...
{% endgeneration %}`` marks what a model is to learn.  Expressions are strings in single
quotes, ``m.role``, ``m.text``, ``loop.first``, ``loop.last``, ``==``, ``!=``, ``not``, ``and``,
``or``, ``+``, brackets, and the filters ``escape``, ``trim``, ``upper``, ``lower``.  There is no
other name, call or attribute, so a template reaches nothing but its messages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|([A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_]+)?)|(==|!=|[+|()]))")
_NAMES = ("m.role", "m.text", "loop.first", "loop.last")
_WORDS = ("and", "or", "not", "true", "false")


class TemplateError(ValueError):
    """The template is malformed or names something it may not."""


# syntax tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Print:
    value: object


@dataclass
class Choice:
    arms: list[tuple[object, list]] = field(default_factory=list)


@dataclass
class Loop:
    body: list


@dataclass
class Learn:
    body: list


class _Expression:
    """Precedence climbing over one expression; constants fold as the tree is built."""

    def __init__(self, source: str, filters: dict[str, Callable[[str], str]]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            text, name, sign = m.groups()
            self.tokens.append(("text", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), text)) if text is not None else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def _next(self, *wanted) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return True
        return False

    def parse(self):
        out = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _or(self):
        left = self._and()
        while self._next(("name", "or")):
            left = fold(Op("or", (left, self._and())))
        return left

    def _and(self):
        left = self._not()
        while self._next(("name", "and")):
            left = fold(Op("and", (left, self._not())))
        return left

    def _not(self):
        return fold(Op("not", (self._not(),))) if self._next(("name", "not")) else self._compare()

    def _compare(self):
        left = self._sum()
        for sign in ("==", "!="):
            if self._next(("sign", sign)):
                return fold(Op(sign, (left, self._sum())))
        return left

    def _sum(self):
        left = self._filtered()
        while self._next(("sign", "+")):
            left = fold(Op("+", (left, self._filtered())))
        return left

    def _filtered(self):
        value = self._atom()
        while self._next(("sign", "|")):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "nothing")
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Const(self.filters[name](str(value.value))) if isinstance(value, Const) else Op(name, (value,))
        return value

    def _atom(self):
        if self._next(("sign", "(")):
            out = self._or()
            if not self._next(("sign", ")")):
                raise TemplateError("missing )")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(value)
        if kind == "name" and value in ("true", "false"):
            return Const(value == "true")
        if kind == "name" and value in _NAMES:
            return Name(value)
        raise TemplateError(f"no name {value!r}")


_BINARY = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: str(a) + str(b),
    "and": lambda a, b: bool(a) and bool(b),
    "or": lambda a, b: bool(a) or bool(b),
}


def fold(op: Op):
    """The constant an operation always gives, or the operation."""
    if all(isinstance(a, Const) for a in op.args):
        values = [a.value for a in op.args]
        return Const(not values[0] if op.op == "not" else _BINARY[op.op](*values))
    for a in op.args:
        if op.op == "and" and a == Const(False) or op.op == "or" and a == Const(True):
            return a
    return op


def parse(source: str, filters: dict[str, Callable[[str], str]]) -> list:
    """The template's nodes with constant parts merged and impossible arms dropped."""
    root: list = []
    stack: list[tuple[str, object, list]] = [("top", None, root)]
    at = 0
    for m in _TAG.finditer(source):
        stack[-1][2].append(Print(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Print(_Expression(m[1], filters).parse()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        here = stack[-1][0]
        if word == "for":
            if rest.split() != ["m", "in", "messages"] or len(stack) > 1:
                raise TemplateError("the loop is `for m in messages`, at the top")
            stack.append(("for", None, []))
        elif word == "if":
            stack.append(("if", (Choice(), _Expression(rest, filters).parse()), []))
        elif word in ("elif", "else") and here == "if":
            _, (choice, test), body = stack.pop()
            choice.arms.append((test, body))
            stack.append(("if", (choice, _Expression(rest, filters).parse() if word == "elif" else Const(True)), []))
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word == f"end{here}":
            _, held, body = stack.pop()
            if here == "if":
                held[0].arms.append((held[1], body))
            stack[-1][2].append(Loop(body) if here == "for" else Learn(body) if here == "generation" else held[0])
        else:
            raise TemplateError(f"unexpected {word!r}")
    stack[-1][2].append(Print(Const(source[at:])))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return _simplify(root)


def _simplify(nodes: list) -> list:
    out: list = []
    for node in nodes:
        if isinstance(node, Choice):
            arms = []
            for test, body in node.arms:
                if test != Const(False):
                    arms.append((test, _simplify(body)))
                if test == Const(True):
                    break
            new = arms[0][1] if arms and arms[0][0] == Const(True) else [Choice(arms)] if arms else []
        elif isinstance(node, (Loop, Learn)):
            new = [type(node)(_simplify(node.body))]
        else:
            new = [node]
        for n in new:
            if isinstance(n, Print) and isinstance(n.value, Const):
                if out and isinstance(out[-1], Print) and isinstance(out[-1].value, Const):
                    out[-1] = Print(Const(str(out[-1].value.value) + str(n.value.value)))
                    continue
                if n.value.value == "":
                    continue
            out.append(n)
    return out


# closures ----------------------------------------------------------------------------------


class _Out:
    """Collects text and the stretches under the generation mark."""

    def __init__(self, at: int):
        self.parts: list[str] = []
        self.at, self.spans = at, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def _value(node, filters) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope[name]
    args = [_value(a, filters) for a in node.args]
    if node.op == "not":
        return lambda scope: not args[0](scope)
    if node.op in _BINARY:
        combine = _BINARY[node.op]
        return lambda scope: combine(args[0](scope), args[1](scope))
    apply = filters[node.op]
    return lambda scope: apply(str(args[0](scope)))


def _block(nodes: list, filters) -> Callable[[dict, _Out], None]:
    steps = [_step(n, filters) for n in nodes]

    def run(scope: dict, out: _Out) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node, filters) -> Callable[[dict, _Out], None]:
    if isinstance(node, Print):
        value = _value(node.value, filters)
        return lambda scope, out: out.write(str(value(scope)))
    if isinstance(node, Learn):
        body = _block(node.body, filters)

        def learn(scope: dict, out: _Out) -> None:
            start = out.at
            body(scope, out)
            out.spans.append((start, out.at))

        return learn
    arms = [(_value(test, filters), _block(body, filters)) for test, body in node.arms]

    def choose(scope: dict, out: _Out) -> None:
        for test, body in arms:
            if test(scope):
                body(scope, out)
                return

    return choose


class Template:
    """A compiled template; renders a conversation piece by piece, one piece per message."""

    def __init__(self, source: str, escape: Callable[[str], str]):
        self.filters = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
        nodes = parse(source, self.filters)
        loops = [i for i, n in enumerate(nodes) if isinstance(n, Loop)]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages")
        at = loops[0]
        self._head, self._each, self._tail = (_block(b, self.filters) for b in (nodes[:at], nodes[at].body, nodes[at + 1 :]))

    def pieces(self, messages: Iterable[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """``text, spans`` per (role, text); spans are places in the whole conversation.

        What stands before and after the loop belongs to the first and last piece.  Only
        one message is looked ahead, so conversations of any length are streamed.
        """
        at, first, held = 0, True, None
        for message in messages:
            if held is not None:
                piece, spans, at = self._piece(held, first, False, at)
                yield piece, spans
                first = False
            held = message
        if held is not None:
            piece, spans, at = self._piece(held, first, True, at)
            yield piece, spans

    def _piece(self, message: tuple[str, str], first: bool, last: bool, at: int):
        out = _Out(at)
        scope = {"m.role": message[0], "m.text": message[1], "loop.first": first, "loop.last": last}
        if first:
            self._head(scope, out)
        self._each(scope, out)
        if last:
            self._tail(scope, out)
        return "".join(out.parts), out.spans, out.at

    def render(self, messages: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        pieces = list(self.pieces(messages))
        return "".join(p for p, _ in pieces), [s for _, spans in pieces for s in spans]
