r"""A sandboxed template language for chat formats, compiled to Python closures.

    {{ expression }}                              its value, null as nothing
    {% for m in messages %} .. {% endfor %}       the turns, in order; once, at the top level
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set name = expression %}
    {% generation %} .. {% endgeneration %}       marks what the model learns to write
    {# a comment #}                               {%- and -%} strip white space beside a tag

Expressions have strings, whole numbers, true, false, none, names, fields (m.role, m['role']),
``==``, ``!=``, ``in``, ``not``, ``and``, ``or``, ``~`` (joins texts), brackets and filters
(``m.text | escape``). In a loop ``loop`` has first, last, index and index0.

The sandbox is the language: fields are looked up in the turn's own mapping and never in Python
objects, filters come from the given table, nothing can be called, and loops end with the turns.
Turns are a stream of which one is looked ahead, so a conversation of any length takes
constant memory.

Compiling parses the text to a syntax tree, folds what is constant (joined literals,
comparisons, branches never taken, filters of literals, neighbouring texts) and nests a closure
for each node that is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

__all__ = ["Output", "Template", "TemplateError", "escaper", "fold", "parse"]

TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
WORD = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|().\[\]=]))")
UNQUOTED = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}
KEYWORDS = {"and", "or", "not", "in", *CONSTANTS}
STREAM = "messages"


class TemplateError(ValueError):
    """A template that can't be compiled, or a name or field that it asks for in vain."""


# --- syntax tree: tuples of a kind and its parts ---
#   expressions: ("const", v) ("name", n) ("field", e, n) ("filter", n, e) ("not", e) (operator, a, b)
#   statements:  ("text", s) ("show", e) ("set", n, e) ("if", [(e, body)], body) ("for", n, body) ("generation", body)


class _Words:
    """The words of an expression, with one looked ahead."""

    def __init__(self, text: str) -> None:
        self.text, self.words, at = text, [], 0
        while text[at:].strip():
            m = WORD.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:].strip()!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.words[self.at] if self.at < len(self.words) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.words[self.at - 1] if self.at <= len(self.words) else ("end", "")

    def took(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.took(value):
            raise TemplateError(f"{value!r} is missing in {self.text!r}")

    def name(self) -> str:
        kind, value = self.next()
        if kind != "name" or value in KEYWORDS:
            raise TemplateError(f"a name is missing in {self.text!r}")
        return value

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"{self.peek()[1]!r} is unexpected in {self.text!r}")


#: Operators from the loosest to the tightest.
LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "in"), ("~",))


def _expression(w: _Words, level: int = 0) -> tuple:
    if level == len(LEVELS):
        return _filtered(w)
    if LEVELS[level] == ("not",):
        return ("not", _expression(w, level)) if w.took("not") else _expression(w, level + 1)
    left = _expression(w, level + 1)
    while op := w.took(*LEVELS[level]):
        left = (op, left, _expression(w, level + 1))
    return left


def _filtered(w: _Words) -> tuple:
    e = _primary(w)
    while w.took("|"):
        e = ("filter", w.name(), e)
    return e


def _primary(w: _Words) -> tuple:
    kind, value = w.next()
    if kind == "str":
        e: tuple = ("const", re.sub(r"\\(.)", lambda m: UNQUOTED.get(m[1], m[1]), value[1:-1], flags=re.S))
    elif kind == "int":
        e = ("const", int(value))
    elif kind == "name" and value in CONSTANTS:
        e = ("const", CONSTANTS[value])
    elif kind == "name" and value not in KEYWORDS:
        e = ("name", value)
    elif (kind, value) == ("op", "("):
        e = _expression(w)
        w.need(")")
    else:
        raise TemplateError(f"a value is missing in {w.text!r}")
    while op := w.took(".", "["):
        if op == ".":
            e = ("field", e, w.name())
        else:
            kind, value = w.next()
            if kind != "str":
                raise TemplateError(f"a field's name is a string: {w.text!r}")
            e = ("field", e, value[1:-1])
            w.need("]")
    return e


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(text, show or do, content), with the white space that tags strip gone."""
    at, strip = 0, False
    for m in TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if m[1] or m[4] or m[7] else text
        at, strip = m.end(), bool(m[3] or m[6] or m[8])
        if m[2] is not None:
            yield "show", m[2]
        elif m[5] is not None:
            yield "do", m[5]
    yield "text", source[at:].lstrip() if strip else source[at:]


def parse(source: str) -> list[tuple]:
    """The statements of a template."""
    pieces = list(_pieces(source))[::-1]

    def block(*ends: str) -> tuple[list[tuple], str, _Words | None]:
        body: list[tuple] = []
        while pieces:
            kind, content = pieces.pop()
            if kind == "text":
                body += [("text", content)] if content else []
                continue
            w = _Words(content)
            if kind == "show":
                body.append(("show", _expression(w)))
                w.end()
                continue
            word = w.next()[1]
            if word in ends:
                return body, word, w
            body.append(statement(word, w))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return body, "", None

    def statement(word: str, w: _Words) -> tuple:
        if word == "set":
            name = w.name()
            w.need("=")
            node: tuple = ("set", name, _expression(w))
            w.end()
        elif word == "for":
            name = w.name()
            w.need("in")
            w.need(STREAM)
            w.end()
            node = ("for", name, block("endfor")[0])
        elif word == "generation":
            w.end()
            node = ("generation", block("endgeneration")[0])
        elif word == "if":
            branches, rest = [], []
            while True:
                test = _expression(w) if word != "else" else None
                w.end()
                body, end, w = block("elif", "else", "endif") if test else block("endif")
                if test:
                    branches.append((test, body))
                else:
                    rest = body
                if end == "endif":
                    break
                word = end
            node = ("if", branches, rest)
        else:
            raise TemplateError(f"no statement {word!r}")
        return node

    body = block()[0]

    def rules(body: list[tuple], top: bool, marked: bool) -> int:
        loops = 0
        for node in body:
            if node[0] == "for":
                if not top:
                    raise TemplateError("the loop over messages stands at the top level")
                loops += 1
                rules(node[2], False, marked)
            elif node[0] == "generation":
                if marked:
                    raise TemplateError("a generation inside another")
                rules(node[1], False, True)
            elif node[0] == "if":
                for part in (*(b for _, b in node[1]), node[2]):
                    rules(part, False, marked)
        return loops

    if rules(body, True, False) > 1:
        raise TemplateError("messages is a stream: it can be looped over once")
    return body


# --- constant folding ---

OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: _text(a) in _text(b),
    "~": lambda a, b: _text(a) + _text(b),
}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _fold_expression(e: tuple, filters: Mapping[str, Callable[[str], str]]) -> tuple:
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "field":
        return ("field", _fold_expression(e[1], filters), e[2])
    if kind == "filter":
        if e[1] not in filters:
            raise TemplateError(f"no filter {e[1]!r}")
        inner = _fold_expression(e[2], filters)
        return ("const", filters[e[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", e[1], inner)
    if kind == "not":
        inner = _fold_expression(e[1], filters)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = _fold_expression(e[1], filters), _fold_expression(e[2], filters)
    if kind in ("and", "or"):
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if a[0] == b[0] == "const":
        return ("const", OPERATORS[kind](a[1], b[1]))
    if kind == "~" and b[0] == "const" and a[0] == "~" and a[2][0] == "const":
        return ("~", a[1], ("const", _text(a[2][1]) + _text(b[1])))
    return (kind, a, b)


def fold(body: list[tuple], filters: Mapping[str, Callable[[str], str]]) -> list[tuple]:
    """The statements with all constants worked out and neighbouring texts joined."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        new: list[tuple] = [node]
        if kind == "show":
            e = _fold_expression(node[1], filters)
            new = [("text", _text(e[1]))] if e[0] == "const" else [("show", e)]
        elif kind == "set":
            new = [("set", node[1], _fold_expression(node[2], filters))]
        elif kind == "for":
            new = [("for", node[1], fold(node[2], filters))]
        elif kind == "generation":
            new = [("generation", fold(node[1], filters))]
        elif kind == "if":
            branches, rest = [], fold(node[2], filters)
            for test, own in node[1]:
                e = _fold_expression(test, filters)
                if e[0] != "const":
                    branches.append((e, fold(own, filters)))
                elif e[1]:
                    rest = fold(own, filters)
                    break
            new = [("if", branches, rest)] if branches else rest
        for part in new:
            if part == ("text", ""):
                continue
            if part[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + part[1])
            else:
                out.append(part)
    return out


# --- closures ---


@dataclass
class Output:
    """What is written so far, since the last take(): pieces of text and the marked spans."""

    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans in it; what follows starts anew."""
        text, spans = "".join(self.pieces), self.spans
        self.pieces, self.spans, self.size = [], [], 0
        return text, spans


Value = Callable[[dict], Any]
Action = Callable[[dict, Output], None]


def _value(e: tuple, filters: Mapping[str, Callable[[str], str]]) -> Value:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":

        def name(env: dict, n: str = e[1]) -> Any:
            if n not in env:
                raise TemplateError(f"no name {n!r}")
            return env[n]

        return name
    if kind == "field":

        def get(env: dict, of: Value = _value(e[1], filters), n: str = e[2]) -> Any:
            own = of(env)
            if not isinstance(own, dict) or n not in own:
                raise TemplateError(f"no field {n!r}")
            return own[n]

        return get
    if kind == "filter":
        return lambda env, f=filters[e[1]], of=_value(e[2], filters): f(_text(of(env)))
    if kind == "not":
        return lambda env, of=_value(e[1], filters): not of(env)
    a, b = _value(e[1], filters), _value(e[2], filters)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=OPERATORS[kind]: f(a(env), b(env))


def _action(node: tuple, filters: Mapping[str, Callable[[str], str]]) -> Action:
    kind = node[0]
    if kind == "text":
        return lambda env, out, s=node[1]: out.write(s)
    if kind == "show":
        return lambda env, out, of=_value(node[1], filters): out.write(_text(of(env)))
    if kind == "set":

        def put(env: dict, out: Output, n: str = node[1], of: Value = _value(node[2], filters)) -> None:
            env[n] = of(env)

        return put
    if kind == "generation":

        def marked(env: dict, out: Output, inner: Action = _sequence(node[1], filters)) -> None:
            start = out.size
            inner(env, out)
            out.spans.append((start, out.size))

        return marked
    branches = [(_value(e, filters), _sequence(own, filters)) for e, own in node[1]]

    def choose(env: dict, out: Output, rest: Action = _sequence(node[2], filters)) -> None:
        for test, own in branches:
            if test(env):
                return own(env, out)
        return rest(env, out)

    return choose


def _sequence(body: list[tuple], filters: Mapping[str, Callable[[str], str]]) -> Action:
    actions = [_action(node, filters) for node in body]
    if len(actions) == 1:
        return actions[0]

    def run(env: dict, out: Output) -> None:
        for a in actions:
            a(env, out)

    return run


class Template:
    """A compiled template; render() may be used again and again."""

    def __init__(self, source: str, filters: Mapping[str, Callable[[str], str]] | None = None) -> None:
        filters = filters or {}
        tree = fold(parse(source), filters)
        at = next((i for i, node in enumerate(tree) if node[0] == "for"), None)
        self._before = _sequence(tree[:at] if at is not None else tree, filters)
        self._turn, self._body = (tree[at][1], _sequence(tree[at][2], filters)) if at is not None else (None, None)
        self._after = _sequence(tree[at + 1 :] if at is not None else [], filters)

    def render(self, messages: Iterable[dict], out: Output, names: Mapping[str, Any] | None = None) -> Iterator[None]:
        """Write to out; control comes back after each turn and at the end, so that a reader can take() parts."""
        env = dict(names or {})
        self._before(env, out)
        if self._body:
            turns, index = iter(messages), 0
            turn = next(turns, None)
            while turn is not None:
                after = next(turns, None)
                env[self._turn] = turn
                env["loop"] = {"first": index == 0, "last": after is None, "index": index + 1, "index0": index}
                self._body(env, out)
                yield
                turn, index = after, index + 1
        self._after(env, out)
        yield


def escaper(controls: tuple[str, ...]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    r"""escape, unescape: a backslash goes behind the first character of each control string in a text.

    One that has backslashes there already gets one more, so unescape(escape(t)) == t for all
    t, and no control string is left in an escaped text. First characters must not occur
    further on in a control string: then none can arise where a text meets a template either.
    """
    first = {c[0] for c in controls}
    if any(x in first or x == "\\" for c in controls for x in c[1:]) or "\\" in first:
        raise ValueError("a control string starts with a character that none has further on, and has no backslash")
    rest = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in controls)
    more, less = re.compile(rest), re.compile(rest.replace("\\\\*", "\\\\+"))
    return lambda t: more.sub(lambda m: m[0][0] + "\\" + m[0][1:], t), lambda t: less.sub(lambda m: m[0][0] + m[0][2:], t)
