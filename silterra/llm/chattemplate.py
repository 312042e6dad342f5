"""Chat formatting by a compiler of a sandboxed template language.

``parse`` makes a syntax tree of a template, ``fold`` evaluates its constant parts, drops branches that can't be taken and joins
neighbouring text, and ``compile_template`` turns the tree into nested Python closures; no Python source is made or run. A compiled
template renders a list of messages to a text and the character spans that ``{% generation %}`` blocks wrote.

The language: ``{{ expression }}``, ``{# comment #}``, ``{% if %}`` with ``elif`` and ``else``, ``{% for x in list %}`` with ``else`` and
``loop.index``, ``index0``, ``first``, ``last``, ``length``, ``previtem``, ``nextitem``, ``{% set x = expression %}``, ``{% generation %}``, and
a minus sign in a tag to strip white space beside it, ``{% macro f(x, y='z') %}`` and ``{% set ns.x = expression %}`` of a ``namespace(x=1)``, which is how a
``set`` within a loop lasts longer than its turn. Expressions have strings, numbers, lists, ``true``, ``false``, ``none``,
``or and not``, comparisons, ``in``, ``is [not]`` the tests of ``_TESTS``, ``+ - * / // %``, ``~``, ``x if c else y``, ``a.key``, ``a[key]``,
slices, the filters of ``FILTERS``, the methods of ``METHODS`` and calls of ``namespace``, ``dict``, ``raise_exception`` and macros.
The sandbox: names are the variables given, keys are those of mappings and lists, numbers alone are multiplied, strings end at ``LONGEST`` characters, what can be
called is that closed list, and a macro knows only those before it, so a template can't reach Python's objects, run for ever or blow a string up.
Generation blocks within macros have no spans. With ``blocks`` a statement tag's line break and the white space before it on its line are dropped.

Defined results for rows: a conversation is the rows of one ``conv_id``, null ones being one conversation too, in order of ``turn`` (nulls
first), then role and text; repeated rows are repeated turns. A message has ``role``, ``text`` and the same as ``content``; null ones are empty. An unknown name or key
is undefined: it renders as nothing and counts as false. A conversation for which the template calls ``raise_exception``, or that gets too long, renders as null without
spans and stops no job. Other columns are not touched. An empty table has no conversations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silterra.session import prepare

CHATML = (
    "{% for message in messages %}<|im_start|>{{ message.role }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text }}<|im_end|>{% endgeneration %}{% else %}{{ message.text }}<|im_end|>{% endif %}\n{% endfor %}"
)


#: Characters of a string at most.
LONGEST = 1 << 26


class TemplateError(ValueError):
    pass


class RenderError(TemplateError):
    """Of one conversation, not of the template."""


def _fail(*message: Any) -> Any:
    raise RenderError(" ".join(map(_text, message)))


class Namespace(dict):
    """What ``{% set ns.x = y %}`` may change."""


class Undefined:
    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


UNDEFINED = Undefined()


def _text(x: Any) -> str:
    return "" if x is None or x is UNDEFINED else x if isinstance(x, str) else ("True" if x else "False") if isinstance(x, bool) else str(x)


def _length(x: Any) -> int:
    return len(x) if isinstance(x, (str, list, dict)) else 0


def _items(x: Any) -> list:
    return x if isinstance(x, list) else []


def _attribute(x: Any, key: Any, test: Any, value: Any) -> bool:
    mine = _get(x, key)
    if test in _TESTS:
        return _TESTS[test](mine)
    if test in ("equalto", "eq", "=="):
        return mine == value
    return bool(_binary("in", mine, value)) if test == "in" else mine != value if test in ("ne", "!=") else bool(mine)


def _split(x: str, by: Any = None, most: Any = -1) -> list:
    return x.split(by or None, most if isinstance(most, int) else -1) if by is None or isinstance(by, str) else [x]


#: By the type of what has the method.
METHODS: dict[str, tuple[type, Callable[..., Any]]] = {
    "startswith": (str, lambda x, y: x.startswith(_text(y))),
    "endswith": (str, lambda x, y: x.endswith(_text(y))),
    "strip": (str, lambda x, y=None: x.strip(y if isinstance(y, str) else None)),
    "lstrip": (str, lambda x, y=None: x.lstrip(y if isinstance(y, str) else None)),
    "rstrip": (str, lambda x, y=None: x.rstrip(y if isinstance(y, str) else None)),
    "upper": (str, lambda x: x.upper()),
    "lower": (str, lambda x: x.lower()),
    "title": (str, lambda x: x.title()),
    "capitalize": (str, lambda x: x.capitalize()),
    "split": (str, _split),
    "replace": (str, lambda x, old, new: FILTERS["replace"](x, old, new)),
    "items": (dict, lambda x: [list(p) for p in x.items()]),
    "keys": (dict, lambda x: list(x)),
    "values": (dict, lambda x: list(x.values())),
    "get": (dict, lambda x, key, other=None: _get(x, key) if _get(x, key) is not UNDEFINED else other),
}


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "capitalize": lambda x: _text(x).capitalize(),
    "length": _length,
    "string": _text,
    "first": lambda x: x[0] if isinstance(x, (str, list)) and x else UNDEFINED,
    "last": lambda x: x[-1] if isinstance(x, (str, list)) and x else UNDEFINED,
    "default": lambda x, other="": other if x is UNDEFINED else x,
    "join": lambda x, by="": _text(by).join(map(_text, x)) if isinstance(x, (str, list)) else "",
    "replace": lambda x, old, new: _text(x).replace(_text(old), _text(new)) if _text(old) else _text(x),
    "list": lambda x: list(x) if isinstance(x, (list, str, dict)) else [],
    "selectattr": lambda x, key, test="true", value=None: [m for m in _items(x) if _attribute(m, key, test, value)],
    "rejectattr": lambda x, key, test="true", value=None: [m for m in _items(x) if not _attribute(m, key, test, value)],
    "tojson": lambda x: json.dumps(None if x is UNDEFINED else x, ensure_ascii=False),
}


# Syntax tree. An expression is (kind, ...); statements are the classes below.
@dataclass
class Text:
    text: str


@dataclass
class Output:
    value: tuple


@dataclass
class If:
    branches: list[tuple[tuple, list]]
    other: list = field(default_factory=list)


@dataclass
class For:
    names: list[str]
    over: tuple
    body: list
    other: list = field(default_factory=list)


@dataclass
class Set:
    name: str
    value: tuple
    key: str | None = None


@dataclass
class Macro:
    name: str
    parameters: list[tuple[str, tuple]]
    body: list


@dataclass
class Generation:
    body: list


_TAG = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*/%~<>()\[\].,|:=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


def _lex(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        number, string, name, sign = m.groups()
        if number:
            out.append(("const", float(number) if "." in number else int(number)))
        elif string:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], "\\" + e[1]), string[1:-1], flags=re.S)))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("name expected")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> tuple:
        value = self.expression()
        self.end()
        return value

    def expression(self) -> tuple:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.expression() if self.take("else") else ("const", UNDEFINED)
            return ("if", test, value, other)
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        while True:
            for sign in ("==", "!=", "<=", ">=", "<", ">", "in"):
                if self.take(sign):
                    left = ("binary", sign, left, self.sum())
                    break
            else:
                if self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("name", "in"):
                    self.at += 2
                    left = ("not", ("binary", "in", left, self.sum()))
                elif self.take("is"):
                    flip = self.take("not")
                    test = ("test", self.name(), left)
                    if test[1] not in _TESTS:
                        raise TemplateError(f"unknown test {test[1]!r}")
                    left = ("not", test) if flip else test
                else:
                    return left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek("+", "-", "~"):
            self.at += 1
            left = ("binary", self.tokens[self.at - 1][1], left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while self.peek("*", "/", "//", "%"):
            self.at += 1
            left = ("binary", self.tokens[self.at - 1][1], left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.take("-"):
            return ("binary", "-", ("const", 0), self.unary())
        return self.postfix()

    def postfix(self) -> tuple:
        value = self.atom()
        while True:
            if self.take("."):
                value = ("get", value, ("const", self.name()))
            elif self.take("["):
                if self.peek(":"):
                    low: tuple = ("const", None)
                else:
                    low = self.expression()
                if self.take(":"):
                    high = ("const", None) if self.peek("]") else self.expression()
                    value = ("slice", value, low, high)
                else:
                    value = ("get", value, low)
                self.need("]")
            elif self.take("|"):
                name, arguments = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        arguments.append(self.expression())
                        if not self.peek(")"):
                            self.need(",")
                value = ("filter", name, value, *arguments)
            elif self.take("("):
                positional, named = self.arguments()
                if value[0] == "name":
                    value = ("call", value[1], list(named), *positional, *named.values())
                elif value[0] == "get" and value[2][0] == "const" and value[2][1] in METHODS and not named:
                    value = ("method", value[2][1], value[1], *positional)
                else:
                    raise TemplateError("only functions and methods of the language can be called")
            else:
                return value

    def arguments(self) -> tuple[list[tuple], dict[str, tuple]]:
        positional: list[tuple] = []
        named: dict[str, tuple] = {}
        while not self.take(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("sign", "="):
                name = self.name()
                self.at += 1
                named[name] = self.expression()
            else:
                positional.append(self.expression())
            if not self.peek(")"):
                self.need(",")
        return positional, named

    def atom(self) -> tuple:
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if not self.peek("]"):
                    self.need(",")
            return ("list", *items)
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name":
            return ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


_TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda x: x is not UNDEFINED,
    "undefined": lambda x: x is UNDEFINED,
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "mapping": lambda x: isinstance(x, dict),
    "iterable": lambda x: isinstance(x, (str, list, dict)),
    "sequence": lambda x: isinstance(x, (str, list, dict)),
    "boolean": lambda x: isinstance(x, bool),
    "true": lambda x: x is True,
    "false": lambda x: x is False,
}


def _pieces(source: str, blocks: bool) -> Iterator[tuple[str, str]]:
    """``(kind, content)`` of text, output and statement tags, white space stripped where a tag or ``blocks`` says so."""
    at, strip, drop = 0, False, False
    for m in _TAG.finditer(source):
        tag, text = m[0], source[at : m.start()]
        text = text.lstrip() if strip else text.removeprefix("\n") if drop else text
        if blocks and tag[1] != "{" and (at == 0 or "\n" in source[at : m.start()] or drop):
            line = text.rpartition("\n")
            text = line[0] + line[1] if not line[2].strip(" \t") else text
        yield "text", text.rstrip() if tag[2] == "-" else text
        strip, at, drop = tag[-3] == "-" and tag[1] != "#", m.end(), blocks and tag[1] != "{"
        if tag[1] != "#":
            yield ("output" if tag[1] == "{" else "tag"), tag[3 if tag[2] == "-" else 2 : -3 if tag[-3] == "-" else -2].strip()
    rest = source[at:].lstrip() if strip else source[at:].removeprefix("\n") if drop else source[at:]
    if re.search(r"\{[%{#]", rest):
        raise TemplateError("a tag isn't closed")
    yield "text", rest


def parse(source: str, blocks: bool = False) -> list:
    root: list = []
    open_: list[tuple[str, Any, list]] = [("", None, root)]
    for kind, content in _pieces(source, blocks):
        body = open_[-1][2]
        if kind == "text":
            if content:
                body.append(Text(content))
            continue
        if kind == "output":
            body.append(Output(_Expression(content).whole()))
            continue
        word, _, rest = content.partition(" ")
        if word == "if":
            node: Any = If([(_Expression(rest).whole(), [])])
            body.append(node)
            open_.append(("if", node, node.branches[0][1]))
        elif word == "elif" and open_[-1][0] == "if":
            node = open_.pop()[1]
            node.branches.append((_Expression(rest).whole(), []))
            open_.append(("if", node, node.branches[-1][1]))
        elif word == "else" and open_[-1][0] in ("if", "for"):
            kind_, node, _ = open_.pop()
            open_.append((kind_ + " else", node, node.other))
        elif word == "for":
            e = _Expression(rest)
            names = [e.name()]
            while e.take(","):
                names.append(e.name())
            e.need("in")
            node = For(names, e.whole(), [])
            body.append(node)
            open_.append(("for", node, node.body))
        elif word == "set":
            e = _Expression(rest)
            name = e.name()
            key = e.name() if e.take(".") else None
            e.need("=")
            body.append(Set(name, e.whole(), key))
        elif word == "macro":
            e = _Expression(rest)
            name, parameters = e.name(), []
            e.need("(")
            while not e.take(")"):
                parameters.append((e.name(), e.expression() if e.take("=") else ("const", UNDEFINED)))
                if not e.peek(")"):
                    e.need(",")
            e.end()
            node = Macro(name, parameters, [])
            body.append(node)
            open_.append(("macro", node, node.body))
        elif word == "generation" and not rest:
            node = Generation([])
            body.append(node)
            open_.append(("generation", node, node.body))
        elif content in ("endif", "endfor", "endgeneration", "endmacro") and open_[-1][0].split(" ")[0] == word[3:]:
            open_.pop()
        else:
            raise TemplateError(f"unexpected {{% {content} %}}")
    if len(open_) > 1:
        raise TemplateError(f"{{% {open_[-1][0]} %}} isn't closed")
    return root


def _number(x: Any) -> bool:
    return isinstance(x, (int, float))


def _joined(a: Any, b: Any) -> Any:
    if len(a) + len(b) > LONGEST:
        raise RenderError("a string is too long")
    return a + b


def _binary(sign: str, a: Any, b: Any) -> Any:
    if sign == "~":
        return _joined(_text(a), _text(b))
    if sign == "==":
        return a == b
    if sign == "!=":
        return a != b
    if sign == "in":
        return _text(a) in b if isinstance(b, str) else a in b if isinstance(b, (list, dict)) and not isinstance(a, (list, dict)) else False
    if sign == "+" and isinstance(a, str) and isinstance(b, str) or sign == "+" and isinstance(a, list) and isinstance(b, list):
        return _joined(a, b)
    if sign in ("<", ">", "<=", ">="):
        if not (_number(a) and _number(b) or isinstance(a, str) and isinstance(b, str)):
            return False
        return a < b if sign == "<" else a > b if sign == ">" else a <= b if sign == "<=" else a >= b
    if not (_number(a) and _number(b)) or sign in ("/", "//", "%") and b == 0:
        return UNDEFINED
    if sign == "*" and max(abs(a), abs(b)) > 1 << 62:
        return UNDEFINED
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "//": lambda: a // b, "%": lambda: a % b}[sign]()


def _get(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key, UNDEFINED) if isinstance(key, (str, int, float, bool, type(None))) else UNDEFINED
    if isinstance(x, (list, str)) and isinstance(key, int) and -len(x) <= key < len(x):
        return x[key]
    return UNDEFINED


def _slice(x: Any, a: Any, b: Any) -> Any:
    whole = (int, type(None))
    return x[a:b] if isinstance(x, (list, str)) and isinstance(a, whole) and isinstance(b, whole) else UNDEFINED


Scope = dict[str, Any]
_FUNCTIONS: dict[str, Callable[..., Any]] = {"namespace": lambda **x: Namespace(x), "dict": lambda **x: x, "raise_exception": _fail}


class _Made:
    """A macro with the names known where it was made."""

    def __init__(self, parameters: list[tuple[str, Callable]], body: Callable, scope: Scope):
        self.parameters, self.body, self.scope = parameters, body, dict(scope)

    def __call__(self, *given: Any, **named: Any) -> str:
        names = [n for n, _ in self.parameters]
        if len(given) > len(names) or not named.keys() <= {*names[len(given) :]}:
            raise TypeError
        values = dict(zip(names, given)) | named
        out = _Out()
        self.body(self.scope | {n: values[n] if n in values else default(self.scope) for n, default in self.parameters}, out)
        return "".join(out.parts)


def _closure(e: tuple) -> Callable[[Scope], Any]:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda s: value
    if kind == "name":
        name = e[1]
        return lambda s: s.get(name, UNDEFINED)
    if kind == "get" and e[2][0] == "const":
        of, key = _closure(e[1]), e[2][1]
        return lambda s: _get(of(s), key)
    if kind == "binary":
        sign, a, b = e[1], _closure(e[2]), _closure(e[3])
        if sign == "==":
            return lambda s: a(s) == b(s)
        return lambda s: _binary(sign, a(s), b(s))
    if kind == "not":
        a = _closure(e[1])
        return lambda s: not a(s)
    if kind in ("and", "or"):
        a, b = _closure(e[1]), _closure(e[2])
        return (lambda s: a(s) and b(s)) if kind == "and" else (lambda s: a(s) or b(s))
    if kind == "if":
        c, a, b = map(_closure, e[1:])
        return lambda s: a(s) if c(s) else b(s)
    if kind == "test":
        test, a = _TESTS[e[1]], _closure(e[2])
        return lambda s: test(a(s))
    if kind == "filter":
        call, parts = FILTERS[e[1]], [_closure(x) for x in e[2:]]
        return lambda s: call(*[p(s) for p in parts])
    if kind == "method":
        (of, call), x, parts = METHODS[e[1]], _closure(e[2]), [_closure(a) for a in e[3:]]

        def method(s: Scope) -> Any:
            value = x(s)
            return call(value, *[p(s) for p in parts]) if isinstance(value, of) else UNDEFINED

        return method
    if kind == "call":
        name, keys, parts = e[1], e[2], [_closure(a) for a in e[3:]]
        split = len(parts) - len(keys)

        def run(s: Scope) -> Any:
            f = s.get(name) if isinstance(s.get(name), _Made) else _FUNCTIONS.get(name)
            if f is None:
                raise RenderError(f"{name} can't be called")
            values = [p(s) for p in parts]
            try:
                return f(*values[:split], **dict(zip(keys, values[split:], strict=True)))
            except TypeError as error:
                raise RenderError(f"{name} has other arguments") from error

        return run
    call, parts = {"get": _get, "slice": _slice, "list": lambda *x: list(x)}[kind], [_closure(x) for x in e[1:]]
    return lambda s: call(*[p(s) for p in parts])


def fold_expression(e: tuple) -> tuple:
    """e with its constant parts evaluated."""
    if e[0] in ("const", "name"):
        return e
    e = tuple(fold_expression(x) if isinstance(x, tuple) else x for x in e)
    parts = [x for x in e[1:] if isinstance(x, tuple)]
    if e[0] == "call":
        return e
    if all(x[0] == "const" for x in parts):
        try:
            return ("const", _closure(e)({}))
        except TypeError as error:
            raise TemplateError(str(error)) from error
    if e[0] == "if" and e[1][0] == "const":
        return e[2] if e[1][1] else e[3]
    if e[0] in ("and", "or") and e[1][0] == "const":
        return e[2] if bool(e[1][1]) == (e[0] == "and") else e[1]
    return e


def fold(nodes: list) -> list:
    """Statements with constants folded, dead branches dropped and neighbouring texts joined."""
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not isinstance(node, Text) or node.text:
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            value = fold_expression(node.value)
            add(Text(_text(value[1])) if value[0] == "const" else Output(value))
        elif isinstance(node, If):
            branches, other = [], fold(node.other)
            for test, body in node.branches:
                test = fold_expression(test)
                if test[0] != "const":
                    branches.append((test, fold(body)))
                elif test[1]:
                    other = fold(body)
                    break
            if branches:
                add(If(branches, other))
            else:
                for x in other:
                    add(x)
        elif isinstance(node, For):
            add(For(node.names, fold_expression(node.over), fold(node.body), fold(node.other)))
        elif isinstance(node, Set):
            add(Set(node.name, fold_expression(node.value), node.key))
        elif isinstance(node, Macro):
            add(Macro(node.name, [(n, fold_expression(x)) for n, x in node.parameters], fold(node.body)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body)))
        else:
            add(node)
    return out


class _Out:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[list[int]] = []
        self.depth = 0

    def write(self, text: str) -> None:
        if self.size + len(text) > LONGEST:
            raise RenderError("a text is too long")
        self.parts.append(text)
        self.size += len(text)


Step = Callable[[Scope, _Out], None]


def _block(nodes: list) -> Step:
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(s: Scope, out: _Out) -> None:
        for step in steps:
            step(s, out)

    return run


def _step(node: Any) -> Step:
    if isinstance(node, Text):
        text = node.text
        return lambda s, out: out.write(text)
    if isinstance(node, Output):
        value = _closure(node.value)
        return lambda s, out: out.write(_text(value(s)))
    if isinstance(node, Set):
        name, value, key = node.name, _closure(node.value), node.key

        def assign(s: Scope, out: _Out) -> None:
            if key is None:
                s[name] = value(s)
            elif isinstance(s.get(name), Namespace):
                s[name][key] = value(s)
            else:
                raise RenderError(f"{name} isn't a namespace")

        return assign
    if isinstance(node, Macro):
        parameters, content = [(n, _closure(x)) for n, x in node.parameters], _block(node.body)

        def make(s: Scope, out: _Out) -> None:
            s[node.name] = _Made(parameters, content, s)

        return make
    if isinstance(node, If):
        branches, other = [(_closure(t), _block(b)) for t, b in node.branches], _block(node.other)

        def choose(s: Scope, out: _Out) -> None:
            for test, body in branches:
                if test(s):
                    return body(s, out)
            return other(s, out)

        return choose
    if isinstance(node, Generation):
        inside = _block(node.body)

        def mark(s: Scope, out: _Out) -> None:
            start, out.depth = out.size, out.depth + 1
            inside(s, out)
            out.depth -= 1
            if not out.depth:
                out.spans.append([start, out.size])

        return mark
    names, over, body, empty = node.names, _closure(node.over), _block(node.body), _block(node.other)

    def loop(s: Scope, out: _Out) -> None:
        items = over(s)
        items = list(items) if isinstance(items, (list, dict, str)) else []
        if not items:
            return empty(s, out)
        n = len(items)
        for i, x in enumerate(items):
            turn = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n, "previtem": items[i - 1] if i else UNDEFINED, "nextitem": items[i + 1] if i + 1 < n else UNDEFINED}
            if len(names) == 1:
                mine = {names[0]: x}
            elif isinstance(x, list) and len(x) == len(names):
                mine = dict(zip(names, x, strict=True))
            else:
                raise RenderError(f"{len(names)} names aren't had from one value")
            body({**s, **mine, "loop": turn}, out)
        return None

    return loop


def compile_template(source: str, blocks: bool = False) -> Callable[..., tuple[str, list[list[int]]]]:
    """A function of the template's variables that returns the text and the spans of its generation blocks, in order."""
    body = _block(fold(parse(source, blocks)))

    def render(**variables: Any) -> tuple[str, list[list[int]]]:
        out = _Out()
        body(dict(variables), out)
        return "".join(out.parts), out.spans

    return render


def format_conversations(turns: DataFrame, template: str = CHATML, blocks: bool = False, **variables: Any) -> DataFrame:
    """``(conv_id, n_turns, rendered, generated)`` of each conversation; generated is ``array<struct<start, end>>`` in characters of rendered."""
    compile_template(template, blocks)  # an error in it is the driver's
    prepare(turns.sparkSession)
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")).alias("m"))
    grouped = given.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    grouped = grouped.select("conv_id", F.col("messages.role").alias("roles"), F.col("messages.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, blocks)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            done: list[tuple[str | None, list[list[int]]]] = []
            for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    done.append(render(messages=[{"role": r or "", "text": t or "", "content": t or ""} for r, t in zip(roles, texts, strict=True)], **variables))
                except RenderError:
                    done.append((None, []))
            spans = [[{"start": a, "end": z} for a, z in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in b.column(1)], pa.int64()), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], ["conv_id", "n_turns", "rendered", "generated"])

    return grouped.mapInArrow(run, "conv_id long, n_turns long, rendered string, generated array<struct<start: long, end: long>>")


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations
), s AS (
  SELECT *, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body FROM t
), p AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY k) - length(body) - 1 AS pos FROM s
)
SELECT conv_id, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN pos::BIGINT || '-' || (pos + length(body))::BIGINT END, ' ' ORDER BY k), '') AS generated
FROM p GROUP BY conv_id
"""
