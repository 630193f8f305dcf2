"""A small sandboxed template language, compiled to Python closures.

Text, `{{ expression }}`, and the statements for, if / elif / else, set, and generation (whose output is
marked). Expressions have or, and, not, comparisons, in, + - * // % ~, attributes and items, literals,
filters and the test `is defined`. Sandboxed: attributes read keys of dictionaries only, no Python attribute
can be reached, and only the filters given can be called. Parsing gives a syntax tree of tuples; constant
expressions, constant branches and neighbouring texts are folded; closures are made from what is left.
Rendering yields pieces as they come, so messages may be an iterator that is read once.

Defined results: a name that is not set prints nothing and is false; nulls print nothing; anything outside
the language raises TemplateError while compiling; operands of wrong kinds raise it while rendering.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

#: Kinds of pieces that rendering yields.
TEXT, BEGIN, END = 0, 1, 2

_PARTS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[<>+\-*%~|.,()\[\]=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


class Missing:
    """What a name that is not set evaluates to."""

    def __bool__(self) -> bool:
        return False

    def __iter__(self) -> Iterator:
        return iter(())


MISSING = Missing()


def shown(value: Any) -> str:
    if value is None or value is MISSING:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: shown(v).strip(),
    "upper": lambda v: shown(v).upper(),
    "lower": lambda v: shown(v).lower(),
    "length": lambda v: len(v),
    "default": lambda v, other: other if v is MISSING or v is None else v,
    "string": shown,
}


# --- parsing -------------------------------------------------------------------------------------------------


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "num":
            value = int(value)
        elif kind == "str":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
        out.append((kind, value))
        at = m.end()
    return out


class _Expressions:
    """Recursive descent over the tokens of one expression; nodes are tuples that start with their kind."""

    #: Binary operators by rising strength.
    LEVELS = (("or",), ("and",), None, ("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%"))

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _tokens(source), 0

    def peek(self, k: int = 0) -> Any:
        kind, value = self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", None)
        return value if kind in ("op", "name") else (kind,)

    def take(self, value: Any = None) -> tuple[str, Any]:
        if self.at >= len(self.tokens) or value is not None and self.peek() != value:
            raise TemplateError(f"expected {value or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name":
            raise TemplateError(f"expected a name, not {value!r}")
        return value

    def ended(self, node: Any) -> Any:
        if self.at != len(self.tokens):
            raise TemplateError(f"cannot read {self.tokens[self.at][1]!r}")
        return node

    def expression(self, level: int = 0) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        if self.LEVELS[level] is None:
            if self.peek() == "not":
                self.take()
                return ("not", self.expression(level))
            return self.expression(level + 1)
        left = self.expression(level + 1)
        while True:
            op = "not in" if self.peek() == "not" and self.peek(1) == "in" else self.peek()
            if level == 3 and op == "is":
                left = self.test(left)
            elif op in self.LEVELS[level]:
                self.at += 2 if op == "not in" else 1
                left = ("op", op, left, self.expression(level + 1))
            else:
                return left

    def test(self, left: tuple) -> tuple:
        self.take("is")
        negated = self.peek() == "not" and bool(self.take())
        self.take("defined")
        return ("not", ("defined", left)) if negated else ("defined", left)

    def unary(self) -> tuple:
        if self.peek() == "-":
            self.take()
            return ("op", "-", ("const", 0), self.unary())
        node = self.primary()
        while (op := self.peek()) in (".", "[", "|"):
            self.take()
            if op == ".":
                node = ("item", node, ("const", self.name()))
            elif op == "[":
                node = ("item", node, self.expression())
                self.take("]")
            else:
                name, args = self.name(), []
                if self.peek() == "(":
                    self.take()
                    while self.peek() != ")":
                        args.append(self.expression())
                        if self.peek() == ",":
                            self.take()
                    self.take(")")
                node = ("filter", name, node, *args)
        return node

    def primary(self) -> tuple:
        kind, value = self.take()
        if kind in ("num", "str"):
            return ("const", value)
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        if value == "(":
            node = self.expression()
            self.take(")")
            return node
        raise TemplateError(f"cannot read {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", statement, ...)."""
    parts = _PARTS.split(source)
    for i in range(1, len(parts), 2):  # a dash strips the white space beside it
        if parts[i][2:3] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3:-2] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            part, is_tag = parts[at], at % 2
            at += 1
            if not is_tag:
                if part:
                    out.append(("text", part))
                continue
            body = part[2:-2].strip("-").strip()
            if part[:2] == "{{":
                e = _Expressions(body)
                out.append(("print", e.ended(e.expression())))
            elif part[:2] == "{%":
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("block", *out), body
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("block", *out), ""

    def whole(source: str) -> tuple:
        e = _Expressions(source)
        return e.ended(e.expression())

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            e = _Expressions(rest)
            name = e.name()
            e.take("in")
            over = e.ended(e.expression())
            return ("for", name, over, block(("endfor",))[0])
        if word == "if":
            test = whole(rest)
            then, end = block(("elif", "else", "endif"))
            if end.startswith("elif"):
                return ("if", test, then, ("block", statement("if", end[4:])))
            return ("if", test, then, block(("endif",))[0] if end == "else" else ("block",))
        if word == "set":
            e = _Expressions(rest)
            name = e.name()
            e.take("=")
            return ("set", name, e.ended(e.expression()))
        if word == "generation":
            return ("generation", block(("endgeneration",))[0])
        raise TemplateError(f"unknown statement {word!r}")

    return block(())[0]


# --- evaluation of single operators ---------------------------------------------------------------------------


def _operate(op: str, x: Any, y: Any) -> Any:
    try:
        match op:
            case "~":
                return shown(x) + shown(y)
            case "==":
                return x == y
            case "!=":
                return x != y
            case "in":
                return x in y
            case "not in":
                return x not in y
            case "<":
                return x < y
            case ">":
                return x > y
            case "<=":
                return x <= y
            case ">=":
                return x >= y
            case "+":
                return x + y
            case "-":
                return x - y
            case "//":
                return x // y
            case "*" if isinstance(x, int) and isinstance(y, int):  # no repeated strings
                return x * y
            case "%" if isinstance(x, int) and isinstance(y, int):  # no formatting
                return x % y
    except (TypeError, ZeroDivisionError) as e:
        raise TemplateError(str(e)) from e
    raise TemplateError(f"{op} of wrong kinds")


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key, MISSING)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return MISSING


# --- folding -------------------------------------------------------------------------------------------------


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant parts worked out. What raises is left for rendering."""
    kind = node[0]
    if kind == "block":
        out: list[tuple] = []
        for s in (fold(x, filters) for x in node[1:]):
            for t in s[1:] if s[0] == "block" else (s,):
                if t[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + t[1])
                elif t != ("text", ""):
                    out.append(t)
        return ("block", *out)
    if kind == "if":
        test, then, other = (fold(x, filters) for x in node[1:])
        return (then if test[1] else other) if test[0] == "const" else ("if", test, then, other)
    if kind == "op" and node[1] in ("and", "or"):
        left, right = fold(node[2], filters), fold(node[3], filters)
        if left[0] != "const":
            return ("op", node[1], left, right)
        return right if bool(left[1]) == (node[1] == "and") else left
    node = (kind, *(fold(x, filters) if isinstance(x, tuple) else x for x in node[1:]))
    parts = [x for x in node[1:] if isinstance(x, tuple)]
    if kind in ("op", "not", "filter", "item", "defined", "print") and all(x[0] == "const" for x in parts):
        try:
            match node:
                case ("op", op, x, y):
                    return ("const", _operate(op, x[1], y[1]))
                case ("not", x):
                    return ("const", not x[1])
                case ("defined", _):
                    return ("const", True)
                case ("print", x):
                    return ("text", shown(x[1]))
                case ("filter", name, *args) if name in filters:
                    return ("const", filters[name](*(x[1] for x in args)))
        except Exception:  # noqa: BLE001  the same happens, if at all, while rendering
            return node
    return node


# --- closures ------------------------------------------------------------------------------------------------


def _value(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    match node:
        case ("const", value):
            return lambda scope: value
        case ("name", name):
            return lambda scope: scope.get(name, MISSING)
        case ("item", ("name", name), ("const", key)):
            return lambda scope: _item(scope.get(name, MISSING), key)
        case ("item", of, key):
            f, g = _value(of, filters), _value(key, filters)
            return lambda scope: _item(f(scope), g(scope))
        case ("not", x):
            f = _value(x, filters)
            return lambda scope: not f(scope)
        case ("defined", x):
            f = _value(x, filters)
            return lambda scope: f(scope) is not MISSING
        case ("op", "and", x, y):
            f, g = _value(x, filters), _value(y, filters)
            return lambda scope: f(scope) and g(scope)
        case ("op", "or", x, y):
            f, g = _value(x, filters), _value(y, filters)
            return lambda scope: f(scope) or g(scope)
        case ("op", op, x, y):
            f, g = _value(x, filters), _value(y, filters)
            return lambda scope: _operate(op, f(scope), g(scope))
        case ("filter", name, *args):
            if name not in filters:
                raise TemplateError(f"unknown filter {name!r}")
            call, fs = filters[name], [_value(a, filters) for a in args]

            def filtered(scope: dict) -> Any:
                try:
                    return call(*(f(scope) for f in fs))
                except TypeError as e:
                    raise TemplateError(f"{name}: {e}") from e

            return filtered
    raise TemplateError(f"cannot compile {node[0]!r}")


def _runner(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Iterator[tuple[int, str]]]:
    match node:
        case ("text", text):
            piece = (TEXT, text)

            def run_text(scope: dict) -> Iterator[tuple[int, str]]:
                yield piece

            return run_text
        case ("print", x):
            value = _value(x, filters)

            def run_print(scope: dict) -> Iterator[tuple[int, str]]:
                yield TEXT, shown(value(scope))

            return run_print
        case ("set", name, x):
            value = _value(x, filters)

            def run_set(scope: dict) -> Iterator[tuple[int, str]]:
                scope[name] = value(scope)
                yield from ()

            return run_set
        case ("block", *parts):
            runs = [_runner(p, filters) for p in parts]

            def run_block(scope: dict) -> Iterator[tuple[int, str]]:
                for run in runs:
                    yield from run(scope)

            return run_block
        case ("if", test, then, other):
            value, yes, no = _value(test, filters), _runner(then, filters), _runner(other, filters)
            return lambda scope: yes(scope) if value(scope) else no(scope)
        case ("generation", body):
            run = _runner(body, filters)

            def run_generation(scope: dict) -> Iterator[tuple[int, str]]:
                yield BEGIN, ""
                yield from run(scope)
                yield END, ""

            return run_generation
        case ("for", name, over, body):
            value, run = _value(over, filters), _runner(body, filters)

            def run_for(scope: dict) -> Iterator[tuple[int, str]]:
                outer = {n: scope.get(n, MISSING) for n in (name, "loop")}
                items = iter(value(scope))
                index, item = 0, next(items, MISSING)
                while item is not MISSING:
                    following = next(items, MISSING)
                    scope[name], scope["loop"] = item, {"index": index + 1, "index0": index, "first": index == 0, "last": following is MISSING}
                    yield from run(scope)
                    index, item = index + 1, following
                scope.update(outer)

            return run_for
    raise TemplateError(f"cannot compile {node[0]!r}")


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], Iterator[tuple[int, str]]]:
    """render(scope) -> pieces (kind, text): kind TEXT, or BEGIN and END around generated text."""
    known = FILTERS | (filters or {})
    run = _runner(fold(parse(source), known), known)
    return lambda scope: run(dict(scope))
