"""Templates: ``{{ expression }}`` in texts, rendered on the driver or compiled to a Spark column.

An expression has literals, names with ``.member``, ``[index]`` and ``['key']``,
calls with named arguments, filters (``x | name(arg=1)``, which bind tighter than
operators), tests (``x is defined``, ``x is not divisibleby(2)``), ``* / %``, ``+ -``,
``~`` (joins texts), comparisons, ``not``, ``and`` and ``or``. Integers stay integers; ``/`` gives a float.
"""

from __future__ import annotations

import html
import json
import os
import random
import re
import time
import unicodedata
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any
from urllib.parse import quote
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.errors import TemplateError

OPENING = re.compile(r"\{\{(.*?)\}\}", re.DOTALL)
_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'[^']*'|"[^"]*"|`[^`]*`)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>==|!=|<=|>=|[-+*/%~<>|.()\[\],=]))"""
)
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("~",), ("+", "-"), ("*", "/", "%"))


def has_template(text: str) -> bool:
    return bool(OPENING.search(text))


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str:
        kind, value = self.peek()
        if wanted and value not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted)} before {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        found = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"can't read {self.peek()[1]!r}")
        return found

    def level(self, n: int) -> tuple:
        if n == len(_LEVELS):
            return self.unary()
        if n == 2 and self.peek() == ("name", "not"):
            self.take()
            return ("not", self.level(2))
        left = self.level(n + 1)
        while self.peek()[1] in _LEVELS[n] and self.peek()[0] in ("op", "name"):
            left = ("op", self.take(), left, self.level(n + 1))
        return left

    def unary(self) -> tuple:
        if self.peek() == ("op", "-"):
            self.take()
            return ("op", "-", ("value", 0), self.unary())
        found = self.primary()
        while self.peek() == ("op", "|"):
            self.take()
            name = self.take()
            found = ("filter", name, found, self.arguments() if self.peek() == ("op", "(") else {})
        while self.peek() == ("name", "is"):
            self.take()
            against = self.peek() == ("name", "not")
            if against:
                self.take()
            found = ("test", self.take(), found, self.positional() if self.peek() == ("op", "(") else [])
            found = ("not", found) if against else found
        return found

    def positional(self) -> list[tuple]:
        self.take("(")
        found = []
        while self.peek() != ("op", ")"):
            found.append(self.level(0))
            if self.peek() == ("op", ","):
                self.take()
        self.take(")")
        return found

    def arguments(self) -> dict[str, tuple]:
        self.take("(")
        found: dict[str, tuple] = {}
        while self.peek() != ("op", ")"):
            name = self.take()
            self.take("=")
            found[name] = self.level(0)
            if self.peek() == ("op", ","):
                self.take()
        self.take(")")
        return found

    def primary(self) -> tuple:
        kind, value = self.peek()
        if kind == "num":
            self.take()
            return ("value", float(value) if "." in value else int(value))
        if kind == "str":
            self.take()
            return ("value", value[1:-1])
        if value == "(":
            self.take()
            found = self.level(0)
            self.take(")")
        elif value == "[":
            self.take()
            items = []
            while self.peek() != ("op", "]"):
                items.append(self.level(0))
                if self.peek() == ("op", ","):
                    self.take()
            self.take("]")
            found = ("list", items)
        elif kind == "name":
            self.take()
            if value.lower() in ("true", "false"):
                return ("value", value.lower() == "true")
            found = ("call", value, self.arguments()) if self.peek() == ("op", "(") else ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}" if value else "an expression is empty or ends early")
        while self.peek()[1] in (".", "[") and self.peek()[0] == "op":
            if self.take() == ".":
                kind, value = self.peek()
                self.take()
                found = ("get", found, ("value", int(value) if kind == "num" else value))
            else:
                found = ("get", found, self.level(0))
                self.take("]")
        return found


def parse(text: str) -> list[str | tuple]:
    """Texts and expression trees in turn."""
    found: list[str | tuple] = []
    last = 0
    for m in OPENING.finditer(text):
        if m.start() > last:
            found.append(text[last : m.start()])
        found.append(_Parser(m[1]).whole())
        last = m.end()
    if last < len(text):
        found.append(text[last:])
    return found


def shown(value: Any) -> str:
    """How a value is written into a text."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ", ".join(map(shown, value)) + "]"
    if isinstance(value, dict):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def _number(value: Any) -> int | float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TemplateError(f"{value!r} is not a number")
    return value


def _to_int(value: Any, default: Any = 0) -> Any:
    try:
        return int(value.strip()) if isinstance(value, str) else int(value)
    except (TypeError, ValueError):
        return default


def _to_float(value: Any, default: Any = 0.0) -> Any:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def _unique(items: list) -> list:
    return list({json.dumps(x, sort_keys=True, default=str): x for x in reversed(items)}.values())[::-1]


FILTERS: dict[str, Callable[..., Any]] = {
    "int": lambda v, default=0: _to_int(v, default),
    "float": lambda v, default=0.0: _to_float(v, default),
    "default": lambda v, value: value if v is None else v,
    "lower": lambda v: shown(v).lower(),
    "upper": lambda v: shown(v).upper(),
    "capitalize": lambda v: shown(v).capitalize(),
    "title": lambda v: shown(v).title(),
    "trim": lambda v: shown(v).strip(),
    "trim_start": lambda v: shown(v).lstrip(),
    "trim_end": lambda v: shown(v).rstrip(),
    "replace": lambda v, **a: shown(v).replace(a["from"], a["to"]),
    "truncate": lambda v, length=255, end="…": shown(v) if len(shown(v)) <= length else shown(v)[:length] + end,
    "split": lambda v, pat: shown(v).split(pat),
    "wordcount": lambda v: len(shown(v).split()),
    "length": lambda v: len(v),
    "reverse": lambda v: v[::-1],
    "first": lambda v: v[0] if v else None,
    "last": lambda v: v[-1] if v else None,
    "nth": lambda v, n: v[n] if n < len(v) else None,
    "join": lambda v, sep="": sep.join(map(shown, v)),
    "sort": lambda v: sorted(v),
    "unique": _unique,
    "slice": lambda v, start=0, end=None: v[start:end],
    "concat": lambda v, **a: v + (a["with"] if isinstance(a["with"], list) else [a["with"]]),
    "abs": lambda v: abs(_number(v)),
    "round": lambda v, precision=0: round(_number(v), precision) if precision else round(_number(v)),
    "json_encode": lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":")),
    "as_str": shown,
    "get": lambda v, key, default=None: v.get(key, default),
}


def _slug(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def _date(value: Any, format: str = "%Y-%m-%d", timezone: str | None = None) -> str:
    """A number is seconds since 1970 in UTC, a text an ISO date or time."""
    zone = ZoneInfo(timezone) if timezone else UTC
    if isinstance(value, str):
        when = datetime.fromisoformat(value)
        return (when.astimezone(zone) if timezone and when.tzinfo else when).strftime(format)
    return datetime.fromtimestamp(_number(value), zone).strftime(format)


def _file_size(value: Any, binary: bool = True) -> str:
    size, step = float(_number(value)), 1024 if binary else 1000
    units = ("B", "KiB", "MiB", "GiB", "TiB", "PiB") if binary else ("B", "KB", "MB", "GB", "TB", "PB")
    k = 0
    while abs(size) >= step and k < len(units) - 1:
        size, k = size / step, k + 1
    return f"{size:.{2 if k else 0}f}".rstrip("0").rstrip(".") + f" {units[k]}" if k else f"{int(size)} B"


def _at(value: Any, attribute: str) -> Any:
    """A member by its dotted name, None where there is none."""
    for name in attribute.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _grouped(items: list, attribute: str) -> dict[str, list]:
    found: dict[str, list] = {}
    for x in items:
        if (key := _at(x, attribute)) is not None:
            found.setdefault(shown(key), []).append(x)
    return found


FILTERS |= {
    "slugify": lambda v: _slug(shown(v)),
    "addslashes": lambda v: re.sub(r"([\\'\"])", r"\\\1", shown(v)),
    "striptags": lambda v: re.sub(r"<!--.*?-->|<[^>]*>", "", shown(v), flags=re.DOTALL),
    "spaceless": lambda v: re.sub(r">\s+<", "><", shown(v)),
    "escape": lambda v: html.escape(shown(v)).replace("/", "&#x2F;"),
    "linebreaksbr": lambda v: shown(v).replace("\r\n", "<br>").replace("\n", "<br>"),
    "urlencode": lambda v: quote(shown(v), safe="/"),
    "urlencode_strict": lambda v: quote(shown(v), safe=""),
    "trim_start_matches": lambda v, pat: re.sub(f"^(?:{re.escape(pat)})+", "", shown(v)),
    "trim_end_matches": lambda v, pat: re.sub(f"(?:{re.escape(pat)})+$", "", shown(v)),
    "indent": lambda v, prefix="    ", first=False, blank=False: "\n".join(
        prefix + line if (k or first) and (line or blank) else line for k, line in enumerate(shown(v).split("\n"))
    ),
    "pluralize": lambda v, singular="", plural="s": singular if abs(_number(v)) == 1 else plural,
    "filesizeformat": _file_size,
    "date": _date,
    "map": lambda v, attribute: [x for x in (_at(i, attribute) for i in v) if x is not None],
    "filter": lambda v, attribute, value=None: [i for i in v if (_at(i, attribute) is not None if value is None else _at(i, attribute) == value)],
    "group_by": _grouped,
}


def _throw(message: str) -> None:
    raise TemplateError(message)


def _get_env(name: str, default: Any = None) -> Any:
    found = os.environ.get(name, default)
    if found is None:
        raise TemplateError(f"the environment has no {name}")
    return found


#: Functions that every template has; those that a caller gives come first.
FUNCTIONS: dict[str, Callable[..., Any]] = {
    "range": lambda end, start=0, step_by=1: list(range(start, end, step_by)),
    "now": lambda timestamp=False, utc=False: int(time.time()) if timestamp else datetime.now(UTC if utc else None).astimezone(UTC if utc else None).isoformat(),
    "throw": _throw,
    "get_env": _get_env,
    "get_random": lambda end, start=0: random.randrange(start, end),
}

TESTS: dict[str, Callable[..., bool]] = {
    "odd": lambda v: _number(v) % 2 != 0,
    "even": lambda v: _number(v) % 2 == 0,
    "divisibleby": lambda v, by: _number(v) % _number(by) == 0,
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "iterable": lambda v: isinstance(v, (list, dict)),
    "object": lambda v: isinstance(v, dict),
    "starting_with": lambda v, x: shown(v).startswith(x),
    "ending_with": lambda v, x: shown(v).endswith(x),
    "containing": lambda v, x: x in v,
    "matching": lambda v, x: re.search(x, shown(v)) is not None,
}


def _passes(tree: tuple, scope: dict[str, Any], functions: dict[str, Callable[..., Any]] | None) -> bool:
    name = tree[1]
    if name in ("defined", "undefined"):
        try:
            evaluate(tree[2], scope, functions)
        except TemplateError:
            return name == "undefined"
        return name == "defined"
    if name not in TESTS:
        raise TemplateError(f"there is no test {name}")
    try:
        return TESTS[name](evaluate(tree[2], scope, functions), *(evaluate(x, scope, functions) for x in tree[3]))
    except (TypeError, ZeroDivisionError, re.error) as e:
        raise TemplateError(f"test {name}: {e}") from e



def evaluate(tree: tuple, scope: dict[str, Any], functions: dict[str, Callable[..., Any]] | None = None) -> Any:
    kind = tree[0]
    if kind == "value":
        return tree[1]
    if kind == "list":
        return [evaluate(x, scope, functions) for x in tree[1]]
    if kind == "name":
        if tree[1] not in scope:
            raise TemplateError(f"{tree[1]} is not defined")
        return scope[tree[1]]
    if kind == "get":
        held, key = evaluate(tree[1], scope, functions), evaluate(tree[2], scope, functions)
        try:
            return held[key]
        except (KeyError, IndexError, TypeError) as e:
            raise TemplateError(f"{key!r} is not in {shown(held)[:80]}") from e
    if kind == "call":
        known = FUNCTIONS | (functions or {})
        if tree[1] not in known:
            raise TemplateError(f"there is no function {tree[1]}")
        try:
            return known[tree[1]](**{k: evaluate(v, scope, functions) for k, v in tree[2].items()})
        except (TypeError, ValueError) as e:
            raise TemplateError(f"function {tree[1]}: {e}") from e
    if kind == "test":
        return _passes(tree, scope, functions)
    if kind == "filter":
        if tree[1] not in FILTERS:
            raise TemplateError(f"there is no filter {tree[1]}")
        try:
            value = evaluate(tree[2], scope, functions)
        except TemplateError:
            if tree[1] != "default":
                raise
            value = None
        try:
            return FILTERS[tree[1]](value, **{k: evaluate(v, scope, functions) for k, v in tree[3].items()})
        except (TypeError, KeyError, AttributeError, ValueError) as e:
            raise TemplateError(f"filter {tree[1]}: {e}") from e
    if kind == "not":
        return not evaluate(tree[1], scope, functions)
    op = tree[1]
    left = evaluate(tree[2], scope, functions)
    if op in ("and", "or"):
        return bool(evaluate(tree[3], scope, functions)) if bool(left) == (op == "and") else bool(left)
    right = evaluate(tree[3], scope, functions)
    if op == "~":
        return shown(left) + shown(right)
    if op == "==":
        return left == right
    if op == "!=":
        return left != right
    try:
        if op in ("<", "<=", ">", ">="):
            return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        a, b = _number(left), _number(right)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[op]()
    except (TypeError, ZeroDivisionError) as e:
        raise TemplateError(f"{shown(left)} {op} {shown(right)}: {e}") from e


def render(text: str, scope: dict[str, Any], functions: dict[str, Callable[..., Any]] | None = None) -> str:
    return "".join(p if isinstance(p, str) else shown(evaluate(p, scope, functions)) for p in parse(text))


_COLUMN_FILTERS: dict[str, Callable[..., Column]] = {
    "int": lambda c, default=0: F.coalesce(c.try_cast("bigint"), F.lit(default)),
    "float": lambda c, default=0.0: F.coalesce(c.try_cast("double"), F.lit(default)),
    "default": lambda c, value: F.coalesce(c, F.lit(value)),
    "lower": F.lower, "upper": F.upper, "title": F.initcap, "trim": F.trim, "trim_start": F.ltrim, "trim_end": F.rtrim,
    "capitalize": lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2)))),
    "replace": lambda c, **a: F.replace(c, F.lit(a["from"]), F.lit(a["to"])),
    "truncate": lambda c, length=255, end="…": F.when(F.length(c) <= length, c).otherwise(F.concat(F.left(c, F.lit(length)), F.lit(end))),
    "split": lambda c, pat: F.split(c, re.escape(pat)),
    "wordcount": lambda c: F.size(F.split(F.trim(c), r"\s+")),
    "length": F.length, "reverse": F.reverse, "abs": F.abs,
    "first": lambda c: F.get(c, F.lit(0)), "last": lambda c: F.try_element_at(c, F.lit(-1)), "nth": lambda c, n: F.get(c, F.lit(n)),
    "join": lambda c, sep="": F.array_join(c, sep), "sort": F.array_sort, "unique": F.array_distinct,
    "round": lambda c, precision=0: F.round(c, precision), "as_str": lambda c: c.cast("string"),
}


def expression_column(tree: tuple, names: Callable[[str], Column]) -> Column:
    """The Spark column of an expression; ``names`` gives the column of a name."""
    kind = tree[0]
    if kind == "value":
        return F.lit(tree[1])
    if kind == "list":
        return F.array(*(expression_column(x, names) for x in tree[1]))
    if kind == "name":
        return names(tree[1])
    if kind == "get":
        key = tree[2]
        held = expression_column(tree[1], names)
        return held.getItem(key[1] if key[0] == "value" else expression_column(key, names))
    if kind == "filter":
        if tree[1] not in _COLUMN_FILTERS or any(v[0] != "value" for v in tree[3].values()):
            raise TemplateError(f"filter {tree[1]} has no column form")
        return _COLUMN_FILTERS[tree[1]](expression_column(tree[2], names), **{k: v[1] for k, v in tree[3].items()})
    if kind == "not":
        return ~expression_column(tree[1], names)
    if kind != "op":
        raise TemplateError(f"{tree[1]} has no column form")
    a, b = expression_column(tree[2], names), expression_column(tree[3], names)
    return {
        "and": lambda: a & b, "or": lambda: a | b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b,
        ">": lambda: a > b, ">=": lambda: a >= b, "~": lambda: F.concat(a.cast("string"), b.cast("string")),
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
    }[tree[1]]()


def text_column(text: str, names: Callable[[str], Column] = F.col) -> Column:
    """A template as one string column; what is null is written as the empty text."""
    parts = [F.lit(p) if isinstance(p, str) else F.coalesce(expression_column(p, names).cast("string"), F.lit("")) for p in parse(text)]
    return F.concat(*parts) if parts else F.lit("")
