"""Layered variables and environment values.

On the driver a scope is a list of layers from the outermost to the innermost. A
value is rendered against the layers outside its own, never against its
siblings, so the order inside a layer doesn't matter. What a template renders to
is read as JSON where it is JSON, else it is a text.

As rows, a scope is (node, depth, key, value); the deepest value of a key wins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import template

_ENV = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}|([A-Za-z_][A-Za-z0-9_]*))")


def typed(text: str) -> Any:
    """A rendered text as the JSON value that it spells, or itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def render_value(value: Any, outer: Mapping[str, Any], functions: Mapping[str, Callable] | None = None) -> Any:
    """Render the templates of a value; values without one pass through."""
    if isinstance(value, str):
        return typed(template.render(value, dict(outer), dict(functions or {}))) if template.has_template(value) else value
    if isinstance(value, list):
        return [render_value(v, outer, functions) for v in value]
    if isinstance(value, dict):
        return {k: render_value(v, outer, functions) for k, v in value.items()}
    return value


def fold(layers: Sequence[Mapping[str, Any]], functions: Mapping[str, Callable] | None = None) -> dict[str, Any]:
    """All names with their nearest values, each rendered against the layers outside its own."""
    scope: dict[str, Any] = {}
    for layer in layers:
        scope = scope | {k: render_value(v, scope, functions) for k, v in layer.items()}
    return scope


def expand_env(text: str, scope: Mapping[str, str], process: Mapping[str, str]) -> str:
    """Replace $X, ${X} and ${X:-default}: from the scope, then the process, then the default, else leave as it is."""

    def found(m: re.Match) -> str:
        name = m[1] or m[3]
        value = scope.get(name, process.get(name))
        if value:
            return value
        if m[2] is not None:
            return m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in "'\"" else m[2]
        return m[0] if value is None else value

    return _ENV.sub(found, text)


def fold_env(layers: Sequence[Mapping[str, str]], process: Mapping[str, str]) -> dict[str, str]:
    """Environment values, nearest first; each expanded by the layers outside its own and the process."""
    scope: dict[str, str] = {}
    for layer in layers:
        scope = scope | {k: expand_env(v, scope, process) for k, v in layer.items()}
    return scope


def fold_rows(layers: DataFrame, by: Sequence[str] = ("node", "key"), value: str = "value", depth: str = "depth") -> DataFrame:
    """The nearest non-null value of each key: one grouped maximum, combined before the shuffle."""
    return layers.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, depth).alias(value))


def env_default(value: Column, *fallbacks: Column | str) -> Column:
    """The first of value and fallbacks that is neither null nor empty; the last one as it is."""
    columns = [value, *(f if isinstance(f, Column) else F.lit(f) for f in fallbacks)]
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns[:-1]), columns[-1])
