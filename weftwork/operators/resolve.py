"""Finding tasks by name: exact, ``*`` for one namespace or name, ``**`` for any number of namespaces.

``::x`` looks from the root, ``:x`` from the parent of the current namespace, other
names from the current one. ``**`` may stand anywhere and alone means everything.
A pattern becomes one predicate on the path, so a scan can apply it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.errors import UnknownTask
from weftwork.model import Task, TaskFile


def absolute(pattern: str, namespace: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The pattern's segments from the root; none where it looks above the root, which names nothing."""
    if pattern.startswith("::"):
        namespace, pattern = (), pattern[2:]
    elif pattern.startswith(":"):
        if not namespace:
            return ()
        namespace, pattern = namespace[:-1], pattern[1:]
    return (*namespace, *pattern.split(":"))


def path_regex(segments: tuple[str, ...]) -> str:
    parts = []
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s == "**":
            parts.append(".*" if last else "(?:[^:]+:)*")
        else:
            parts.append(("[^:]+" if s == "*" else re.escape(s)) + ("" if last else ":"))
    return "^" + "".join(parts) + "$"


def matches(path: Column, pattern: str, namespace: tuple[str, ...] = ()) -> Column:
    """Whether a path is named by a pattern. Fixed prefixes become a range that a scan can use."""
    segments = absolute(pattern, namespace)
    if "*" not in segments and "**" not in segments:
        return path == ":".join(segments)
    fixed = []
    for s in segments:
        if s in ("*", "**"):
            break
        fixed.append(s)
    found = path.rlike(path_regex(segments))
    return path.startswith(":".join(fixed) + ":") & found if fixed else found


def find(catalog: DataFrame, pattern: str, namespace: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a catalogue that a pattern names."""
    return catalog.where(matches(F.col("path"), pattern, namespace))


def unresolved(references: DataFrame, name: str, catalog: DataFrame, path: str = "path") -> DataFrame:
    """References whose name is in no row of the catalogue."""
    return references.join(catalog.select(F.col(path).alias(name)), name, "left_anti")


def dependencies(references: DataFrame, name: str, catalog: DataFrame, path: str = "path") -> DataFrame:
    """The references with each path that they name: whole names, ``a:b:*`` for what is right below, ``a:b:**`` for all below.

    Each path is listed under the names it answers to, so the join is on equal
    keys, and a wildcard is no comparison of every reference with every path.
    """
    parts = F.split(F.col(path), ":")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.concat(F.slice(parts, F.lit(1), k), F.array(F.lit("**"))), ":"))
    near = F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.lit("*"))), ":")
    keyed = catalog.select(F.col(path), F.explode(F.concat(F.array(F.col(path), near), above)).alias(name))
    return references.join(keyed, name)


def lookup(file: TaskFile, pattern: str, *, required: bool = True) -> list[tuple[TaskFile, Task]]:
    """The same on the driver, over a loaded file's root, in path order."""
    regex = re.compile(path_regex(absolute(pattern, file.namespace)))
    found = [(f, t) for f in file.root.walk() for t in f.tasks.values() if regex.match(":".join((*f.namespace, t.name)))]
    if not found and required:
        raise UnknownTask(f"no task is named {pattern}")
    return sorted(found, key=lambda x: (*x[0].namespace, x[1].name))
