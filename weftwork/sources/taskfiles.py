"""Reading task files: discovery, includes, .env files, and the catalogue as a DataFrame."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftwork.errors import SpecError
from weftwork.model import DEFAULT_PLUGINS, TASK_SCHEMA, TaskFile, parse_file, task_row

#: Names looked for in each folder, in this order. Projects with other names pass their own.
FILE_NAMES = tuple(f"{stem}{lock}.{end}" for lock in ("", ".lock") for end in ("yml", "yaml") for stem in ("Weftfile", "weftfile"))

INCLUDE_OPTIONS = ("optional", "dir", "vars")


def read_data(path: Path) -> Any:
    """YAML, of which JSON is a part; without PyYAML only JSON."""
    text = path.read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise SpecError(f"{path}: {e}") from e


def discover(start: str | os.PathLike = ".", names: Iterable[str] = FILE_NAMES) -> Path:
    """The first known file name in a folder or the nearest folder above it; a file is itself."""
    here = Path(start).resolve()
    if here.is_file():
        return here
    for folder in (here, *here.parents):
        for name in names:
            if (folder / name).is_file():
                return folder / name
    raise SpecError(f"no task file in {here} or above it")


def load(
    path: str | os.PathLike | None = None, *, home: bool = False, plugins: Iterable[str] = DEFAULT_PLUGINS, names: Iterable[str] = FILE_NAMES
) -> TaskFile:
    """Load a task file with all that it includes. home: look in the home folder instead."""
    plugins, names = tuple(plugins), tuple(names)
    return _read(discover(Path.home() if home else (path or "."), names), "", None, plugins, names, ())


def _read(path: Path, name: str, parent: TaskFile | None, plugins: tuple[str, ...], names: tuple[str, ...], seen: tuple[Path, ...]) -> TaskFile:
    if path in seen:
        raise SpecError(f"{path} includes itself")
    data = read_data(path) or {}
    file = parse_file(data, plugins, name, str(path), str(path.parent))
    file.parent = parent
    includes = data.get("includes") or {}
    if not isinstance(includes, dict):
        raise SpecError(f"{path}: includes is not a mapping")
    for key, value in includes.items():
        value = {"file": value} if isinstance(value, str) else value
        # The long form names the file under "file"; another key with a text is taken as well.
        where = next((v for k, v in value.items() if k not in INCLUDE_OPTIONS and isinstance(v, str)), None) if isinstance(value, dict) else None
        if not isinstance(where, str):
            raise SpecError(f"{path}: include {key} names no file")
        target = (path.parent / where).resolve()
        if target.is_dir():
            target = next((target / n for n in names if (target / n).is_file()), target / names[0])
        if not target.is_file():
            if value.get("optional"):
                continue
            raise SpecError(f"{path}: include {key}: {target} does not exist")
        child = _read(target, str(key), file, plugins, names, (*seen, path))
        child.vars |= value.get("vars") or {}
        if value.get("dir"):
            child.dir = str((path.parent / value["dir"]).resolve())
        file.included[str(key)] = child
    return file


def from_data(data: dict, plugins: Iterable[str] = DEFAULT_PLUGINS, includes: dict[str, dict] | None = None) -> TaskFile:
    """A task file from plain data; includes: namespaces from plain data."""
    file = parse_file(data, plugins)
    for name, value in (includes or {}).items():
        child = from_data(value, plugins, value.get("included"))
        child.name, child.parent = name, file
        file.included[name] = child
    return file


def dotenv(start: str | os.PathLike = ".") -> dict[str, str]:
    """Values of the nearest .env file in a folder or above it; none if there is none."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / ".env").is_file():
            found = {}
            for line in (folder / ".env").read_text(encoding="utf-8").splitlines():
                line = line.strip().removeprefix("export ")
                if line and line[0] != "#" and "=" in line:
                    key, value = line.split("=", 1)
                    value = value.strip()
                    quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
                    found[key.strip()] = value[1:-1] if quoted else value
            return found
    return {}


def plugin_list(path: str | os.PathLike) -> list[str]:
    """Names in a plugin configuration {plugins: [...]}, as they stand."""
    data = read_data(Path(path)) or {}
    found = data.get("plugins") if isinstance(data, dict) else None
    if found is not None and not isinstance(found, list):
        raise SpecError(f"{path}: plugins is not a list")
    return [str(x) for x in found or []]


def catalog(spark: SparkSession, file: TaskFile) -> DataFrame:
    """All declared tasks of a file and its namespaces, one row each."""
    rows = [task_row(f, f.tasks[t]) for f in file.walk() for t in sorted(f.tasks)]
    return spark.createDataFrame(rows, TASK_SCHEMA)


FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("name", T.StringType(), False), T.StructField("namespace", T.StringType(), False),
    T.StructField("parent", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("version", T.IntegerType(), False),
])


def files(spark: SparkSession, file: TaskFile) -> DataFrame:
    """The files of an include tree, one row each."""
    rows = [(f.path, f.name, ":".join(f.namespace), ":".join(f.parent.namespace) if f.parent else None, f.dir, 1) for f in file.walk()]
    return spark.createDataFrame(rows, FILE_SCHEMA)
