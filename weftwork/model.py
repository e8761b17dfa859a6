"""Task files: dataclasses, the parser from plain data, and the Spark schema of a declaration.

Unknown keys are ignored as long as they aren't plugin keys; enums are checked.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from weftwork.errors import SpecError

RUN_MODES = ("always", "once", "changed")
STRATEGIES = ("hash", "timestamp")
EXECUTE_MODES = ("parallel", "sequentially")
DEFAULT_PLUGINS = ("shell", "tpl", "sql", "dataframe")


@dataclass(frozen=True)
class Call:
    """A reference to a task, from deps or from cmds."""

    task: str
    vars: dict[str, Any] = field(default_factory=dict)
    envs: dict[str, str] = field(default_factory=dict)
    silent: bool | None = None


@dataclass(frozen=True)
class Command:
    """A plugin key with its payload."""

    plugin: str
    payload: str


@dataclass(frozen=True)
class Task:
    name: str
    env: dict[str, str] = field(default_factory=dict)
    dir: str | None = None
    desc: str | None = None
    vars: dict[str, Any] = field(default_factory=dict)
    cmds: tuple[Call | Command, ...] | None = None
    internal: bool = False
    platforms: tuple[str, ...] | None = None
    ignore_error: bool = False
    deps: tuple[Call, ...] = ()
    run: str = "always"
    silent: bool = False
    execute_mode: str | None = None
    sources: tuple[str, ...] | None = None
    source_strategy: str = "hash"
    preconditions: tuple[str, ...] = ()
    command: Command | None = None


@dataclass
class TaskFile:
    """One file with its tasks; ``included`` are its namespaces."""

    name: str = ""
    path: str | None = None
    dir: str = "."
    vars: dict[str, Any] = field(default_factory=dict)
    env: dict[str, str] = field(default_factory=dict)
    tasks: dict[str, Task] = field(default_factory=dict)
    included: dict[str, TaskFile] = field(default_factory=dict)
    parent: TaskFile | None = None

    @property
    def namespace(self) -> tuple[str, ...]:
        return (*self.parent.namespace, self.name) if self.parent else ()

    @property
    def root(self) -> TaskFile:
        return self.parent.root if self.parent else self

    def chain(self) -> list[TaskFile]:
        """Files from the root to this one."""
        return [*(self.parent.chain() if self.parent else []), self]

    def walk(self) -> Iterable[TaskFile]:
        yield self
        for name in sorted(self.included):
            yield from self.included[name].walk()


def _mapping(value: Any, what: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise SpecError(f"{what} is not a mapping")
    return value


def _texts(value: Any, what: str) -> tuple[str, ...] | None:
    if value is None:
        return None
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, list):
        raise SpecError(f"{what} is not a list")
    return tuple(str(x) for x in value)


def _choice(value: Any, allowed: tuple[str, ...], what: str) -> str | None:
    if value is not None and value not in allowed:
        raise SpecError(f"{what} is {value!r}; it can be {', '.join(allowed)}")
    return value


def _env(value: Any, what: str) -> dict[str, str]:
    return {str(k): ("" if v is None else str(v)) for k, v in _mapping(value, what).items()}


def parse_call(value: Any, where: str) -> Call:
    if isinstance(value, str):
        return Call(value)
    if isinstance(value, dict) and isinstance(value.get("task"), str):
        return Call(value["task"], dict(_mapping(value.get("vars"), where)), _env(value.get("envs"), where), value.get("silent"))
    raise SpecError(f"{where}: a dependency is a name or a mapping with task")


def parse_command(value: Any, plugins: Iterable[str], where: str) -> Call | Command:
    if isinstance(value, str):
        return Command("shell", value)
    if isinstance(value, dict) and "task" in value:
        return parse_call(value, where)
    if isinstance(value, dict):
        keys = [k for k in value if k in plugins]
        if len(keys) == 1:
            return Command(keys[0], str(value[keys[0]]))
    raise SpecError(f"{where}: a command is a text, a mapping with task, or a mapping with one plugin key")


def parse_task(name: str, value: Any, plugins: Iterable[str] = DEFAULT_PLUGINS) -> Task:
    """A bare text is a shell command; a text under cmds counts as a list of one."""
    if isinstance(value, str):
        return Task(name, command=Command("shell", value))
    value = _mapping(value, f"task {name}")
    keys = [k for k in value if k in plugins]
    if len(keys) > 1:
        raise SpecError(f"task {name} has several plugin keys: {', '.join(keys)}")
    cmds = value.get("cmds")
    if isinstance(cmds, str):
        cmds = [cmds]
    if cmds is not None and not isinstance(cmds, list):
        raise SpecError(f"task {name}: cmds is not a list")
    return Task(
        name=name,
        env=_env(value.get("env"), f"task {name}: env"),
        dir=value.get("dir"),
        desc=value.get("desc"),
        vars=dict(_mapping(value.get("vars"), f"task {name}: vars")),
        cmds=None if cmds is None else tuple(parse_command(c, plugins, f"task {name}") for c in cmds),
        internal=bool(value.get("internal", False)),
        platforms=_texts(value.get("platforms"), f"task {name}: platforms"),
        ignore_error=bool(value.get("ignore_error", False)),
        deps=tuple(parse_call(d, f"task {name}") for d in value.get("deps") or ()),
        run=_choice(value.get("run"), RUN_MODES, f"task {name}: run") or "always",
        silent=bool(value.get("silent", False)),
        execute_mode=_choice(value.get("execute_mode"), EXECUTE_MODES, f"task {name}: execute_mode"),
        sources=_texts(value.get("sources"), f"task {name}: sources"),
        source_strategy=_choice(value.get("source_strategy"), STRATEGIES, f"task {name}: source_strategy") or "hash",
        preconditions=_texts(value.get("preconditions"), f"task {name}: preconditions") or (),
        command=Command(keys[0], str(value[keys[0]])) if keys else None,
    )


def parse_file(value: Any, plugins: Iterable[str] = DEFAULT_PLUGINS, name: str = "", path: str | None = None, directory: str = ".") -> TaskFile:
    """A file without its includes; only version 1 exists, and a missing version means 1."""
    value = _mapping(value, path or "the task file")
    if value.get("version", 1) != 1:
        raise SpecError(f"version {value['version']!r} is not supported")
    tasks = {str(k): parse_task(str(k), v, plugins) for k, v in _mapping(value.get("tasks"), "tasks").items()}
    return TaskFile(name, path, directory, dict(_mapping(value.get("vars"), "vars")), _env(value.get("env"), "env"), tasks)


def canonical(value: Any) -> str:
    """JSON text with sorted keys: values are compared by it."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


_STRINGS = T.MapType(T.StringType(), T.StringType())
_CALL = [
    T.StructField("task", T.StringType()), T.StructField("vars", _STRINGS), T.StructField("envs", _STRINGS), T.StructField("silent", T.BooleanType()),
]

#: One row for each declared task; variable values are canonical JSON.
TASK_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("segments", T.ArrayType(T.StringType()), False),
    T.StructField("name", T.StringType(), False), T.StructField("file", T.StringType()), T.StructField("env", _STRINGS),
    T.StructField("dir", T.StringType()), T.StructField("desc", T.StringType()), T.StructField("vars", _STRINGS),
    T.StructField("cmds", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("plugin", T.StringType()), T.StructField("payload", T.StringType()), *_CALL]))),
    T.StructField("internal", T.BooleanType(), False), T.StructField("platforms", T.ArrayType(T.StringType())),
    T.StructField("ignore_error", T.BooleanType(), False), T.StructField("deps", T.ArrayType(T.StructType(_CALL))),
    T.StructField("run", T.StringType(), False), T.StructField("silent", T.BooleanType(), False), T.StructField("execute_mode", T.StringType()),
    T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("source_strategy", T.StringType(), False),
    T.StructField("preconditions", T.ArrayType(T.StringType())), T.StructField("extra", _STRINGS),
])


def _texted(values: dict[str, Any]) -> dict[str, str]:
    return {k: canonical(v) for k, v in values.items()}


def task_row(file: TaskFile, task: Task) -> tuple:
    """The row of TASK_SCHEMA for a task."""
    segments = [*file.namespace, task.name]

    def call(c: Call) -> tuple:
        return (c.task, _texted(c.vars), dict(c.envs), c.silent)

    cmds = None
    if task.cmds is not None:
        cmds = [("call", None, None, *call(c)) if isinstance(c, Call) else ("plugin", c.plugin, c.payload, None, None, None, None) for c in task.cmds]
    return (
        ":".join(segments), segments, task.name, file.path, dict(task.env), task.dir, task.desc, _texted(task.vars), cmds, task.internal,
        None if task.platforms is None else list(task.platforms), task.ignore_error, [call(d) for d in task.deps], task.run, task.silent,
        task.execute_mode, None if task.sources is None else list(task.sources), task.source_strategy, list(task.preconditions),
        {task.command.plugin: task.command.payload} if task.command else {},
    )
