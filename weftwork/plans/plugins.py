"""Plugins: what runs a command. Each registers one key; a task or command names it.

``tpl`` gives the rendered text, ``sql`` runs a rendered query, ``dataframe`` calls
a registered Python function, ``shell`` runs a command on the driver and only where
the caller has allowed it.
"""

from __future__ import annotations

import contextlib
import importlib
import os
import re
import signal
import subprocess
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from weftwork import __version__
from weftwork.errors import PlanError, TaskFailed
from weftwork.functions.scope import expand_env
from weftwork.functions.template import render


@dataclass
class Context:
    """What a plugin gets to run one command."""

    spark: SparkSession | None
    task: str
    payload: str
    vars: dict[str, Any]
    env: dict[str, str]
    dir: str
    args: list[str]
    dry: bool
    emit: Callable[[str, str], None]
    cancelled: threading.Event
    frames: dict[str, DataFrame] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)

    def text(self) -> str:
        """The payload with environment values expanded and templates rendered."""
        return render(expand_env(self.payload, self.env, os.environ), self.vars, self.functions)


class Plugin(Protocol):
    """``requires`` is the engine version asked for: the same major number, and at least this one.

    A class that is loaded by name also has ``key``, the task key that it runs.
    """

    requires: str

    def run(self, context: Context) -> DataFrame | str: ...


def compatible(required: str, version: str = __version__) -> bool:
    """Whether a version satisfies a requirement: equal leading number (for 0.x the first two), and not older."""
    need, have = ([int(x) for x in re.findall(r"\d+", v)[:3]] + [0, 0, 0] for v in (required, version))
    need, have = need[:3], have[:3]
    fixed = 1 if need[0] else 2
    return need[:fixed] == have[:fixed] and have >= need


class Tpl:
    requires = "0.1.0"

    def run(self, context: Context) -> str:
        text = context.text()
        context.emit("stdout", text)
        return text


class Sql:
    requires = "0.1.0"
    _views = threading.Lock()

    def run(self, context: Context) -> DataFrame | str:
        query = context.text()
        if context.dry:
            context.emit("stdout", query)
            return ""
        views = {re.sub(r"\W", "_", name): frame for name, frame in context.frames.items()}
        with self._views:  # names are a session's: what runs beside may have a dependency of the same name
            for name, frame in views.items():
                frame.where("true").createOrReplaceTempView(name)  # to drop a view of the very frame would end its persistence
            try:
                return context.spark.sql(query)
            finally:
                for name in views:
                    context.spark.catalog.dropTempView(name)


class DataFramePlugin:
    """Calls registered functions by name: ``dataframe: name`` in a task runs ``functions[name](context)``."""

    requires = "0.1.0"

    def __init__(self, functions: dict[str, Callable[[Context], DataFrame | str]] | None = None) -> None:
        self.functions = functions or {}

    def run(self, context: Context) -> DataFrame | str:
        name = context.text().strip()
        if name not in self.functions:
            raise TaskFailed(f"{context.task}: no function {name!r} is registered")
        return "" if context.dry else self.functions[name](context)


class Shell:
    """``sh -c`` on the driver. When the run is cancelled its process group is asked to end, and after ``grace`` seconds made to."""

    requires = "0.1.0"
    grace = 30.0

    def run(self, context: Context) -> str:
        command = context.text()
        if context.dry:
            context.emit("stdout", command)
            return ""
        process = subprocess.Popen(
            ["sh", "-c", command], cwd=context.dir, env=os.environ | context.env, text=True,
            stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True,
        )
        lines: list[str] = []

        def pump(stream, kind: str) -> None:
            for line in stream:
                line = line.strip()
                context.emit(kind, line)
                if kind == "stdout":
                    lines.append(line)

        readers = [threading.Thread(target=pump, args=x, daemon=True) for x in ((process.stdout, "stdout"), (process.stderr, "stderr"))]
        for r in readers:
            r.start()
        asked: float | None = None
        while True:
            try:
                code = process.wait(timeout=0.1)
                break
            except subprocess.TimeoutExpired:
                if context.cancelled.is_set() and asked is None:
                    asked = time.monotonic()
                    os.killpg(process.pid, signal.SIGTERM)
                elif asked is not None and time.monotonic() - asked > self.grace:
                    os.killpg(process.pid, signal.SIGKILL)
        for r in readers:
            r.join(timeout=5)
        if code:
            raise TaskFailed(f"{context.task}: the command ended with code {code}")
        return "\n".join(lines).strip()


class Registry:
    """Plugins by key, and how many commands each runs now. A plugin may have ``close()``, called once when it is shut down."""

    def __init__(self, *, allow_shell: bool = False, functions: dict[str, Callable] | None = None) -> None:
        self._held: dict[str, Plugin] = {}
        self._running, self._lock = Counter(), threading.Lock()
        self.register("tpl", Tpl())
        self.register("sql", Sql())
        self.register("dataframe", DataFramePlugin(functions))
        if allow_shell:
            self.register("shell", Shell())

    def register(self, key: str, plugin: Plugin) -> None:
        if not compatible(plugin.requires):
            raise PlanError(f"plugin {key} asks for version {plugin.requires}; this is {__version__}")
        if key in self._held:
            raise PlanError(f"a plugin for {key} is registered already")
        self._held[key] = plugin

    def load(self, names: Iterable[str]) -> None:
        """Register plugin classes named ``package.module:Class``, each under its ``key``."""
        for name in names:
            module, _, attribute = name.partition(":")
            try:
                made = getattr(importlib.import_module(module), attribute)()
            except (ImportError, AttributeError, ValueError) as e:
                raise PlanError(f"plugin {name} can't be loaded: {e}") from e
            self.register(made.key, made)

    def remove(self, key: str) -> None:
        self._held.pop(key, None)

    @contextlib.contextmanager
    def using(self, key: str) -> Iterator[Plugin]:
        """The plugin of a key, which counts as running meanwhile."""
        plugin = self.get(key)
        with self._lock:
            self._running[key] += 1
        try:
            yield plugin
        finally:
            with self._lock:
                self._running[key] -= 1

    def is_running(self, key: str) -> bool:
        with self._lock:
            return self._running[key] > 0

    def shutdown(self, *keys: str) -> None:
        """Close and remove the plugins of these keys; without keys all of them."""
        for key in keys or self.keys():
            plugin = self._held.pop(key, None)
            if hasattr(plugin, "close"):
                plugin.close()

    def keys(self) -> list[str]:
        return list(self._held)

    def get(self, key: str) -> Plugin:
        if key not in self._held:
            hint = "; it runs commands on the driver and has to be allowed" if key == "shell" else ""
            raise PlanError(f"no plugin is registered for {key}{hint}")
        return self._held[key]
