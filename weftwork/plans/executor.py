"""Running a plan: ready nodes go to a thread pool, results flow along the edges.

Spark work of independent nodes runs as concurrent jobs. The first failure stops
scheduling; what runs is left to end, or is interrupted by ``cancel``. A frame that
several commands use, or that ``once`` or ``changed`` gives to several calls, is kept
(``persist``), so its plan runs once; Spark makes lost parts again. ``RunResult.release`` lets the kept frames go. Events go to the logger
``weftwork`` too.
"""

from __future__ import annotations

import itertools
import logging
import os
import subprocess
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftwork.errors import PreconditionFailed, TaskFailed, WeftError
from weftwork.functions.scope import fold, fold_env
from weftwork.functions.template import render
from weftwork.model import TaskFile, canonical
from weftwork.operators.changes import StateTable, is_changed
from weftwork.operators.predicates import TRUE
from weftwork.plans.planner import Gate, Node, Plan, plan
from weftwork.plans.plugins import Context, Registry

EVENTS = "seq long, type string, task string, line string"
SUMMARY = "name string, duration_ms long"

LOG = logging.getLogger("weftwork")
LOG.addHandler(logging.NullHandler())
LEVELS = {"started": logging.INFO, "exit": logging.INFO, "error": logging.ERROR}


def result_text(value: DataFrame | str | None) -> str:
    """A result as a text: texts trimmed; a frame of one column and at most one row its value, others nothing."""
    if isinstance(value, DataFrame):
        if len(value.columns) != 1:
            return ""
        rows = value.limit(2).collect()
        return str(rows[0][0]) if len(rows) == 1 and rows[0][0] is not None else ""
    return (value or "").strip()


@dataclass
class RunResult:
    results: list[str] = field(default_factory=list)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    events: list[tuple[int, str, str, str]] = field(default_factory=list)
    durations: list[tuple[str, int]] = field(default_factory=list)
    total_ms: int = 0
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let the frames go that were kept for several nodes."""
        while self.kept:
            self.kept.pop().unpersist()

    def lines(self, kind: str | None = None) -> list[str]:
        return [e[3] for e in self.events if kind is None or e[1] == kind]

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.durations, SUMMARY)

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, EVENTS)


class RunCache:
    """The last run of each name: its variables and result. One call of a name decides at a time."""

    def __init__(self) -> None:
        self._lock, self._locks, self._held = threading.Lock(), {}, {}

    def lock(self, name: str) -> threading.Lock:
        with self._lock:
            return self._locks.setdefault(name, threading.Lock())

    def reusable(self, name: str, mode: str, variables: str) -> Any:
        held = self._held.get(name)
        if held and (mode == "once" or mode == "changed" and held[0] == variables):
            return held[1]
        return None

    def keep(self, name: str, variables: str, result: Any) -> None:
        self._held[name] = (variables, result)


class Executor:
    def __init__(
        self, plan: Plan, spark: SparkSession | None = None, registry: Registry | None = None, *, args: list[str] | None = None,
        state: StateTable | None = None, cache: RunCache | None = None, force: bool = False, dry: bool = False, threads: int | None = None,
        echo: Callable[[str], None] | None = None,
    ) -> None:
        self.plan, self.spark, self.registry = plan, spark, registry or Registry()
        self.args, self.state, self.cache = args or [], state, cache or RunCache()
        self.force, self.dry, self.threads, self.echo = force, dry, threads, echo
        self.cancelled, self.tag = threading.Event(), f"weftwork-{uuid.uuid4().hex}"
        self.result = RunResult()
        self._seq, self._lock = itertools.count(), threading.Lock()
        self._values: dict[str, DataFrame | str] = {}
        self._texts: dict[str, str] = {}
        self._text_locks: dict[str, threading.Lock] = {}
        self._users = Counter(n for node in plan.nodes.values() for n in set(node.deps.values()))
        self._names = Counter(node.name for node in plan.nodes.values())
        self._gates: dict[int, tuple[bool, DataFrame | None]] = {}
        self._gate_locks: dict[int, threading.Lock] = {}
        self._left = {id(n.gate): len(n.gate.nodes) for n in plan.nodes.values()}

    def cancel(self) -> None:
        """Stop scheduling, end shell processes and interrupt this run's Spark jobs."""
        self.cancelled.set()
        if self.spark is not None:
            self.spark.interruptTag(self.tag)

    def run(self) -> RunResult:
        """Run all nodes; raises the first failure in plan order."""
        order = self.plan.order()
        degree = {n: 0 for n in order}
        after: dict[str, list[str]] = {n: [] for n in order}
        for src, dst in self.plan.edges:
            degree[dst] += 1
            after[src].append(dst)
        failures: dict[str, BaseException] = {}
        started = time.monotonic()
        with ThreadPoolExecutor(self.threads or max(1, len(order))) as pool:
            first = [] if self.cancelled.is_set() else [n for n in order if not degree[n]]
            running: dict[Future, str] = {pool.submit(self._run_node, self.plan.nodes[n]): n for n in first}
            while running:
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for future in sorted(done, key=lambda f: order.index(running[f])):
                    n = running.pop(future)
                    if future.exception():
                        failures[n] = future.exception()
                        continue
                    for m in sorted(after[n]):
                        degree[m] -= 1
                        if not degree[m] and not failures and not self.cancelled.is_set():
                            running[pool.submit(self._run_node, self.plan.nodes[m])] = m
        self.result.total_ms = round(1000 * (time.monotonic() - started))
        if self.cancelled.is_set() and not failures:
            raise TaskFailed("the run was cancelled")
        if failures:
            raise failures[min(failures, key=order.index)]
        self.result.results = [self._text(n) for n in order]
        return self.result

    def _emit(self, kind: str, task: str, line: str) -> None:
        with self._lock:
            self.result.events.append((next(self._seq), kind, task, line))
        LOG.log(LEVELS.get(kind, logging.DEBUG), "%s: %s: %s", task, kind, line)

    def _text(self, n: str) -> str:
        """A node's result as a text, computed once for all that ask."""
        with self._lock:
            lock = self._text_locks.setdefault(n, threading.Lock())
        with lock:
            if n not in self._texts:
                self._texts[n] = result_text(self._values.get(n))
            return self._texts[n]

    def _functions(self) -> dict[str, Callable]:
        def shell(command: str) -> str | None:
            self.registry.get("shell")  # only where it is allowed
            if self.dry:
                return None
            return subprocess.run(["sh", "-c", command], capture_output=True, text=True).stdout.strip()

        return {"shell": shell}

    def _scope(self, node: Node) -> dict[str, Any]:
        found = fold(node.layers, self._functions())
        return found | {"deps_result": {name: self._text(n) for name, n in node.deps.items()}}

    def _open(self, gate: Gate, scope: dict[str, Any]) -> tuple[bool, DataFrame | None]:
        """Whether a task's commands are to run, decided once; and the fingerprints to keep once they have."""
        with self._lock:
            lock = self._gate_locks.setdefault(id(gate), threading.Lock())
        with lock:
            if id(gate) not in self._gates:
                found: tuple[bool, DataFrame | None] = (True, None)
                if not self.force:
                    for text in gate.preconditions:
                        if render(text, scope, self._functions()).strip() not in TRUE:
                            raise PreconditionFailed(f"{gate.owner}: the precondition {text!r} is not true")
                    if gate.sources is not None and self.state is not None:
                        folder = render(gate.dir, scope, self._functions())
                        patterns = [str(Path(folder, render(p, scope, self._functions()))) for p in gate.sources]
                        found = is_changed(self.spark, self.state, gate.owner, patterns, gate.strategy)
                self._gates[id(gate)] = found
            return self._gates[id(gate)]

    def _close(self, gate: Gate, ok: bool) -> None:
        """After the last command of a task that went well its fingerprints are kept."""
        with self._lock:
            self._left[id(gate)] -= 1 if ok else 0
            last = self._left[id(gate)] == 0
        changed, current = self._gates.get(id(gate), (False, None))
        if last and changed and current is not None and not self.dry:
            with self._state_lock:
                self.state.commit(gate.strategy, gate.owner, current)

    _state_lock = threading.Lock()

    def _run_node(self, node: Node) -> None:
        if self.spark is not None:
            self.spark.addTag(self.tag)
        scope = self._scope(node)
        runs, _ = self._open(node.gate, scope)
        if not runs:
            self._values[node.id] = ""
            return
        variables = canonical({k: v for k, v in scope.items() if k != "deps_result"})
        if node.run == "always":
            self._values[node.id], ok = self._execute(node, scope)
        else:
            with self.cache.lock(node.name):
                held = self.cache.reusable(node.name, node.run, variables)
                if held is not None:
                    self._values[node.id], ok = self._kept(held) if isinstance(held, DataFrame) else held, True
                else:
                    self._values[node.id], ok = self._execute(node, scope)
                    if ok and node.command is not None:
                        self.cache.keep(node.name, variables, self._values[node.id])
        self._close(node.gate, ok)

    def _kept(self, frame: DataFrame) -> DataFrame:
        with self._lock:
            if not frame.is_cached:
                self.result.kept.append(frame.persist())
        return frame

    def _execute(self, node: Node, scope: dict[str, Any]) -> tuple[DataFrame | str, bool]:
        if node.command is None:
            return "", True
        self._emit("started", node.name, f"Starting task {node.name}")
        began = time.monotonic()
        try:
            env = fold_env(node.env_layers, os.environ)

            def emit(kind: str, line: str) -> None:
                self._emit(kind, node.name, line)
                if self.echo and not node.silent:
                    self.echo(line)

            frames = {name: self._values[n] for name, n in node.deps.items() if isinstance(self._values.get(n), DataFrame)}
            directory = render(node.dir, scope, self._functions())
            context = Context(self.spark, node.name, node.command.payload, scope, env, directory, self.args, self.dry, emit, self.cancelled, frames, self._functions())
            with self.registry.using(node.command.plugin) as plugin:
                found = plugin.run(context)
            if isinstance(found, DataFrame):
                if self._users[node.id] > 1 or node.run != "always" and self._names[node.name] > 1:
                    self._kept(found)
                self.result.frames[node.task] = found
            self._emit("exit", node.name, "0")
            return (found if isinstance(found, DataFrame) else (found or "").strip()), True
        except Exception as e:
            self._emit("error", node.name, str(e))
            if node.ignore_error:
                return "", False
            raise e if isinstance(e, WeftError) else TaskFailed(f"{node.name}: {e}") from e
        finally:
            with self._lock:
                self.result.durations.append((node.name, round(1000 * (time.monotonic() - began))))


def run(
    file: TaskFile, *names: str, spark: SparkSession | None = None, registry: Registry | None = None, args: list[str] | None = None, parallel: bool = False,
    platform: tuple[str, str] | None = None, environ: dict[str, str] | None = None, started: list[Executor] | None = None, **options: Any,
) -> list[RunResult]:
    """Plan and run tasks by name, one after another, or all at once with ``parallel``. They share one run cache.

    started: gets the executors before they run, for whoever wants to cancel them.
    """
    options.setdefault("cache", RunCache())
    jobs = [
        Executor(plan(file, n, args=args, parallel=parallel, environ=environ, platform=platform), spark, registry, args=args, **options) for n in names
    ]
    if started is not None:
        started += jobs
    if not parallel:
        return [j.run() for j in jobs]
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(j.run) for j in jobs]]
