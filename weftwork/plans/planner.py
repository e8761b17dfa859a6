"""From a task name to a plan: nodes with fixed ids, and edges between them.

Only what the requested task needs is planned. A list of dependencies or commands
runs in order or at once; in order means that each part waits for all that the
part before it ends with. Ids are the place of the declaration in the plan, so the
same request gives the same plan.
"""

from __future__ import annotations

import os
from collections import Counter
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftwork.errors import PlanError, SpecError, UnknownTask
from weftwork.model import Call, Command, Task, TaskFile
from weftwork.operators.predicates import host, on_platform
from weftwork.operators.resolve import lookup


@dataclass
class Gate:
    """What is decided once for a task and holds for all its commands."""

    owner: str
    preconditions: tuple[str, ...]
    sources: tuple[str, ...] | None
    strategy: str
    dir: str
    nodes: list[str] = field(default_factory=list)


@dataclass
class Node:
    id: str
    name: str  # what is shown, and the key of run modes
    task: str  # path of the task
    command: Command | None
    layers: list[dict[str, Any]]
    env_layers: list[dict[str, str]]
    dir: str
    run: str
    silent: bool
    ignore_error: bool
    gate: Gate
    deps: dict[str, str] = field(default_factory=dict)  # name in deps_result -> node whose result it is


@dataclass
class Plan:
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: set[tuple[str, str]] = field(default_factory=set)

    def order(self) -> list[str]:
        """Ids in an order that the edges allow, by place where they don't decide."""
        before: dict[str, list[str]] = {n: [] for n in self.nodes}
        for src, dst in sorted(self.edges):
            if src not in self.nodes or dst not in self.nodes:
                raise PlanError(f"an edge refers to {src if src not in self.nodes else dst!r}, which is no node")
            before[dst].append(src)
        try:
            return list(TopologicalSorter(before).static_order())
        except CycleError as e:
            raise PlanError(f"the plan has a cycle: {' -> '.join(e.args[1])}") from e

    def validate(self) -> None:
        if not self.nodes:
            raise PlanError("the plan is empty")
        self.order()

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The plan as (id, name, task) and (src, dst) rows."""
        nodes = [(n.id, n.name, n.task) for n in self.nodes.values()]
        return spark.createDataFrame(nodes, "id string, name string, task string"), spark.createDataFrame(sorted(self.edges), "src string, dst string")


@dataclass
class Part:
    """A stretch of a plan: where it begins and ends, and the node whose result is its own."""

    first: list[str] = field(default_factory=list)
    last: list[str] = field(default_factory=list)
    result: str | None = None


class Planner:
    def __init__(self, file: TaskFile, args: list[str] | None = None, environ: dict[str, str] | None = None, platform: tuple[str, str] | None = None) -> None:
        self.file, self.args = file, args or []
        self.environ = dict(os.environ if environ is None else environ)
        self.platform = platform or host()
        self.plan = Plan()

    def build(self, name: str, *, parallel: bool = False) -> Plan:
        """The plan of a task name or pattern. Internal tasks can't be asked for by name."""
        found = [(f, t) for f, t in lookup(self.file, name) if not t.internal]
        if not found:
            raise UnknownTask(f"no task that can be run is named {name}")
        self._sequence([self._task(f, t, Call(name), f"{k}", ()) for k, (f, t) in enumerate(found) if self._runs_here(t)], parallel)
        self.plan.validate()
        return self.plan

    def _runs_here(self, task: Task) -> bool:
        return on_platform(task.platforms, *self.platform)

    def _chain(self, before: Part, after: Part) -> None:
        self.plan.edges |= {(a, b) for a in before.last for b in after.first}

    def _sequence(self, parts: list[Part], parallel: bool) -> Part:
        parts = [p for p in parts if p.first]
        if not parts:
            return Part()
        if parallel:
            return Part([n for p in parts for n in p.first], [n for p in parts for n in p.last], parts[-1].result)
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            self._chain(a, b)
        return Part(parts[0].first, parts[-1].last, parts[-1].result)

    def _layers(self, file: TaskFile, task: Task, call: Call) -> list[dict[str, Any]]:
        """Variables from the outermost layer inwards; the process environment lies over all."""
        root = file.root
        built_in = {
            "ROOT_DIR": root.dir, "TASKFILE_DIR": file.dir, "USER_WORKING_DIR": os.getcwd(), "COMMAND_ARGS": self.args,
            "HOST_OS": self.platform[0], "HOST_ARCH": self.platform[1],
        }
        files = file.chain()
        return [files[0].vars, built_in, *(f.vars for f in files[1:]), task.vars, call.vars, self.environ]

    def _calls(self, file: TaskFile, call: Call, where: str, stack: tuple[str, ...], parallel: bool = True) -> Part:
        """All tasks that a call's name or pattern stands for."""
        parts = [self._task(f, t, call, f"{where}.{k}", stack) for k, (f, t) in enumerate(lookup(file, call.task)) if self._runs_here(t)]
        return self._sequence(parts, parallel)

    def _task(self, file: TaskFile, task: Task, call: Call, where: str, stack: tuple[str, ...]) -> Part:
        path = ":".join((*file.namespace, task.name))
        if path in stack:
            raise PlanError(f"the plan has a cycle: {' -> '.join((*stack, path))}")
        stack = (*stack, path)
        here = f"{where}/{path}"
        # Dependencies of a task with cmds run in order unless it says parallel; else at once unless it says sequentially.
        at_once = task.execute_mode == "parallel" if task.cmds is not None else task.execute_mode != "sequentially"
        names = Counter(d.task for d in task.deps)
        seen: Counter[str] = Counter()
        results: dict[str, str] = {}
        deps = []
        for k, d in enumerate(task.deps):
            part = self._calls(file, d, f"{here}.deps[{k}]", stack)
            seen[d.task] += 1
            if part.result is not None:
                results[f"{d.task}_{seen[d.task]}" if names[d.task] > 1 else d.task] = part.result
            deps.append(part)
        before = self._sequence(deps, at_once)

        directory = str(Path(file.dir, task.dir)) if task.dir else file.dir
        gate = Gate(path, task.preconditions, task.sources, task.source_strategy, directory)
        layers, envs = self._layers(file, task, call), [f.env for f in file.chain()] + [task.env, call.envs]
        silent = task.silent if call.silent is None else call.silent

        def leaf(node_id: str, name: str, command: Command | None, run: str) -> Part:
            self.plan.nodes[node_id] = Node(node_id, name, path, command, layers, envs, directory, run, silent, task.ignore_error, gate, dict(results))
            gate.nodes.append(node_id)
            return Part([node_id], [node_id], node_id)

        if task.cmds is None:
            body = leaf(here, task.name, task.command, task.run)
        else:
            if task.command is not None:
                raise SpecError(f"task {path} has cmds and a plugin key")
            parts = []
            for k, c in enumerate(task.cmds):
                if isinstance(c, Call):
                    parts.append(self._calls(file, c, f"{here}.cmds[{k}]", stack, False))
                else:
                    parts.append(leaf(f"{here}.cmds[{k}]", c.payload, c, task.run))
            body = self._sequence(parts, task.execute_mode == "parallel")
        if not before.first:
            return body
        if not body.first:
            return before
        self._chain(before, body)
        return Part(before.first, body.last, body.result)


def plan(file: TaskFile, name: str, *, args: list[str] | None = None, parallel: bool = False, environ: dict[str, str] | None = None, platform: tuple[str, str] | None = None) -> Plan:
    return Planner(file, args, environ, platform).build(name, parallel=parallel)
