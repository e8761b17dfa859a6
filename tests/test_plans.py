import threading
import time

import pytest

from weftwork.errors import PlanError, PreconditionFailed, TaskFailed, UnknownTask
from weftwork.operators import changes, graph
from weftwork.plans.executor import run
from weftwork.plans.planner import plan
from weftwork.plans.plugins import Registry, compatible
from weftwork.sources.taskfiles import from_data


def go(tasks, name="main", spark=None, functions=None, **options):
    options.setdefault("environ", {})
    file = from_data({"tasks": tasks} if "tasks" not in tasks else tasks)
    return run(file, *([name] if isinstance(name, str) else name), spark=spark, registry=Registry(allow_shell=True, functions=functions), **options)[0]


def test_dependencies_come_before_steps_and_steps_in_order():
    result = go({
        "ship": {"deps": [{"task": "label", "vars": {"NAME": "crate"}}], "cmds": ["echo packed", {"task": "weigh"}, {"task": "weigh", "vars": {"UNIT": "lb"}}]},
        "label": {"cmds": ["echo {{ NAME }}", {"task": "stamp", "vars": {"INK": "red"}}]},
        "stamp": {"shell": "echo {{ INK }}"},
        "weigh": {"vars": {"UNIT": "kg"}, "shell": "echo {{ UNIT }}", "deps": ["tare"]},
        "tare": "echo 0",
    }, "ship")
    assert result.lines("stdout") == ["crate", "red", "packed", "0", "kg", "0", "lb"]


def test_a_task_that_runs_once_and_one_that_runs_on_new_values():
    result = go({
        "seed": {"run": "once", "shell": "echo seed"},
        "plant": {"run": "changed", "shell": "echo {{ KIND }} {{ DEPTH }}", "deps": ["seed"]},
        "water": {"shell": "echo water", "deps": ["seed"]},
        "main": {"cmds": [{"task": "water"}, *({"task": "plant", "vars": {"KIND": k, "DEPTH": d}} for k, d in (("oak", 3), ("oak", 3), ("oak", 4), ("ash", 4))), {"task": "water"}]},
    })
    assert result.lines("stdout") == ["seed", "water", "oak 3", "oak 4", "ash 4", "water"]


def test_arguments_results_and_platforms():
    tasks = {
        "hello": {"shell": "echo {{ COMMAND_ARGS }}"}, "one": "echo 1", "two": "echo 2", "main": {"tpl": "{{ deps_result.one | int + deps_result.two | int }}", "deps": ["one", "two"]},
        "twice": {"tpl": "{{ deps_result.hello_1 }}{{ deps_result.hello_2 }}", "deps": ["hello", "hello"]},
        "win": {"shell": "echo win", "platforms": ["windows"]}, "lin": {"shell": "echo lin", "platforms": ["linux/amd64"]}, "both": {"cmds": [{"task": "win"}, {"task": "lin"}]},
        "checked": {"shell": "echo Hello", "preconditions": ["{{ deps_result.build == 'true' }}"], "deps": ["build"]}, "build": "echo true",
        "refused": {"shell": "echo Hello", "preconditions": ["{{ 1 == 2 }}"]},
    }
    assert go(tasks, "hello", args=["arg1", "arg2"]).lines("stdout") == ["[arg1, arg2]"]
    assert go(tasks).results[-1] == "3"
    assert go(tasks, "twice", args=["a"]).results[-1] == "[a][a]"
    assert go(tasks, "both", platform=("linux", "amd64")).lines("stdout") == ["lin"]
    assert go(tasks, "checked").results[-1] == "Hello"
    with pytest.raises(PreconditionFailed):
        go(tasks, "refused")
    assert go(tasks, "refused", force=True).results == ["Hello"]


def test_errors_stop_or_are_ignored():
    tasks = {
        "bad": "exit 3", "ok": "echo ok", "main": {"cmds": [{"task": "bad"}, {"task": "ok"}]},
        "soft": {"shell": "exit 3", "ignore_error": True}, "goes_on": {"cmds": [{"task": "soft"}, {"task": "ok"}]},
    }
    with pytest.raises(TaskFailed):
        go(tasks)
    assert go(tasks, "goes_on").results == ["", "ok"]


def test_env_layers(monkeypatch):
    monkeypatch.delenv("EXT_NAME", raising=False)
    data = {"env": {"NAME": "Bob"}, "tasks": {"main": {"shell": 'echo $NAME ${EXT_NAME:-"Alice"} $MORE', "env": {"MORE": "$NAME!"}}}}
    assert go(data).results == ["Bob Alice Bob!"]
    monkeypatch.setenv("EXT_NAME", "Karol")
    assert go(data).results == ["Bob Karol Bob!"]


def test_variable_order():
    data = {"vars": {"A": "file", "B": "{{ A }}-b"}, "tasks": {
        "main": {"cmds": [{"task": "t"}, {"task": "t", "vars": {"A": "call"}}]}, "t": {"vars": {"A": "{{ A }}+task"}, "tpl": "{{ A }}"}}}
    data["vars"].pop("B")
    assert go(data).results == ["file+task", "call"]
    assert go(data, environ={"A": "process"}).results == ["process", "process"]


def test_dry_run_and_shell_permission(tmp_path):
    tasks = {"main": f"touch {tmp_path}/made"}
    assert go(tasks, dry=True).lines("stdout") == [f"touch {tmp_path}/made"] and not (tmp_path / "made").exists()
    with pytest.raises(PlanError):
        run(from_data({"tasks": tasks}), "main", environ={})


def test_parallel_dependencies_overlap():
    meet = threading.Barrier(2, timeout=10)

    def wait(context):
        meet.wait()
        return "met"

    result = go({"a": {"dataframe": "wait"}, "b": {"dataframe": "wait"}, "main": {"tpl": "{{ deps_result.a }}{{ deps_result.b }}", "deps": ["a", "b"]}}, functions={"wait": wait})
    assert result.results[-1] == "metmet"


def test_sql_tasks_pass_frames(spark):
    result = go({
        "numbers": {"sql": "SELECT id FROM range({{ N }})", "vars": {"N": 5}}, "main": {"sql": "SELECT sum(id) AS s FROM numbers", "deps": ["numbers"]},
    }, spark=spark)
    assert result.results[-1] == "10" and result.frames["numbers"].count() == 5
    assert result.summary(spark).count() == 2 and result.log(spark).where("type = 'started'").count() == 2


@pytest.mark.parametrize("shape", ["once", "commands"])
def test_shared_frame_is_computed_once(spark, shape):
    rows = spark.sparkContext.accumulator(0)

    def source(context):
        def run(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return context.spark.range(0, 5, 1, 1).mapInArrow(run, "id long")

    once = {
        "source": {"dataframe": "source", "run": "once"}, "low": {"sql": "SELECT id, 'low' AS kind FROM source WHERE id < 3", "deps": ["source"]},
        "high": {"sql": "SELECT id, 'high' AS kind FROM source WHERE id > 1", "deps": ["source"]},
        "main": {"sql": "SELECT count(*) AS n FROM low JOIN high USING (id)", "deps": ["low", "high"]},
    }
    commands = {
        "source": {"dataframe": "source"},
        "main": {"cmds": [{"sql": "SELECT max(id) AS n FROM source"}, {"sql": "SELECT count(*) AS n FROM source WHERE id > 3"}], "deps": ["source"]},
    }
    result = go({"once": once, "commands": commands}[shape], spark=spark, functions={"source": source})
    assert result.results[-1] == "1" and rows.value == 5
    assert len(result.kept) == 1
    result.release()
    assert not result.kept and result.frames["main"].first().n == 1


def test_frame_of_one_use_is_not_kept(spark):
    result = go({"numbers": {"sql": "SELECT id FROM range(5)", "run": "once"}, "main": {"sql": "SELECT sum(id) AS s FROM numbers", "deps": ["numbers"]}}, spark=spark)
    assert result.results[-1] == "10" and not result.kept


def test_more_nodes_at_once_than_a_fixed_pool():
    meet = threading.Barrier(12, timeout=20)

    def wait(context):
        meet.wait()
        return "met"

    tasks = {f"t{k}": {"dataframe": "wait"} for k in range(12)}
    result = go(tasks | {"main": {"tpl": "done", "deps": list(tasks)}}, functions={"wait": wait})
    assert result.results[-1] == "done"


def test_registry_tells_what_runs_and_shuts_down():
    registry, seen = Registry(), []

    class Closing:
        requires = "0.1.0"

        def run(self, context):
            seen.append(registry.is_running("closing"))
            return "x"

        def close(self):
            seen.append("closed")

    registry.register("closing", Closing())
    assert not registry.is_running("closing")
    run(from_data({"tasks": {"main": {"closing": "now"}}}, plugins=["closing"]), "main", registry=registry, environ={})
    assert seen == [True] and not registry.is_running("closing")
    registry.shutdown("closing")
    registry.shutdown("closing")
    assert seen == [True, "closed"] and "closing" not in registry.keys() and "tpl" in registry.keys()
    registry.shutdown()
    assert registry.keys() == []


def test_sources_skip_until_changed(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1")
    state = changes.StateTable(spark, str(tmp_path / "state"))
    tasks = {"main": {"cmds": ["echo one", "echo two"], "sources": [str(tmp_path / "*.txt")]}, "fails": {"shell": "exit 1", "sources": [str(tmp_path / "*.txt")]}}
    assert go(tasks, spark=spark, state=state).lines("stdout") == ["one", "two"]
    assert go(tasks, spark=spark, state=state).lines("stdout") == []
    assert go(tasks, spark=spark, state=state, force=True).lines("stdout") == ["one", "two"]
    for _ in range(2):  # a failed run keeps no fingerprint
        with pytest.raises(TaskFailed):
            go(tasks, "fails", spark=spark, state=state)


def test_plans(spark):
    file = from_data({"tasks": {"a": {"deps": ["b"], "tpl": "x"}, "b": {"deps": ["a"], "tpl": "x"}, "c": {"tpl": "x", "internal": True}, "d": {"cmds": []}, "e": {"tpl": "x", "deps": ["c"]}}})
    for name, error in (("a", PlanError), ("c", UnknownTask), ("nope", UnknownTask), ("d", PlanError)):
        with pytest.raises(error):
            plan(file, name, environ={})
    found = plan(file, "e", environ={})
    assert found.order() == plan(file, "e", environ={}).order() and len(found.nodes) == 2
    nodes, edges = found.frames(spark)
    assert not graph.has_cycle(nodes, edges)


def test_cancel():
    from weftwork.plans.executor import Executor

    file = from_data({"tasks": {"main": {"cmds": ["sleep 20", "echo late"]}}})
    job = Executor(plan(file, "main", environ={}), registry=Registry(allow_shell=True))
    threading.Timer(0.5, job.cancel).start()
    began = time.monotonic()
    with pytest.raises(TaskFailed):
        job.run()
    assert time.monotonic() - began < 10


def test_plugin_versions():
    assert compatible("0.1.0") and not compatible("0.2.0") and not compatible("1.0.0")

    class Old:
        requires = "9.0.0"

    with pytest.raises(PlanError):
        Registry().register("old", Old())
