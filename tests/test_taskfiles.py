import pytest

from weftwork.errors import SpecError
from weftwork.model import Call, Command, parse_file, parse_task
from weftwork.operators.predicates import visible
from weftwork.operators.resolve import find, lookup
from weftwork.sources import taskfiles


def test_every_field_is_read():
    task = parse_task("t", {
        "env": {"A": 1}, "dir": "d", "desc": "text", "vars": {"x": [1, 2]}, "cmds": ["echo", {"task": "u", "vars": {"y": 1}, "envs": {"E": "f"}, "silent": True}, {"tpl": "{{ x }}"}],
        "internal": True, "platforms": ["linux"], "ignore_error": True, "deps": ["a", {"task": "b", "vars": {"z": 2}}], "run": "once", "silent": True,
        "execute_mode": "parallel", "sources": ["*.py"], "source_strategy": "timestamp", "preconditions": ["true"], "unknown": 1,
    })
    assert task.env == {"A": "1"} and task.dir == "d" and task.desc == "text" and task.vars == {"x": [1, 2]}
    assert task.cmds == (Command("shell", "echo"), Call("u", {"y": 1}, {"E": "f"}, True), Command("tpl", "{{ x }}"))
    assert task.deps == (Call("a"), Call("b", {"z": 2})) and task.run == "once" and task.execute_mode == "parallel"
    assert task.internal and task.ignore_error and task.silent and task.sources == ("*.py",) and task.source_strategy == "timestamp"


@pytest.mark.parametrize("bad", [{"run": "never"}, {"execute_mode": "x"}, {"source_strategy": "x"}, {"cmds": 3}, {"shell": "a", "tpl": "b"}, {"deps": [3]}])
def test_bad_tasks(bad):
    with pytest.raises(SpecError):
        parse_task("t", bad)


def test_short_forms_and_version():
    file = parse_file({"tasks": {"a": "echo", "b": {"cmds": "one\ntwo"}}})
    assert file.tasks["a"].command == Command("shell", "echo") and file.tasks["b"].cmds == (Command("shell", "one\ntwo"),)
    with pytest.raises(SpecError):
        parse_file({"version": 2})


def test_discovery_and_includes(tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "Weftfile.yml").write_text(
        "version: 1\nincludes:\n  web: ./web\n  more:\n    file: ./more.yml\n    vars: {IMAGE: debian}\n    dir: ./build\n  gone: {file: ./no.yml, optional: true}\ntasks:\n  top: echo\n"
    )
    (tmp_path / "web" / "Weftfile.yml").write_text("tasks:\n  serve: echo\n")
    (tmp_path / "more.yml").write_text("vars: {IMAGE: ubuntu}\ntasks:\n  build: echo\n")
    file = taskfiles.load(tmp_path / "deep" / "er")
    assert sorted(file.included) == ["more", "web"]
    assert file.included["more"].vars == {"IMAGE": "debian"} and file.included["more"].dir == str(tmp_path / "build")
    assert file.included["web"].namespace == ("web",)
    (tmp_path / "Weftfile.yml").write_text("includes:\n  gone: ./no.yml\n")
    with pytest.raises(SpecError):
        taskfiles.load(tmp_path)
    (tmp_path / "Weftfile.yml").write_text("includes:\n  me: ./Weftfile.yml\n")
    with pytest.raises(SpecError):
        taskfiles.load(tmp_path)


def test_dotenv_and_plugin_list(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".env").write_text("# note\nVAR1=VAL1\nexport B='x y'\n")
    assert taskfiles.dotenv(tmp_path / "sub") == {"VAR1": "VAL1", "B": "x y"}
    (tmp_path / "p.yml").write_text("plugins: [one, two]\n")
    assert taskfiles.plugin_list(tmp_path / "p.yml") == ["one", "two"]


def levels():
    leaf = {"tasks": {"task1": "x"}}
    nest = {"tasks": {"task1": "x"}, "included": {"level4": leaf}}
    nest = {"tasks": {"task1": "x", "other": {"shell": "x", "internal": True}}, "included": {"level3": nest}}
    return taskfiles.from_data({"tasks": {"task1": "x"}}, includes={"level1": {"tasks": {"task2": "x"}, "included": {"level2": nest}}, "side": leaf})


@pytest.mark.parametrize(("pattern", "namespace", "n"), [
    ("**:task1", (), 5), ("**", (), 7), ("*:task1", (), 1), ("task1", (), 1), ("level1:**:task1", (), 3), ("level1:level2:*", (), 2),
    ("::task1", ("level1",), 1), (":side:task1", ("level1",), 1), ("nothing", (), 0), ("level1:*:task1", (), 1),
])
def test_names(spark, pattern, namespace, n):
    file = levels()
    rows = find(taskfiles.catalog(spark, file), pattern, namespace)
    here = file
    for name in namespace:
        here = here.included[name]
    found = lookup(here, pattern, required=False)
    assert rows.count() == len(found) == n
    assert sorted(r["path"] for r in rows.collect()) == sorted(":".join((*f.namespace, t.name)) for f, t in found)


def test_catalog_hides_internal(spark):
    rows = taskfiles.catalog(spark, levels())
    assert rows.count() == 7 and rows.where(visible(rows["internal"])).count() == 6
    assert taskfiles.files(spark, levels()).count() == 6
