import os

import pytest

from weftwork import cli
from weftwork.errors import PlanError
from weftwork.plans.plugins import Registry


class Loud:
    key = "loud"
    requires = "0.1.0"

    def run(self, context):
        text = context.text().upper()
        context.emit("stdout", text)
        return text


@pytest.fixture
def project(tmp_path, monkeypatch):
    (tmp_path / "Weftfile.yml").write_text(
        "version: 1\ntasks:\n  hello: {shell: 'echo {{ COMMAND_ARGS }} $VAR1', desc: greets}\n  hidden: {shell: echo, internal: true}\n"
        "  shout: {loud: 'hey {{ WHO }}', vars: {WHO: you}}\n  where: {shell: pwd, dir: '{{ SUB }}', vars: {SUB: deep}}\n  bad: exit 1\n"
    )
    (tmp_path / ".env").write_text("VAR1=VAL1\n")
    (tmp_path / "plugins.yml").write_text("plugins: ['tests.test_cli:Loud']\n")
    (tmp_path / "deep").mkdir()
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("VAR1", raising=False)
    yield tmp_path
    os.environ.pop("VAR1", None)


def test_command_line(spark, project, capsys, monkeypatch):
    monkeypatch.setattr(cli.signal, "signal", lambda *a: None)
    config = ["--config", "plugins.yml"]
    assert cli.main([*config, "--allow-shell", "-s", "hello", "--", "a", "b"]) == 0
    out = capsys.readouterr().out
    assert "[a, b] VAL1" in out and "total:" in out
    assert cli.main([*config, "--list-tasks"]) == 0
    out = capsys.readouterr().out
    assert "hello: greets" in out and "hidden" not in out
    assert cli.main([*config, "shout"]) == 0 and "HEY YOU" in capsys.readouterr().out
    assert cli.main([*config, "--allow-shell", "where"]) == 0 and str(project / "deep") in capsys.readouterr().out
    assert cli.main([*config, "hello"]) == 1 and "allowed" in capsys.readouterr().err
    assert cli.main([*config, "--allow-shell", "bad"]) == 1
    capsys.readouterr()
    for _ in range(2):
        assert cli.main([*config, "--verbose", "--log", "run.log", "shout"]) == 0
    said = capsys.readouterr().err
    assert "INFO shout: started" in said and "DEBUG shout: stdout: HEY YOU" in said and "\x1b" not in said
    lines = (project / "run.log").read_text().splitlines()
    assert len(lines) == 6 and all(line.startswith("[") for line in lines) and lines[-1].endswith("shout: exit: 0")
    assert cli.main([*config, "shout"]) == 0 and "started" not in capsys.readouterr().err
    assert cli.main([*config, "--allow-shell", "--clean-cache", "-d", "hello"]) == 0 and "echo" in capsys.readouterr().out


def test_plugins_by_name():
    registry = Registry()
    registry.load(["tests.test_cli:Loud"])
    assert "loud" in registry.keys()
    for bad in ("no.such:Thing", "tests.test_cli:Nothing", "x"):
        with pytest.raises(PlanError):
            registry.load([bad])
