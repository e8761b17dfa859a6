"""Command line: ``python -m weftwork.cli [options] task... [-- args]``."""

from __future__ import annotations

import argparse
import contextlib
import logging
import os
import signal
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from weftwork.errors import WeftError
from weftwork.model import DEFAULT_PLUGINS
from weftwork.operators.changes import StateTable
from weftwork.operators.predicates import visible
from weftwork.plans.executor import Executor, run
from weftwork.plans.plugins import Registry
from weftwork.sources.taskfiles import catalog, dotenv, load, plugin_list


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftwork", description="Run tasks of a task file on Spark.")
    p.add_argument("tasks", nargs="*", help="names or patterns of tasks; arguments for them follow after --")
    p.add_argument("-f", "--file", help="task file; else the nearest one above the working folder")
    p.add_argument("-g", "--global", dest="home", action="store_true", help="use the task file in the home folder")
    p.add_argument("-c", "--config", help="file with a list of plugins, package.module:Class each")
    p.add_argument("-p", "--parallel", action="store_true")
    p.add_argument("-l", "--list-tasks", action="store_true")
    p.add_argument("-d", "--dry", action="store_true")
    p.add_argument("--force", action="store_true", help="skip preconditions and source checks")
    p.add_argument("-s", "--summary", action="store_true")
    p.add_argument("--clean-cache", action="store_true", help="forget all fingerprints first")
    p.add_argument("--state", default=".weftwork/fingerprint", help="folder of the fingerprint table")
    p.add_argument("--allow-shell", action="store_true", help="let tasks run shell commands on the driver")
    p.add_argument("-v", "--verbose", action="store_true", help="tell what starts, ends and writes, on the error stream")
    p.add_argument("--plain", action="store_true", help="no colours; also where NO_COLOR is set or the stream is no terminal")
    p.add_argument("--log", help="file to which all events are appended")
    return p


class Coloured(logging.Formatter):
    MARKS = {logging.DEBUG: 2, logging.INFO: 36, logging.ERROR: 31}

    def format(self, record: logging.LogRecord) -> str:
        return f"\x1b[{self.MARKS.get(record.levelno, 0)}m{super().format(record)}\x1b[0m"


@contextlib.contextmanager
def logged(verbose: bool, plain: bool, path: str | None) -> Iterator[None]:
    """Within it the events of runs are shown and appended to a file, as asked for."""
    handlers: list[logging.Handler] = []
    if verbose:
        shown = logging.StreamHandler(sys.stderr)
        plain = plain or "NO_COLOR" in os.environ or not sys.stderr.isatty()
        shown.setFormatter((logging.Formatter if plain else Coloured)("%(levelname)s %(message)s"))
        handlers.append(shown)
    if path:
        kept = logging.FileHandler(path)
        kept.setFormatter(logging.Formatter("[%(asctime)s] %(message)s"))
        handlers.append(kept)
    log = logging.getLogger("weftwork")
    before = log.level
    if handlers:
        log.setLevel(logging.DEBUG)
    for h in handlers:
        log.addHandler(h)
    try:
        yield
    finally:
        for h in handlers:
            log.removeHandler(h)
            h.close()
        log.setLevel(before)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    argv, args = (argv[: argv.index("--")], argv[argv.index("--") + 1 :]) if "--" in argv else (argv, [])
    o = parser().parse_args(argv)
    for key, value in dotenv().items():
        os.environ.setdefault(key, value)
    try:
        registry = Registry(allow_shell=o.allow_shell)
        if o.config:
            registry.load(plugin_list(o.config))
        file = load(o.file, home=o.home, plugins=dict.fromkeys((*DEFAULT_PLUGINS, *registry.keys())))
        spark = SparkSession.builder.appName("weftwork").getOrCreate()
        if o.list_tasks:
            rows = catalog(spark, file)
            for r in rows.where(visible(rows["internal"])).select("path", "desc").orderBy("path").collect():
                print(f"{r['path']}: {r['desc'] or ''}")
            return 0
        state = StateTable(spark, o.state)
        if o.clean_cache:
            state.clear()
        jobs: list[Executor] = []

        def stop(*_) -> None:
            for job in jobs:
                job.cancel()

        for name in (signal.SIGINT, signal.SIGTERM):
            signal.signal(name, stop)
        with logged(o.verbose, o.plain, o.log):
            try:
                results = run(
                    file, *o.tasks, spark=spark, registry=registry, started=jobs, args=args, parallel=o.parallel, state=state, force=o.force, dry=o.dry, echo=print
                )
            finally:
                registry.shutdown()
        for result in results:
            result.release()
            if o.summary:
                for name, ms in result.durations:
                    print(f"{name}: {ms} ms")
                print(f"total: {result.total_ms} ms")
    except WeftError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
