import time

import pytest
from pyspark.sql import functions as F

from weftwork.errors import PlanError
from weftwork.operators import changes, graph, predicates, resolve, runs


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize(("nodes", "edges", "cycle"), [
    ("ABC", [("A", "B"), ("B", "C"), ("C", "A")], True), ("ABC", [("A", "B"), ("B", "C")], False),
    ("01234", [("0", "1"), ("0", "2"), ("1", "3"), ("2", "3"), ("3", "4")], False), ("ABC", [("A", "B")], False), ("A", [("A", "A")], True),
])
def test_cycles(spark, nodes, edges, cycle):
    assert graph.has_cycle(*frames(spark, nodes, edges)) == cycle


def test_graph(spark):
    nodes, edges = frames(spark, "01234", [("0", "1"), ("0", "2"), ("1", "3"), ("2", "3"), ("3", "4")])
    levels = {r["id"]: r["level"] for r in graph.levels(nodes, edges).collect()}
    assert levels == {"0": 0, "1": 1, "2": 1, "3": 2, "4": 3}
    assert levels == {r["id"]: r["level"] for r in graph.chain_levels(edges, graph.ready(nodes, edges)).collect()}
    assert {r["id"]: r["degree"] for r in graph.in_degree(nodes, edges).collect()} == {"0": 0, "1": 1, "2": 1, "3": 2, "4": 1}
    assert {r["src"]: r["dsts"] for r in graph.listing(edges).collect()}["0"] == "1,2"
    assert graph.distinct_graph(nodes.union(nodes), edges.union(edges))[0].count() == 5
    with pytest.raises(PlanError):
        graph.check_ends(nodes, edges.union(spark.createDataFrame([("4", "9")], "src string, dst string")))


def test_long_chains(spark, tmp_path):
    """Longer than Spark's 100 levels of a recursive query."""
    from weftwork import catalogue

    turns = spark.range(300).selectExpr("1L AS conv_id", "cast(id AS int) AS turn").unionByName(spark.range(4).selectExpr("2L AS conv_id", "cast(id AS int) AS turn"))
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r["conv_id"]: r["last_level"] for r in catalogue.topo_level(spark, str(tmp_path)).collect()} == {1: 299, 2: 3}
    edges = spark.range(120).selectExpr("id AS src", "id + 1 AS dst")
    levels = {r["id"]: r["level"] for r in graph.chain_levels(edges, spark.range(1)).collect()}
    assert levels == {k: k for k in range(121)}


def test_a_cycle_behind_a_root_is_told(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "B")], "src string, dst string")
    with pytest.raises(PlanError):
        graph.chain_levels(edges, spark.createDataFrame([("A",)], "id string"))


def test_a_depth_limit_is_told(spark):
    nodes, edges = frames(spark, "ABCD", [("A", "B"), ("B", "C"), ("C", "D")])
    with pytest.raises(RuntimeError):
        graph.levels(nodes, edges, most=2)
    assert graph.levels(nodes.where("id < 'C'"), edges.where("dst < 'C'"), most=2).count() == 2


def test_platforms(spark):
    rows = [(None,), (["linux"],), (["AMD64 "],), (["linux / amd64"],), (["windows"],), ([],)]
    df = spark.createDataFrame(rows, "p array<string>")
    got = [r[0] for r in df.select(predicates.platform_matches(F.col("p"), "linux", "amd64")).collect()]
    assert got == [predicates.on_platform(p, "linux", "amd64") for (p,) in rows] == [True, True, True, True, False, False]


def test_run_modes(spark):
    calls = spark.createDataFrame([(1, "a", "1"), (2, "a", "2"), (3, "a", "2"), (4, "b", None), (5, "b", None), (6, "a", "1")], "seq long, name string, vars string")
    assert sorted(r["seq"] for r in runs.run_once(calls, "name", ["seq"]).collect()) == [1, 4]
    assert sorted(r["seq"] for r in runs.run_changed(calls, "name", "vars", ["seq"]).collect()) == [1, 2, 4, 6]


def test_preconditions(spark):
    df = spark.createDataFrame([(1, " true "), (1, "1"), (2, "yes"), (3, None)], "k long, t string")
    assert {r["k"]: r["x"] for r in df.groupBy("k").agg(predicates.all_true(F.col("t")).alias("x")).collect()} == {1: True, 2: False, 3: True}


@pytest.mark.parametrize("strategy", ["hash", "timestamp"])
def test_change_detection(spark, tmp_path, strategy):
    state = changes.StateTable(spark, str(tmp_path / "state"))
    file = tmp_path / "a.txt"
    file.write_text("one")

    def check():
        return changes.is_changed(spark, state, "t", [str(tmp_path / "*.txt")], strategy)

    assert check()[0]
    assert check()[0]  # not yet kept
    state.commit(strategy, "t", check()[1])
    assert not check()[0]
    time.sleep(1.1)
    file.write_text("two")
    assert check()[0]
    state.commit(strategy, "t", check()[1])
    (tmp_path / "b.txt").write_text("new")
    assert check()[0]
    state.commit(strategy, "t", check()[1])
    file.unlink()
    assert check()[0]  # a file that is gone is a change
    other = changes.is_changed(spark, state, "t", [str(tmp_path / "*.none")], "other")
    assert not other[0]
    state.clear()
    assert check()[0]


@pytest.mark.parametrize("strategy", ["hash", "timestamp"])
def test_nested_globs(spark, tmp_path, strategy):
    for name in ("a.rs", "x/b.rs", "x/y/c.rs", "x/y/d.txt", "z/b.rs"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)

    def names(pattern):
        return sorted(r["path"].split(f"{tmp_path}/")[1] for r in changes.scan(spark, [f"{tmp_path}/{pattern}"], strategy).collect())

    assert names("**/*.rs") == ["a.rs", "x/b.rs", "x/y/c.rs", "z/b.rs"]
    assert names("x/**") == ["x/b.rs", "x/y/c.rs", "x/y/d.txt"]
    assert names("x/**/[!d].*") == ["x/b.rs", "x/y/c.rs"]
    assert names("*/b.rs") == ["x/b.rs", "z/b.rs"]
    assert names("none/**/*.rs") == []
    state = changes.StateTable(spark, str(tmp_path / "state"))
    state.commit(strategy, "t", changes.scan(spark, [f"{tmp_path}/**/*.rs"], strategy))
    assert not changes.is_changed(spark, state, "t", [f"{tmp_path}/**/*.rs"], strategy)[0]
    (tmp_path / "x/y/c.rs").unlink()
    assert changes.is_changed(spark, state, "t", [f"{tmp_path}/**/*.rs"], strategy)[0]


def test_cycle_nodes_and_dependents(spark):
    nodes, edges = frames(spark, "ABCDE", [("A", "B"), ("B", "C"), ("C", "B"), ("C", "D"), ("A", "E")])
    assert sorted(r["id"] for r in graph.cycle_nodes(nodes, edges).collect()) == ["B", "C", "D"]
    assert sorted(r["dst"] for r in graph.dependents(nodes.where("id = 'A'"), edges).collect()) == ["B", "E"]
    assert graph.node_count(nodes.union(nodes)).first()["n"] == 5


def test_dependencies_by_name_and_wildcard(spark):
    catalog = spark.createDataFrame([("a",), ("n:a",), ("n:b",), ("n:m:c",)], "path string")
    names = spark.createDataFrame([("a",), ("n:*",), ("n:**",), ("*",), ("**",), ("gone",)], "name string")
    found = {}
    for r in resolve.dependencies(names, "name", catalog).collect():
        found.setdefault(r["name"], []).append(r["path"])
    assert {k: sorted(v) for k, v in found.items()} == {
        "a": ["a"], "n:*": ["n:a", "n:b"], "n:**": ["n:a", "n:b", "n:m:c"], "*": ["a"], "**": ["a", "n:a", "n:b", "n:m:c"],
    }
    assert resolve.find(catalog, ":a").count() == 0 and resolve.find(catalog, ":a", ("n",)).count() == 1
