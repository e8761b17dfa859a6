"""Graphs as nodes (id) and edges (src, dst): an edge says that src ends before dst begins."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.errors import PlanError


def distinct_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by their ends, each once."""
    return nodes.dropDuplicates(["id"]), edges.select("src", "dst").distinct()


def check_ends(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise if an edge has an end that is no node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    missing = ends.join(nodes.select("id"), "id", "left_anti").limit(1).collect()
    if missing:
        raise PlanError(f"an edge refers to {missing[0]['id']!r}, which is no node")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edges into each node, 0 included. Edges are counted before they meet the nodes."""
    counted = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def node_count(nodes: DataFrame) -> DataFrame:
    """(n): the number of nodes, each once."""
    return nodes.agg(F.count_distinct("id").alias("n"))


def dependents(done: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): for each node that is done the nodes that wait for it."""
    return edges.join(done.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing comes before."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def chained(siblings: DataFrame, parent: str, ordinal: str, node: str) -> DataFrame:
    """(parent, src, dst): each sibling after the one before it."""
    before = F.lag(node).over(Window.partitionBy(parent).orderBy(ordinal))
    return siblings.select(parent, before.alias("src"), F.col(node).alias("dst")).where("src IS NOT NULL")


def levels(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level): the number of nodes on the longest way to each node; raises on a cycle, and where the
    graph is deeper than ``most``, if that is given.

    Peels the nodes that nothing comes before, level by level. Each round is
    stored in the checkpoint folder, so plans don't grow with the depth.
    """
    found, left = _peeled(nodes, edges, most)
    if not left.isEmpty():
        raise PlanError("the graph has a cycle")
    return found


def cycle_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes that no round of ``levels`` frees: they lie on a cycle or come after one."""
    return _peeled(nodes, edges)[1]


def _peeled(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The freed nodes with their levels, and those that are left."""
    spark = nodes.sparkSession
    folder = f"{_folder(spark)}/weftwork-{uuid.uuid4().hex}"
    left, rest = nodes.select("id").distinct(), edges.select("src", "dst").distinct()
    found: list[str] = []
    for level in count():
        free = ready(left, rest).select("id", F.lit(level).cast("long").alias("level"))
        path = f"{folder}/level={level}"
        free.write.parquet(path)
        free = spark.read.parquet(path)
        if free.isEmpty():
            break
        if most is not None and level >= most:
            raise RuntimeError(f"the graph is deeper than {most} levels")
        found.append(path)
        left.join(free, "id", "left_anti").write.parquet(f"{folder}/left/{level}")
        rest.join(free.select(F.col("id").alias("src")), "src", "left_anti").write.parquet(f"{folder}/rest/{level}")
        left, rest = spark.read.parquet(f"{folder}/left/{level}"), spark.read.parquet(f"{folder}/rest/{level}")
    freed = spark.read.parquet(*found) if found else nodes.select("id", F.lit(0).cast("long").alias("level")).limit(0)
    return freed, left


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share; one is set only where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftwork-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get()
    return folder.rstrip("/")


def has_cycle(nodes: DataFrame, edges: DataFrame) -> bool:
    return not cycle_nodes(nodes, edges).isEmpty()


def chain_positions(siblings: DataFrame, parent: str, ordinal: str) -> DataFrame:
    """(parent, level): how many siblings come before each; of any length, as no round is made for a level."""
    before = F.row_number().over(Window.partitionBy(parent).orderBy(ordinal)) - 1
    return siblings.select(parent, before.cast("long").alias("level"))


def chain_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, level) for acyclic edges from given roots: the longest way to each node; raises on a cycle.

    Each round steps from the nodes of one level to all that follow them and is
    stored in the checkpoint folder, so there is no limit on levels or rows.
    """
    spark = edges.sparkSession
    folder = f"{_folder(spark)}/weftwork-{uuid.uuid4().hex}"
    steps = edges.select("src", "dst").distinct()
    ends = steps.select("dst").distinct().count()
    shape = f"id {roots.schema['id'].dataType.simpleString()}, level long"
    now, found, level = roots.select("id").distinct(), [], 0
    while True:
        path = f"{folder}/{level}"
        now.select("id", F.lit(level).cast("long").alias("level")).write.parquet(path)
        now = spark.read.schema(shape).parquet(path)
        if now.isEmpty():
            break
        if level > ends:  # a way without a cycle enters each node once
            raise PlanError("the graph has a cycle")
        found.append(path)
        level += 1
        now = now.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
    walked = spark.read.schema(shape).parquet(*(found or [path]))
    return walked.groupBy("id").agg(F.max("level").alias("level"))


def listing(edges: DataFrame) -> DataFrame:
    """(src, dsts): each node's dependents, sorted, as one text."""
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(F.col("dst").cast("string"))), ",").alias("dsts"))
