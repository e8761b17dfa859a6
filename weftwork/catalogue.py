"""The registered queries of the engine and their SQL twins.

Each applies one operator to the whole driver tables, which stand for task
catalogues, graphs and run logs: regions hold nations hold customers as
namespaces hold tasks; orders and line items are tasks and their dependencies;
events are calls; documents are source files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.functions import scope, template
from weftwork.operators import changes, graph, predicates, resolve, runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, description) of customers as tasks within nations within regions."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat_ws(":", "r_name", "n_name", "c_name").alias("path"), F.col("c_mktsegment").alias("description"))
    )


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = (table(spark, sf_dir, t) for t in ("region", "nation"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(":", "r_name", "n_name").alias("path"))


def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.find(_namespaces(spark, sf_dir), "**")


def find_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.find(_namespaces(spark, sf_dir), "**:NATION_3:*").select("path", "description")


def find_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.find(_nations(spark, sf_dir), "*:*").select("path")


def find_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.find(_namespaces(spark, sf_dir), ":Customer#000000001", ("MIDDLE EAST", "NATION_19", "web")).unionByName(
        resolve.find(_namespaces(spark, sf_dir), "::AMERICA:NATION_16:Customer#000000002")
    ).unionByName(resolve.find(_nations(spark, sf_dir), "NATION_1", ("AMERICA",)).withColumn("description", F.lit(""))).select("path", "description")


def platform_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    platforms = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(
        F.array(F.when(F.col("doc_id") % 4 == 1, F.upper("lang")).when(F.col("doc_id") % 4 == 2, F.col("source")).otherwise(F.concat_ws(" / ", "lang", "source")))
    )
    return docs.withColumn("platforms", platforms).where(predicates.platform_matches(F.col("platforms"), "en", "src3")).select("doc_id", "lang", "source")


def internal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("internal", F.when(F.col("p_size") > 40, F.lit(None)).otherwise(F.col("p_size") % 2 == 0))
    return part.where(predicates.visible(F.col("internal"))).select("p_partkey", "p_name")


def unresolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "source")
    return resolve.unresolved(references, "name", table(spark, sf_dir, "labels"), "doc_id").select(F.col("name").alias("doc_id"), "source")


def dep_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations name the tasks right below them, regions all below, and some customers one task."""
    nations, tasks = _nations(spark, sf_dir), _namespaces(spark, sf_dir)
    regions = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(":**")).alias("name"))
    names = nations.select(F.concat("path", F.lit(":*")).alias("name")).unionByName(regions).unionByName(tasks.where("path LIKE '%7'").select(F.col("path").alias("name")))
    return resolve.dependencies(names, "name", tasks).select("name", "path")


def _dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return nodes, edges


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(*_dag(spark, sf_dir))


def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return graph.dependents(done, _dag(spark, sf_dir)[1])


def node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_count(_dag(spark, sf_dir)[0])


def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation before one other."""
    nation = table(spark, sf_dir, "nation")
    after = (F.col("n_nationkey") * F.col("n_nationkey") + 1) % 25
    edges = nation.select(F.col("n_nationkey").cast("long").alias("src"), after.cast("long").alias("dst"))
    return graph.cycle_nodes(edges.select(F.col("src").alias("id")), edges)


def ready_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ready(*_dag(spark, sf_dir))


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chained(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn")


def topo_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.chain_positions(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return found.groupBy("conv_id").agg(F.max("level").alias("last_level"))


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_once(table(spark, sf_dir, "events").select("event_type", "ts", "event_id"), "event_type", ["ts", "event_id"])


def run_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", "props")
    kept = runs.run_changed(calls.withColumn("name", F.concat_ws("/", "event_type", F.col("user_id").cast("string"))), "name", "props", ["ts", "event_id"])
    return kept.select("event_id", "event_type", "props")


def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", changes.content_hash(F.col("text")).alias("value"))


def source_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an earlier state in which some documents had other texts or did not exist."""
    current = table(spark, sf_dir, "documents").select("doc_id", "source", changes.content_hash(F.col("text")).alias("value"))
    earlier = current.where("doc_id % 97 <> 5").withColumn("value", F.when(F.col("doc_id") % 50 == 7, F.lit("old")).otherwise(F.col("value")))
    compared = changes.changed(current, earlier, "doc_id", also=("source",))
    return compared.groupBy("source").agg(F.bool_or("changed").alias("changed"), F.sum(F.col("changed").cast("long")).alias("n_changed"))


def source_mtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", changes.epoch_seconds(F.col("ts").cast("timestamp")).alias("mtime"))


def preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.concat(F.lit(" "), F.when(F.col("quality") == 1, "true").otherwise(F.col("toxic").cast("string")), F.lit(" "))
    return docs.select("doc_id", "source", "lang").join(labels, "doc_id").groupBy("source", "lang").agg(predicates.all_true(text).alias("runs"))


def scope_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))
    nations = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    layers = joined.select("c_custkey", F.explode(F.array(
        F.struct(F.lit(0).alias("depth"), F.col("r_name").alias("value")), F.struct(F.lit(1).alias("depth"), nations.alias("value")),
        F.struct(F.lit(2).alias("depth"), own.alias("value")),
    )).alias("x")).select("c_custkey", F.lit("GREETING").alias("key"), "x.depth", "x.value")
    return scope.fold_rows(layers, ("c_custkey", "key"))


def env_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    value = F.when(F.col("s_acctbal") > 4000, F.col("s_name")).when(F.col("s_acctbal") > 1000, F.lit(""))
    return supplier.select("s_suppkey", scope.env_default(value, "Alice").alias("name"))


def value_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.try_parse_json(F.col("props"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.try_variant_get(held, "$.k", "bigint").alias("k"), F.to_json(F.coalesce(held, F.try_parse_json(F.lit("null")))).alias("canonical")
    )


def dep_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return runs.dependency_results(items, "l_orderkey", F.col("l_linenumber"), F.col("l_quantity").cast("long"))


def dup_dep_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_partkey", "l_suppkey", "l_extendedprice"]
    return runs.numbered_names(items, "l_orderkey", "l_linenumber", order).select("l_orderkey", *order, "dep_name")


def output_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.joined_lines(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = "{{ c_name | upper }} of {{ n_name | replace(from='_', to=' ') }} ({{ c_mktsegment | lower }}): {{ c_custkey + 1 }}{{ c_custkey % 2 == 0 }}"
    return joined.select("c_custkey", template.text_column(text).alias("output"))


def ignore_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.element_at(F.split(F.col("url"), "/"), -1)
    return table(spark, sf_dir, "pages").select("page_id", runs.or_empty(last.try_cast("int")).alias("result"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_timestamp(F.lead("ts").over(w).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(seconds, F.lit(0)).alias("seconds"))


def graph_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_name").alias("dst"))
    region = table(spark, sf_dir, "region")
    return graph.listing(nation).join(region, F.col("src") == F.col("r_regionkey")).select("r_name", "dsts")


_QUERIES = (
    catalog_list, find_any_depth, find_one_level, find_exact, platform_filter, internal_filter, unresolved_names, dep_resolve, in_degree, dependents, node_count, cycle_nodes, ready_set, chain_edges, topo_level,
    run_once, run_changed, source_hash, source_changed, source_mtime, preconditions, scope_fold, env_default, value_typing, dep_results, dup_dep_names,
    output_join, template_render, ignore_error, summary, graph_dump,
)
QUERIES = {q.__name__: q for q in _QUERIES}

_TASKS = """SELECT r_name || ':' || n_name || ':' || c_name AS path, c_mktsegment AS description
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_NATION_PATHS = "SELECT r_name || ':' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey"

ORACLE = {
    "catalog_list": _TASKS,
    "find_any_depth": f"SELECT * FROM ({_TASKS}) WHERE path LIKE '%:NATION_3:%' AND split_part(path, ':', 2) = 'NATION_3'",
    "find_one_level": f"SELECT * FROM ({_NATION_PATHS})",
    "find_exact": f"""SELECT * FROM ({_TASKS}) WHERE path IN ('MIDDLE EAST:NATION_19:Customer#000000001', 'AMERICA:NATION_16:Customer#000000002')
        UNION ALL SELECT path, '' FROM ({_NATION_PATHS}) WHERE path = 'AMERICA:NATION_1'""",
    "platform_filter": """SELECT doc_id, lang, source FROM documents WHERE doc_id % 4 = 0 OR (doc_id % 4 = 1 AND lang = 'en')
        OR (doc_id % 4 = 2 AND source = 'src3') OR (doc_id % 4 = 3 AND lang = 'en' AND source = 'src3')""",
    "internal_filter": "SELECT p_partkey, p_name FROM part WHERE p_size > 40 OR p_size % 2 <> 0",
    "unresolved_names": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "dep_resolve": f"""WITH t AS ({_TASKS}) SELECT split_part(path, ':', 1) || ':' || split_part(path, ':', 2) || ':*' AS name, path FROM t
        UNION ALL SELECT split_part(path, ':', 1) || ':**', path FROM t UNION ALL SELECT path, path FROM t WHERE path LIKE '%7'""",
    "dependents": "SELECT DISTINCT l_partkey AS src, l_orderkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1",
    "node_count": "SELECT count(DISTINCT o_orderkey) AS n FROM orders",
    "cycle_nodes": """WITH RECURSIVE w(k, id) AS (SELECT 0, n_nationkey::BIGINT FROM nation UNION ALL SELECT k + 1, (id * id + 1) % 25 FROM w WHERE k < 25)
        SELECT DISTINCT id FROM w WHERE k = 25""",
    "in_degree": "SELECT o_orderkey AS id, count(l_orderkey) AS degree FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "ready_set": "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "chain_edges": """SELECT * FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS src, turn AS dst FROM conversations)
        WHERE src IS NOT NULL""",
    "topo_level": "SELECT conv_id, count(*) - 1 AS last_level FROM conversations GROUP BY conv_id",
    "run_once": "SELECT event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "run_changed": """SELECT event_id, event_type, props FROM (SELECT *, lag(props) OVER w AS before, row_number() OVER w AS n FROM events
        WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)) WHERE n = 1 OR before IS DISTINCT FROM props""",
    "source_hash": "SELECT doc_id, sha256(text) AS value FROM documents",
    "source_changed": """SELECT source, bool_or(c) AS changed, count(*) FILTER (c) AS n_changed
        FROM (SELECT source, doc_id % 97 = 5 OR doc_id % 50 = 7 AS c FROM documents) GROUP BY source""",
    "source_mtime": "SELECT event_id, floor(epoch(ts))::BIGINT AS mtime FROM events",
    "preconditions": "SELECT source, lang, bool_and(quality = 1 OR toxic = 1) AS runs FROM documents JOIN labels USING (doc_id) GROUP BY source, lang",
    "scope_fold": """SELECT c_custkey, 'GREETING' AS key, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END,
        CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS value
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "env_default": "SELECT s_suppkey, CASE WHEN s_acctbal > 4000 THEN s_name ELSE 'Alice' END AS name FROM supplier",
    "value_typing": """SELECT event_id, (props::JSON->>'k')::BIGINT AS k, '{"k":' || (props::JSON->>'k') || '}' AS canonical FROM events""",
    "dep_results": """SELECT l_orderkey, string_agg(r, ',' ORDER BY r) AS results FROM (SELECT l_orderkey,
        l_linenumber::VARCHAR || '=' || l_quantity::BIGINT::VARCHAR AS r FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) GROUP BY l_orderkey""",
    "dup_dep_names": """SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1
        THEN l_linenumber::VARCHAR || '_' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice)::VARCHAR
        ELSE l_linenumber::VARCHAR END AS dep_name FROM lineitem""",
    "output_join": "SELECT conv_id, trim(string_agg(trim(text), chr(10) ORDER BY turn)) AS output FROM conversations GROUP BY conv_id",
    "template_render": """SELECT c_custkey, upper(c_name) || ' of ' || replace(n_name, '_', ' ') || ' (' || lower(c_mktsegment) || '): '
        || (c_custkey + 1)::VARCHAR || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS output
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "ignore_error": r"SELECT page_id, coalesce(CASE WHEN regexp_full_match(split_part(url, '/', -1), '[+-]?\d+') THEN try_cast(split_part(url, '/', -1) AS INTEGER) END::VARCHAR, '') AS result FROM pages",
    "summary": """SELECT event_id, coalesce(floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT - floor(epoch(ts))::BIGINT, 0) AS seconds
        FROM events""",
    "graph_dump": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS dsts FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}
