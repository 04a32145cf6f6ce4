"""Queries over the star-schema tables seen as a property graph, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import QueryEngine
from .model import Direction, PropertyGraph
from .operators import analysis, layout, paths, traversal
from .operators.schema import Bool, EdgeType, Float, GraphSchema, Int, NodeType, Ref, String
from .sources import exporters, text


def tables_graph(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> PropertyGraph:
    """Nodes: region nation customer supplier part orders user turn. Edges: IN_REGION LIVES_IN BASED_IN PLACED CONTAINS SUPPLIED_BY NEXT REPLIES_TO REPORTS_TO. All lazy; `only` picks some of the names."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, customer, supplier, orders, line = t("nation"), t("customer"), t("supplier"), t("orders"), t("lineitem")
    turns = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nodes = {
        "region": (t("region"), "r_regionkey", ["r_name"]), "nation": (nation, "n_nationkey", ["n_name"]), "customer": (customer, "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"]),
        "supplier": (supplier, "s_suppkey", ["s_name", "s_acctbal"]), "part": (t("part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]), "orders": (orders, "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderpriority"]),
        "user": (t("events").select("user_id").distinct(), "user_id", []), "turn": (turns, "id", ["conv_id", "turn", "role"]), "event": (t("events"), "event_id", ["event_type", "value"]),
    }
    ends = lambda df, a, b, *more: df.select(a, b, *more)
    contains = line.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    boss = customer.select("c_custkey", F.floor(F.col("c_custkey") / 10).alias("boss")).where("c_custkey > 0")
    following = t("events").select("event_id", F.lead("event_id").over(own).alias("after")).where("after IS NOT NULL")
    edges = {
        "IN_REGION": (nation, ("nation", "n_nationkey"), ("region", "n_regionkey"), []), "LIVES_IN": (customer, ("customer", "c_custkey"), ("nation", "c_nationkey"), []), "BASED_IN": (supplier, ("supplier", "s_suppkey"), ("nation", "s_nationkey"), []),
        "PLACED": (orders, ("customer", "o_custkey"), ("orders", "o_orderkey"), []), "CONTAINS": (contains, ("orders", "l_orderkey"), ("part", "l_partkey"), ["n_lines", "quantity"]), "SUPPLIED_BY": (ends(line, "l_partkey", "l_suppkey").distinct(), ("part", "l_partkey"), ("supplier", "l_suppkey"), []),
        "THEN": (following, ("event", "event_id"), ("event", "after"), []), "REPLIES_TO": (turns.where("turn > 0").select("id", (F.col("id") - 1).alias("to")), ("turn", "id"), ("turn", "to"), []), "REPORTS_TO": (boss, ("customer", "c_custkey"), ("customer", "boss"), []),
        "LINE": (line, ("orders", "l_orderkey"), ("part", "l_partkey"), ["l_quantity"]),
    }
    pick = lambda d: {k: v for k, v in d.items() if only is None or k in only}
    return PropertyGraph.from_tables(spark, pick(nodes), pick(edges), name="tables")


def _ql(query: str, *only: str, columns: Callable[[], list] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = QueryEngine(tables_graph(spark, sf_dir, only)).execute(query).df
        return df.select(*columns()) if columns else df

    return run


def _on(f: Callable[[PropertyGraph], DataFrame], *only: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(tables_graph(spark, sf_dir, only))


def _flag(f: Callable[[PropertyGraph], bool], name: str, *only: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.createDataFrame([(f(tables_graph(spark, sf_dir, only)),)], f"{name} boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# predicates (customer and part properties)
for _name, _where, _sql in (
    ("eq", "c_mktsegment = 'BUILDING'", "c_mktsegment = 'BUILDING'"), ("ne", "c_mktsegment != 'BUILDING'", "c_mktsegment <> 'BUILDING'"), ("gt", "c_acctbal > 5000", "c_acctbal > 5000"), ("ge", "c_acctbal >= 73.0", "c_acctbal >= 73.0"),
    ("lt", "c_acctbal < 0", "c_acctbal < 0"), ("le", "c_acctbal <= 1863.84", "c_acctbal <= 1863.84"), ("in", "c_mktsegment IN (BUILDING, 'FURNITURE')", "c_mktsegment IN ('BUILDING', 'FURNITURE')"), ("not_in", "c_mktsegment NOT IN (BUILDING, FURNITURE)", "c_mktsegment NOT IN ('BUILDING', 'FURNITURE')"),
    ("contains", "c_name CONTAINS '0077'", "contains(c_name, '0077')"), ("starts", "c_mktsegment STARTS_WITH 'MA'", "starts_with(c_mktsegment, 'MA')"), ("ends", "c_name ENDS_WITH '7'", "c_name LIKE '%7'"), ("matches", "c_name MATCHES 'Customer#0+1[0-9]*5$'", "regexp_matches(c_name, '^(?:Customer#0+1[0-9]*5$)')"),
    ("exists", "c_acctbal EXISTS", "c_acctbal IS NOT NULL"), ("not_exists", "NOT EXISTS c_phone", "TRUE"), ("or_groups", "c_acctbal > 9000 AND c_mktsegment = 'MACHINERY' OR c_acctbal < -900", "(c_acctbal > 9000 AND c_mktsegment = 'MACHINERY') OR c_acctbal < -900"), ("absent", "c_phone = 1", "FALSE"),
):
    _add(f"nodes_where_{_name}", _ql(f"NODES customer WHERE {_where} RETURN c_name, c_acctbal", "customer"), f"SELECT c_name, c_acctbal FROM customer WHERE {_sql}")
_add("nodes_shorthand", _ql("NODES part(p_brand='Brand#2', p_type=ECONOMY) WHERE p_size > 10 RETURN p_name, p_size", "part"), "SELECT p_name, p_size FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' AND p_size > 10")
_add("count_where", _ql("COUNT customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000", "customer"), "SELECT count(*) AS count FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")

# scans, sort, paging, projection
_add("node_scan", _on(lambda g: g.nodes("nation").select("id", "n_name"), "nation"), "SELECT n_nationkey AS id, n_name FROM nation")
_add("nodes_all_types", _ql("NODES", "region", "nation", columns=lambda: ["type", "id"]), "SELECT 'region' AS type, CAST(r_regionkey AS VARCHAR) AS id FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation")
_add("nodes_order_limit_offset", _ql("NODES customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC LIMIT 20 OFFSET 5 RETURN c_name, c_acctbal", "customer"), "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
_add("nodes_return_absent", _ql("NODES supplier RETURN s_name, s_phone", "supplier"), "SELECT s_name, CAST(NULL AS VARCHAR) AS s_phone FROM supplier")
_add("builder_query", lambda spark, sf_dir: QueryEngine(tables_graph(spark, sf_dir, ("part",))).match("part").where("p_size", ">=", 45).where("p_brand", "STARTS_WITH", "Brand#1").order_by("p_retailprice", "DESC").limit(15).return_fields("p_name", "p_size", "p_retailprice").execute().df, "SELECT p_name, p_size, p_retailprice FROM part WHERE p_size >= 45 AND starts_with(p_brand, 'Brand#1') ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
_add("edges_where", _ql("EDGES CONTAINS WHERE n_lines > 1", "CONTAINS", columns=lambda: ["rel_type", "src_id", "dst_id"]), "SELECT 'CONTAINS' AS rel_type, CAST(l_orderkey AS VARCHAR) AS src_id, CAST(l_partkey AS VARCHAR) AS dst_id FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1")
_add("edge_scan_by_source", _on(lambda g: g.edges("PLACED", source=("customer", 7)).select("rel_type", "src_id", "dst_id"), "PLACED"), "SELECT 'PLACED' AS rel_type, CAST(o_custkey AS VARCHAR) AS src_id, CAST(o_orderkey AS VARCHAR) AS dst_id FROM orders WHERE o_custkey = 7")
_add("edge_scan_by_target", _on(lambda g: g.edges("LIVES_IN", target=("nation", 3)).select("src_id", "dst_id"), "LIVES_IN"), "SELECT CAST(c_custkey AS VARCHAR) AS src_id, CAST(c_nationkey AS VARCHAR) AS dst_id FROM customer WHERE c_nationkey = 3")
for _kind in ("SUM", "AVG", "MIN", "MAX"):
    _add(f"{_kind.lower()}_where", _ql(f"{_kind} orders.o_totalprice WHERE o_orderstatus = 'F'", "orders", columns=lambda: [F.round("value", 2).alias("value"), "n_values"]), f"SELECT round({_kind.lower()}(o_totalprice), 2) AS value, count(o_totalprice) AS n_values FROM orders WHERE o_orderstatus = 'F'")
_add("type_counts", _on(analysis.stats, "region", "nation", "customer", "IN_REGION", "LIVES_IN"), "SELECT 'node' AS kind, 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'customer', count(*) FROM customer UNION ALL SELECT 'edge', 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'edge', 'LIVES_IN', count(*) FROM customer")

_add("edge_builder_query", lambda spark, sf_dir: QueryEngine(tables_graph(spark, sf_dir, ("CONTAINS",))).match_edges("CONTAINS").where("n_lines", ">=", 1).where("quantity", ">", 90).execute().df.select("src_id", "dst_id"), "SELECT CAST(l_orderkey AS VARCHAR) AS src_id, CAST(l_partkey AS VARCHAR) AS dst_id FROM lineitem GROUP BY l_orderkey, l_partkey HAVING sum(CAST(l_quantity AS DECIMAL(18, 2))) > 90")


# point lookups and changes
def _table(f: Callable[[PropertyGraph], list[tuple]], schema: str, *only: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.createDataFrame(f(tables_graph(spark, sf_dir, only)), schema)


def _changed(change: Callable[[PropertyGraph], object], then: Callable[[PropertyGraph], DataFrame], *only: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = tables_graph(spark, sf_dir, only)
        change(graph)
        return then(graph)

    return run


_PLACES = ("region", "nation", "IN_REGION")
_in_region = lambda g: g.edges("IN_REGION").select("src_id", "dst_id")
_add("get_node", _table(lambda g: [(n.id, n.properties["c_name"], n.properties["c_acctbal"]) for n in [g.get_node("customer", 7)]], "id string, c_name string, c_acctbal double", "customer"), "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
_add("has_node", _table(lambda g: [(i, g.has_node("nation", i)) for i in ("0", "7", "24", "25", "-1", "07", "x")], "id string, found boolean", "nation"), "SELECT id, id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) AS found FROM (VALUES ('0'), ('7'), ('24'), ('25'), ('-1'), ('07'), ('x')) AS v(id)")
_add("get_edge", _table(lambda g: [(e.source.id, e.target.id, e.properties["n_lines"], e.properties["quantity"]) for r in [g.edge_tables["CONTAINS"].orderBy("src_id", "dst_id").first()] for e in [g.get_edge("CONTAINS", ("orders", r["src_id"]), ("part", r["dst_id"]))]], "src_id string, dst_id string, n_lines long, quantity double", "CONTAINS"), "SELECT CAST(l_orderkey AS VARCHAR) AS src_id, CAST(l_partkey AS VARCHAR) AS dst_id, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_orderkey, l_partkey ORDER BY l_orderkey, l_partkey LIMIT 1")
_add("has_edge", _table(lambda g: [(i, g.has_edge("IN_REGION", ("nation", i), ("region", 1))) for i in range(25)], "id int, found boolean", "IN_REGION"), "SELECT CAST(n_nationkey AS INT) AS id, n_regionkey = 1 AS found FROM nation")
_add("add_node", _changed(lambda g: [g.add_node("nation", i, n_name=f"NEW {i}") for i in (98, 99)], lambda g: g.nodes("nation").select("id", "n_name"), "nation"), "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name FROM nation UNION ALL VALUES ('98', 'NEW 98'), ('99', 'NEW 99')")
_add("add_edge", _changed(lambda g: (g.add_node("nation", 99), g.add_edge("IN_REGION", ("nation", 99), ("region", 2), since=2020)), lambda g: traversal.neighbors(g, ("region", 2), "IN_REGION", Direction.IN), *_PLACES), "SELECT 'nation' AS type, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'nation', '99'")
_add("update_node", _changed(lambda g: g.update_node("nation", 3, n_name="RENAMED", n_size=5), lambda g: g.nodes("nation").select("n_name", F.col("n_size").cast("long").alias("n_size")), "nation"), "SELECT CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN 5 END AS n_size FROM nation")
_add("update_nodes", _changed(lambda g: g.update_nodes("customer", g.nodes("customer").where("c_acctbal < 0").select("id", F.lit("IN DEBT").alias("c_mktsegment"))), lambda g: g.nodes("customer").select("id", "c_mktsegment"), "customer"), "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'IN DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_add("remove_node", _changed(lambda g: g.remove_node("region", 1), lambda g: _in_region(g).unionByName(g.nodes("region").select(F.lit("region").alias("src_id"), F.col("id").cast("string").alias("dst_id"))), *_PLACES), "SELECT CAST(n_nationkey AS VARCHAR) AS src_id, CAST(n_regionkey AS VARCHAR) AS dst_id FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey <> 1")
_add("remove_edge", _changed(lambda g: [g.remove_edge("IN_REGION", ("nation", r["src_id"]), ("region", 4)) for r in g.edges("IN_REGION", target=("region", 4)).collect()], _in_region, *_PLACES), "SELECT CAST(n_nationkey AS VARCHAR) AS src_id, CAST(n_regionkey AS VARCHAR) AS dst_id FROM nation WHERE n_regionkey <> 4")

# traversal
_customers = lambda g: g.refs().where("type = 'customer'")
_add("neighbors_out", _on(lambda g: traversal.neighbors(g, _customers(g), "PLACED").select("start_id", "id"), "customer", "PLACED"), "SELECT CAST(o_custkey AS VARCHAR) AS start_id, CAST(o_orderkey AS VARCHAR) AS id FROM orders")
_add("neighbors_in", _on(lambda g: traversal.neighbors(g, ("nation", 3), None, Direction.IN).select("type", "id"), "LIVES_IN", "BASED_IN"), "SELECT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 3")
_add("neighbors_both", _on(lambda g: traversal.neighbors(g, _customers(g), "REPORTS_TO", Direction.BOTH).select("start_id", "id"), "customer", "REPORTS_TO"), "SELECT CAST(c_custkey AS VARCHAR) AS start_id, CAST(c_custkey // 10 AS VARCHAR) AS id FROM customer WHERE c_custkey > 0 UNION ALL SELECT CAST(c_custkey // 10 AS VARCHAR), CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey > 0")
_add("multi_hop_2", _on(lambda g: traversal.multi_hop(g, _customers(g), "REPORTS_TO", 2).select("start_id", "id"), "customer", "REPORTS_TO"), "SELECT CAST(c_custkey AS VARCHAR) AS start_id, CAST(c_custkey // 100 AS VARCHAR) AS id FROM customer WHERE c_custkey >= 10")
_add("multi_hop_range_1_3", _on(lambda g: traversal.multi_hop_range(g, _customers(g), "REPORTS_TO", 1, 3).select("start_id", "id", F.col("depth").cast("long").alias("depth")), "customer", "REPORTS_TO"), "SELECT CAST(c_custkey AS VARCHAR) AS start_id, CAST(c_custkey // 10 AS VARCHAR) AS id, 1 AS depth FROM customer WHERE c_custkey > 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(c_custkey // 100 AS VARCHAR), 2 FROM customer WHERE c_custkey >= 10 UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(c_custkey // 1000 AS VARCHAR), 3 FROM customer WHERE c_custkey >= 100")
_WALK = [("PLACED", Direction.OUT), ("CONTAINS", Direction.OUT)]
_add("pattern_walk", _on(lambda g: traversal.walk(g, _customers(g), _WALK).select("start_id", "id"), "customer", "PLACED", "CONTAINS"), "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS start_id, CAST(l_partkey AS VARCHAR) AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
_add("pattern_walk_back", _on(lambda g: traversal.walk(g, ("part", 5), [("CONTAINS", Direction.IN), ("PLACED", Direction.IN), ("LIVES_IN", Direction.OUT)]).select("type", "id"), "PLACED", "CONTAINS", "LIVES_IN"), "SELECT DISTINCT 'nation' AS type, CAST(c_nationkey AS VARCHAR) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_partkey = 5")
_add("pattern_query", _on(lambda g: g.query(":customer:7 -[:PLACED]-> *").select("id"), "customer", "PLACED"), "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 7")
_add("fluent_traversal", _on(lambda g: g.start(("region", 1)).hop("IN_REGION", Direction.IN).filter(F.col("id") != "3").hop("LIVES_IN", Direction.IN).frame().select("type", "id"), "IN_REGION", "LIVES_IN"), "SELECT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND n_nationkey <> 3")
_add("traverse_type_filter", _ql("TRAVERSE customer:7 -> PLACED -> orders -> CONTAINS -> part", "customer", "PLACED", "CONTAINS"), "SELECT DISTINCT 'part' AS type, CAST(l_partkey AS VARCHAR) AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7")
_add("traverse_max", _ql("TRAVERSE customer:1234 -> REPORTS_TO -> customer MAX 9", "customer", "REPORTS_TO"), "SELECT 'customer' AS type, CAST(id AS VARCHAR) AS id FROM (VALUES (123), (12), (1), (0)) AS v(id) WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1234)")

# paths
_add("shortest_path_len", _on(lambda g: paths.shortest_lengths(g, ("customer", 7), None, 4).select("type", "id", F.col("length").cast("long").alias("length")), "PLACED", "CONTAINS", "SUPPLIED_BY", "BASED_IN"),
    """WITH o AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7), p AS (SELECT DISTINCT l_partkey AS id FROM lineitem JOIN o ON l_orderkey = o.id), s AS (SELECT DISTINCT l_suppkey AS id FROM lineitem JOIN p ON l_partkey = p.id), n AS (SELECT DISTINCT s_nationkey AS id FROM supplier JOIN s ON s_suppkey = s.id)
    SELECT 'customer' AS type, '7' AS id, 0 AS length UNION ALL SELECT 'orders', CAST(id AS VARCHAR), 1 FROM o UNION ALL SELECT 'part', CAST(id AS VARCHAR), 2 FROM p UNION ALL SELECT 'supplier', CAST(id AS VARCHAR), 3 FROM s UNION ALL SELECT 'nation', CAST(id AS VARCHAR), 4 FROM n""")  # fmt: skip
_add("path_statement", _ql("PATH customer:1234 TO customer:0 VIA REPORTS_TO", "REPORTS_TO", columns=lambda: [F.col("length").cast("long").alias("length"), F.array_join(F.transform("nodes", lambda n: n["id"]), ">").alias("nodes")]), "SELECT 4 AS length, '1234>123>12>1>0' AS nodes FROM customer WHERE c_custkey = 1234")
_add("all_paths", _on(lambda g: paths.all_paths(g, ("customer", 7), ("nation", 3), None, 4).select(F.array_join(F.transform("nodes", lambda n: n["id"]), ">").alias("nodes"), F.col("length").cast("long").alias("length")), "PLACED", "CONTAINS", "SUPPLIED_BY", "BASED_IN"),
    """SELECT concat('7>', o_orderkey, '>', c.l_partkey, '>', s.l_suppkey, '>3') AS nodes, 4 AS length FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) c ON c.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) s ON s.l_partkey = c.l_partkey JOIN supplier ON s_suppkey = s.l_suppkey WHERE o_custkey = 7 AND s_nationkey = 3""")  # fmt: skip
_add("path_any_length", _table(lambda g: [(p.length, ">".join(n.id for n in p.nodes)) for p in [paths.shortest_path(g, ("customer", 1234), ("customer", 19), None, None, Direction.BOTH)] if p], "length long, nodes string", "customer", "REPORTS_TO"), "SELECT 5 AS length, '1234>123>12>1>19' AS nodes FROM customer WHERE FALSE UNION ALL SELECT 4, '1234>123>12>1>19' FROM customer WHERE c_custkey = 1234")
_add("pattern_query_range", _on(lambda g: g.query(":customer:1234 -[:REPORTS_TO*2..3]-> *"), "customer", "REPORTS_TO"), "SELECT 'customer' AS type, id FROM (VALUES ('12'), ('1')) AS v(id) WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1234)")
_add("path_exists", _flag(lambda g: paths.path_exists(g, ("customer", 1234), ("customer", 0), "REPORTS_TO"), "found", "REPORTS_TO"), "SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 1234")

# analysis
_add("degrees", _on(lambda g: analysis.degrees(g, "PLACED"), "customer", "orders", "PLACED"), "SELECT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id, 0 AS in_degree, count(o_orderkey) AS out_degree, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 1, 0, 1 FROM orders")
_add("degree_histogram", _on(lambda g: analysis.degree_histogram(g, "LIVES_IN"), "nation", "customer", "LIVES_IN"), "SELECT degree, count(*) AS n_nodes FROM (SELECT count(c_custkey) AS degree FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 1 FROM customer) GROUP BY degree")
_add("hubs", _on(lambda g: analysis.hubs(g).select("type", "id", "degree", "max_degree"), "nation", "customer", "LIVES_IN"), "WITH d AS (SELECT 'nation' AS type, CAST(n_nationkey AS VARCHAR) AS id, count(c_custkey) AS degree FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 1 FROM customer) SELECT type, id, degree, (SELECT max(degree) FROM d) AS max_degree FROM d WHERE degree > (SELECT avg(degree) FROM d) ORDER BY degree DESC, type, id LIMIT 5")
_add("components", _on(lambda g: analysis.components(g).select("id", "component_id"), "turn", "REPLIES_TO"), "SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, min(CAST(conv_id * 1000 + turn AS VARCHAR)) OVER (PARTITION BY conv_id) AS component_id FROM conversations")
_add("is_connected", _flag(analysis.is_connected, "connected", "nation", "region", "IN_REGION"), "SELECT count(DISTINCT n_regionkey) <= 1 AS connected FROM nation")
_add("has_cycle_tree", _flag(analysis.has_cycle, "cyclic", "customer", "REPORTS_TO"), "SELECT count(*) > 0 AS cyclic FROM customer WHERE c_custkey > 0 AND c_custkey // 10 >= c_custkey")
_add("has_cycle_chain", _flag(analysis.has_cycle, "cyclic", "event", "THEN"), "SELECT FALSE AS cyclic")
_add("has_cycle_ring", lambda spark, sf_dir: spark.createDataFrame([(k, analysis.has_cycle(PropertyGraph(spark, {}, {"THEN": spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("c").alias("src_type"), F.col("c_custkey").alias("src_id"), F.lit("c").alias("dst_type"), ((F.col("c_custkey") + 1) % k).alias("dst_id"))}))) for k in (100, 10**9)], "k long, cyclic boolean"), "SELECT k, count(*) > 0 AS cyclic FROM (VALUES (100)) AS v(k), customer WHERE c_custkey = 99 GROUP BY k UNION ALL SELECT 1000000000, FALSE")
_add("has_cycle_undirected", lambda spark, sf_dir: spark.createDataFrame([(analysis.has_cycle(PropertyGraph(spark, (g := tables_graph(spark, sf_dir, ("customer", "nation", "LIVES_IN", "REPORTS_TO"))).node_tables, g.edge_tables, directed=False)),)], "cyclic boolean"), "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey > 0) > (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) - 1 - (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS cyclic")

# schema
_errors = lambda s: lambda g: s().validate(g).errors.select("code", "location")
_add("validate_fields", _on(_errors(lambda: GraphSchema().node(NodeType("customer").field("c_name", String(required=True, pattern="Customer#[0-9]{9}$")).field("c_acctbal", Float().range(0, 9000)).field("c_mktsegment", String(enum=["BUILDING", "MACHINERY", "AUTOMOBILE", "HOUSEHOLD"])).field("c_phone", String(required=False)))), "customer"),
    "SELECT 'MIN_VALUE' AS code, concat('nodes.customer[', c_custkey, '].c_acctbal') AS location FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'MAX_VALUE', concat('nodes.customer[', c_custkey, '].c_acctbal') FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'INVALID_ENUM', concat('nodes.customer[', c_custkey, '].c_mktsegment') FROM customer WHERE c_mktsegment = 'FURNITURE'")
_add("validate_unique", _on(_errors(lambda: GraphSchema().edge(EdgeType("LINE", unique=True))), "orders", "part", "LINE"), "SELECT 'DUPLICATE_EDGE' AS code, concat('edges.LINE[orders:', l_orderkey, '->part:', l_partkey, ']') AS location FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate) AS n FROM lineitem) WHERE n > 1")
_add("validate_cardinality", _on(_errors(lambda: GraphSchema().edge(EdgeType("PLACED", cardinality="1:1"))), "customer", "orders", "PLACED"), "SELECT 'CARDINALITY_VIOLATION' AS code, concat('edges.PLACED[customer:', o_custkey, ']') AS location FROM orders GROUP BY o_custkey HAVING count(*) > 1")
_add("validate_references", lambda spark, sf_dir: GraphSchema().edge(EdgeType("LIVES_IN")).validate(PropertyGraph(spark, {"nation": (g := tables_graph(spark, sf_dir, ("customer", "nation", "LIVES_IN"))).node_tables["nation"].where("id < 20"), "customer": g.node_tables["customer"]}, g.edge_tables)).errors.select("code", "location"), "SELECT 'REF_NOT_FOUND' AS code, concat('edges.LIVES_IN[customer:', c_custkey, '->nation:', c_nationkey, ']') AS location FROM customer WHERE c_nationkey >= 20")
_add("validate_self_loop_bidirectional", _on(_errors(lambda: GraphSchema().edge(EdgeType("REPORTS_TO", no_self_loop=True, bidirectional=True))), "customer", "REPORTS_TO"), "SELECT 'DUPLICATE_EDGE' AS code, concat('edges.REPORTS_TO[customer:', c_custkey, '->customer:', c_custkey // 10, ']') AS location FROM customer WHERE c_custkey > 0")
_add("validate_orphans", _on(_errors(lambda: GraphSchema(no_orphans=True)), "orders", "CONTAINS"), "SELECT 'ORPHAN_NODE' AS code, concat('nodes.orders[', o_orderkey, ']') AS location FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
_add("validate_endpoints", _on(_errors(lambda: GraphSchema().edge(EdgeType("BASED_IN", source="customer", target="nation"))), "supplier", "nation", "BASED_IN"), "SELECT 'INVALID_SOURCE_TYPE' AS code, concat('edges.BASED_IN[supplier:', s_suppkey, '->nation:', s_nationkey, ']') AS location FROM supplier")
_add("validate_ids", _on(_errors(lambda: GraphSchema().node(NodeType("part", id=Int(max=50)))), "part"), "SELECT 'MAX_VALUE' AS code, concat('nodes.part[', p_partkey, ']') AS location FROM part WHERE p_partkey > 50")
_add("apply_defaults", _on(lambda g: GraphSchema().node(NodeType("nation").field("n_comment", String(default="none"))).apply_defaults(g).nodes("nation").select("n_name", "n_comment"), "nation"), "SELECT n_name, 'none' AS n_comment FROM nation")

_add("validate_bool", _on(_errors(lambda: GraphSchema().node(NodeType("customer").field("c_mktsegment", Bool())).node(NodeType("turn").field("turn", Bool(required=True)))), "customer", "turn"), "SELECT 'INVALID_TYPE' AS code, concat('nodes.customer[', c_custkey, '].c_mktsegment') AS location FROM customer UNION ALL SELECT 'INVALID_TYPE', concat('nodes.turn[', conv_id * 1000 + turn, '].turn') FROM conversations")
_linked = lambda g: g.nodes("customer").withColumn("home", F.when(F.col("id") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.when(F.col("id") % 3 == 1, ":nation:").otherwise(":region:"), (F.col("id") % 25).cast("string"))))
_add("validate_ref", lambda spark, sf_dir: GraphSchema().node(NodeType("customer").field("home", Ref(type="nation"))).validate(PropertyGraph(spark, {"customer": _linked(tables_graph(spark, sf_dir, ("customer",)))})).errors.select("code", "location"), "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'INVALID_TYPE' ELSE 'REF_WRONG_TYPE' END AS code, concat('nodes.customer[', c_custkey, '].home') AS location FROM customer WHERE c_custkey % 3 <> 1")
_add("validate_node_constraint", _on(_errors(lambda: GraphSchema().node(NodeType("part").constraint("small and dear", F.expr("p_size >= 10 OR p_retailprice < 1500")))), "part"), "SELECT 'CUSTOM' AS code, concat('nodes.part[', p_partkey, ']') AS location FROM part WHERE NOT (p_size >= 10 OR p_retailprice < 1500)")
_half = lambda spark, sf_dir: PropertyGraph(spark, (g := tables_graph(spark, sf_dir, ("customer", "REPORTS_TO"))).node_tables, {"REPORTS_TO": g.edge_tables["REPORTS_TO"].withColumn("dst_id", F.when(F.col("src_id") % 7 == 0, F.col("src_id")).otherwise(F.col("dst_id")))})
_add("validate_self_loops", lambda spark, sf_dir: GraphSchema().edge(EdgeType("REPORTS_TO", no_self_loop=True)).validate(_half(spark, sf_dir)).errors.select("code", "location"), "SELECT 'SELF_LOOP' AS code, concat('edges.REPORTS_TO[customer:', c_custkey, '->customer:', c_custkey, ']') AS location FROM customer WHERE c_custkey > 0 AND c_custkey % 7 = 0")
_add("validate_acyclic", lambda spark, sf_dir: GraphSchema().edge(EdgeType("REPORTS_TO", acyclic=True)).validate(_half(spark, sf_dir)).errors.select("code", "location"), "SELECT 'CYCLE_DETECTED' AS code, 'edges.REPORTS_TO' AS location FROM customer WHERE c_custkey > 0 AND c_custkey % 7 = 0 LIMIT 1")
_add("validate_edge_fields", _on(_errors(lambda: GraphSchema().edge(EdgeType("CONTAINS").field("quantity", Float().range(5, 95)).constraint("one line", F.col("n_lines") == 1))), "orders", "part", "CONTAINS"), "WITH c AS (SELECT concat('edges.CONTAINS[orders:', l_orderkey, '->part:', l_partkey, ']') AS base, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_partkey) SELECT 'MIN_VALUE' AS code, concat(base, '.quantity') AS location FROM c WHERE q < 5 UNION ALL SELECT 'MAX_VALUE', concat(base, '.quantity') FROM c WHERE q > 95 UNION ALL SELECT 'CUSTOM', base FROM c WHERE n <> 1")
for _card, _side, _key_column in (("1:N", "dst", "c_nationkey"), ("N:1", "src", "c_custkey")):
    _add(f"validate_cardinality_{_card[0].lower()}_{_card[2].lower()}", _on(_errors(lambda c=_card: GraphSchema().edge(EdgeType("LIVES_IN", cardinality=c))), "customer", "nation", "LIVES_IN"), f"SELECT 'CARDINALITY_VIOLATION' AS code, concat('edges.LIVES_IN[{'nation' if _side == 'dst' else 'customer'}:', {_key_column}, ']') AS location FROM customer GROUP BY {_key_column} HAVING count(*) > 1")
_add("validate_connected", _on(_errors(lambda: GraphSchema(connected=True)), *_PLACES), "SELECT 'NOT_CONNECTED' AS code, 'graph' AS location FROM nation HAVING count(DISTINCT n_regionkey) > 1 OR (SELECT count(*) FROM region) > count(DISTINCT n_regionkey)")
_add("validate_graph_constraint", _on(_errors(lambda: GraphSchema().constraint(lambda g: [f"{n} nations" for n in [g.node_count("nation")] if n > 20]).constraint(lambda g: ["no regions"] if not g.node_count("region") else [])), "nation", "region"), "SELECT 'CUSTOM' AS code, 'graph' AS location FROM nation HAVING count(*) > 20")

# sources and sinks
_add("line_format", _on(text.to_lines, "customer", "LIVES_IN"), "SELECT concat('nodes.customer|id c_acctbal c_mktsegment c_name|', c_custkey, ' ', c_acctbal, ' ', c_mktsegment, ' ', c_name) AS value FROM customer UNION ALL SELECT concat('edges.LIVES_IN|source target|:customer:', c_custkey, ' :nation:', c_nationkey) FROM customer")
_add("line_round_trip", lambda spark, sf_dir: text.from_lines(spark, text.to_lines(tables_graph(spark, sf_dir, ("part",)))).nodes("part").select("id", "p_name", "p_size", "p_retailprice"), "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, p_size, p_retailprice FROM part")
_add("block_format", lambda spark, sf_dir: spark.createDataFrame([(x,) for x in text.to_blocks(tables_graph(spark, sf_dir, ("region", "nation", "IN_REGION"))).split("\n") if x], "line string"), "SELECT 'nodes.nation' AS line UNION ALL SELECT 'id n_name' UNION ALL SELECT concat(n_nationkey, ' ', n_name) FROM nation UNION ALL SELECT 'nodes.region' UNION ALL SELECT 'id r_name' UNION ALL SELECT concat(r_regionkey, ' ', CASE WHEN contains(r_name, ' ') THEN concat('\"', r_name, '\"') ELSE r_name END) FROM region UNION ALL SELECT 'edges.IN_REGION' UNION ALL SELECT 'source target' UNION ALL SELECT concat(':nation:', n_nationkey, ' :region:', n_regionkey) FROM nation")
_add("export_cypher", _on(lambda g: exporters.export(g, "cypher").select("value"), "nation", "IN_REGION"), "SELECT concat('CREATE (n_nation_', n_nationkey, ':nation {id: \"', n_nationkey, '\", n_name: \"', n_name, '\"})') AS value FROM nation UNION ALL SELECT concat('CREATE (n_nation_', n_nationkey, ')-[:IN_REGION {}]->(n_region_', n_regionkey, ')') FROM nation")
_add("block_round_trip", lambda spark, sf_dir: text.from_blocks(spark, text.to_blocks(tables_graph(spark, sf_dir, _PLACES))).edges("IN_REGION").select("src_id", "dst_id"), "SELECT CAST(n_nationkey AS VARCHAR) AS src_id, CAST(n_regionkey AS VARCHAR) AS dst_id FROM nation")


def _forms(region: str, nation: str, edge: str) -> str:
    """SQL of an export of the regions and nations; {i} and {n} are a node's id and name, {a} and {b} an edge's ends."""
    fill = lambda form, **by: "concat(" + ", ".join(by[x] if k % 2 else f"'{x}'" for k, x in enumerate(re.split(r"\{(\w)\}", form))) + ")"
    return f"SELECT CAST(0 AS INT) AS part, {fill(region, i='r_regionkey', n='r_name')} AS value FROM region UNION ALL SELECT 0, {fill(nation, i='n_nationkey', n='n_name')} FROM nation UNION ALL SELECT 1, {fill(edge, a='n_nationkey', b='n_regionkey')} FROM nation"


for _form, _node_form, _edge_form in (
    ("json", '{"type":"{t}","id":"{i}","{f}":"{n}"}', '{"type":"IN_REGION","source":{"type":"nation","id":"{a}"},"target":{"type":"region","id":"{b}"}}'),
    ("json_compact", '{"type":"{t}","id":"{i}","{f}":"{n}"}', '{"type":"IN_REGION","source":{"type":"nation","id":"{a}"},"target":{"type":"region","id":"{b}"}}'),
    ("json_ld", '{"@id":"urn:{t}_{i}","@type":"{t}","{f}":"{n}"}', '{"@id":"urn:nation_{a}","IN_REGION":{"@id":"urn:region_{b}"}}'),
    ("turtle", ':{t}_{i} a :{t} ;\n  :{f} "{n}" .', ":nation_{a} :IN_REGION :region_{b} ."),
    ("graphml", '<node id="{t}_{i}"><data key="type">{t}</data><data key="{f}">{n}</data></node>', '<edge source="nation_{a}" target="region_{b}"><data key="type">IN_REGION</data></edge>'),
    ("gml", 'node [ id "{t}_{i}" type "{t}" {f} "{n}" ]', 'edge [ source "nation_{a}" target "region_{b}" label "IN_REGION"  ]'),
    ("toon", '{t}: "{i}","{n}"', "IN_REGION: nation_{a},region_{b}"),
):
    _whole = lambda kind, name, form=_node_form: form.replace("{t}", kind).replace("{f}", name)
    _add(f"export_{_form}", _on(lambda g, f=_form: exporters.export(g, f), *_PLACES), _forms(_whole("region", "r_name"), _whole("nation", "n_name"), _edge_form))

# layout
_add("layout_circular", _on(lambda g: layout.circular_layout(g.refs()).select("type", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")), "nation"), "SELECT 'nation' AS type, CAST(n_nationkey AS VARCHAR) AS id, round(450 + 200 * cos((row_number() OVER (ORDER BY CAST(n_nationkey AS VARCHAR)) - 1) * 2 * pi() / count(*) OVER ()), 6) AS x, round(300 + 200 * sin((row_number() OVER (ORDER BY CAST(n_nationkey AS VARCHAR)) - 1) * 2 * pi() / count(*) OVER ()), 6) AS y FROM nation")
_add("layout_hierarchical", _on(lambda g: layout.hierarchical_layout(g.refs()).select("type", "id", F.round("x", 6).alias("x"), "y"), "region", "nation"), "SELECT 'nation' AS type, CAST(n_nationkey AS VARCHAR) AS id, round(row_number() OVER (ORDER BY CAST(n_nationkey AS VARCHAR)) * 900.0 / (count(*) OVER () + 1), 6) AS x, 50.0 AS y FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), round(row_number() OVER (ORDER BY CAST(r_regionkey AS VARCHAR)) * 900.0 / (count(*) OVER () + 1), 6), 200.0 FROM region")
_add("layout_force", lambda spark, sf_dir: spark.createDataFrame([(r.type, r.id, x, y) for r, (x, y) in layout.compute_layout(tables_graph(spark, sf_dir, ("region", "nation", "IN_REGION"))).items()], "type string, id string, x double, y double"))
