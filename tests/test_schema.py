"""Schema validation: every code, and defaults."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators.schema import Bool, EdgeType, Float, GraphSchema, Int, NodeType, Ref, String


def codes(graph, *kinds, **rules):
    s = GraphSchema(**rules)
    for k in kinds:
        (s.node if isinstance(k, NodeType) else s.edge)(k)
    return s.validate(graph).codes()


def pair(spark, edges=((1, 2),), n=2, **props):
    g = PropertyGraph(spark)
    for i in range(1, n + 1):
        g.add_node("person", i, **(props if i == 1 else {}))
    for a, b in edges:
        g.add_edge("KNOWS", ("person", a), ("person", b))
    return g


@pytest.mark.parametrize("field,value,expected", [
    (String(), 5, ["INVALID_TYPE"]), (String(min_length=3), "ab", ["MIN_LENGTH"]), (String(max_length=3), "abcd", ["MAX_LENGTH"]), (String(pattern="[A-Z]+"), "a1", ["PATTERN_MISMATCH"]),
    (String(email=True), "nope", ["INVALID_EMAIL"]), (String(email=True), "a@b.org", []), (String(enum=["x", "y"]), "z", ["INVALID_ENUM"]), (Int(), True, ["INVALID_TYPE"]), (Int(), "12", []), (Int(), "x", ["INVALID_TYPE"]),
    (Int().range(0, 150), 151, ["MAX_VALUE"]), (Int(min=0), -1, ["MIN_VALUE"]), (Float(), 3, []), (Float(max=1.0), 1.5, ["MAX_VALUE"]), (Float(), True, ["INVALID_TYPE"]), (Bool(), True, []), (Bool(), 1, ["INVALID_TYPE"]),
    (Ref(), ":person:2", []), (Ref(), "person", ["INVALID_TYPE"]), (Ref(type="company"), ":person:2", ["REF_WRONG_TYPE"]), (Ref(type="person"), ("person", 2), []),
])
def test_fields(spark, field, value, expected):
    assert codes(pair(spark, v=value), NodeType("person").field("v", field)) == expected


def test_required_and_defaults(spark):
    g = pair(spark, v=1)
    assert codes(g, NodeType("person").field("v", Int(required=True))) == ["REQUIRED_FIELD"]
    assert codes(g, NodeType("person").field("w", Int(required=True))) == ["REQUIRED_FIELD"] * 2
    s = GraphSchema().node(NodeType("person").field("v", Int(required=True, default=7)))
    assert s.validate(g).is_valid
    assert sorted(r["v"] for r in s.apply_defaults(g).nodes("person").collect()) == [1, 7]
    assert codes(g, NodeType("person", id=Int(max=1))) == ["MAX_VALUE"]


@pytest.mark.parametrize("kind,edges,expected", [
    (EdgeType("KNOWS", source="company"), [(1, 2)], ["INVALID_SOURCE_TYPE"]), (EdgeType("KNOWS", target="company"), [(1, 2)], ["INVALID_TARGET_TYPE"]),
    (EdgeType("KNOWS", no_self_loop=True), [(1, 1)], ["SELF_LOOP"]), (EdgeType("KNOWS", bidirectional=True), [(1, 2)], ["DUPLICATE_EDGE"]), (EdgeType("KNOWS", bidirectional=True), [(1, 2), (2, 1)], []),
    (EdgeType("KNOWS", acyclic=True), [(1, 2), (2, 1)], ["CYCLE_DETECTED"]), (EdgeType("KNOWS", acyclic=True), [(1, 2)], []),
    (EdgeType("KNOWS", cardinality="1:1"), [(1, 2), (1, 3), (2, 3)], ["CARDINALITY_VIOLATION"] * 2), (EdgeType("KNOWS", cardinality="N:1"), [(1, 2), (1, 3)], ["CARDINALITY_VIOLATION"]),
    (EdgeType("KNOWS", cardinality="1:N"), [(1, 2), (1, 3)], []), (EdgeType("KNOWS", cardinality="1:N"), [(1, 3), (2, 3)], ["CARDINALITY_VIOLATION"]), (EdgeType("OTHER", no_self_loop=True), [(1, 1)], []),
])
def test_edges(spark, kind, edges, expected):
    assert codes(pair(spark, edges, 3), kind) == expected


def test_bulk_rules(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "a long, b long")
    g = PropertyGraph.from_tables(spark, {"n": (nodes, "id", [])}, {"E": (edges, ("n", "a"), ("n", "b"), [])})
    assert codes(g, EdgeType("E", unique=True)) == ["DUPLICATE_EDGE", "REF_NOT_FOUND"]


def test_graph_rules(spark):
    g = pair(spark, [(1, 2)], 3)
    assert codes(g, connected=True) == ["NOT_CONNECTED"] and codes(g, no_orphans=True) == ["ORPHAN_NODE"]
    assert codes(g, max_depth=1) == []
    s = GraphSchema().constraint(lambda graph: ["too small"] if graph.node_count() < 9 else [])
    assert s.validate(g).codes() == ["CUSTOM"]
    t = NodeType("person").field("v", Int()).constraint("id over 2", F.col("id") > 2)
    assert codes(g, t) == ["CUSTOM"] * 2
    assert codes(g, NodeType("person").constraint("function", lambda df: df.where("id = 3"))) == ["CUSTOM"]
    with pytest.raises(ValueError):
        EdgeType("X", cardinality="2:2")


def test_one_scan_for_all_row_rules(spark, tmp_path):
    spark.range(5).selectExpr("id", "id as v", "cast(id as string) as w").write.parquet(str(tmp_path / "n"))
    g = PropertyGraph(spark, {"n": spark.read.parquet(str(tmp_path / "n"))})
    s = GraphSchema().node(NodeType("n").field("v", Int(max=3)).field("w", String(max_length=0)))
    plan = s.validate(g).errors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
