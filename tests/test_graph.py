"""Graph model, traversal, paths and analysis on small explicit graphs."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import Direction, DuplicateEdgeError, DuplicateNodeError, EdgeNotFoundError, InvalidIdentifierError, NodeNotFoundError, NodeRef, PropertyGraph
from graphloom.operators import analysis, paths, traversal


def refs(df):
    return sorted((r["type"], r["id"]) for r in df.collect())


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    g = PropertyGraph(spark)
    for i in range(1, 6):
        g.add_node("person", i, name=f"P{i}")
    g.add_node("company", 100, name="C")
    for i in range(1, 5):
        g.add_edge("KNOWS", ("person", i), ("person", i + 1))
    g.add_edge("WORKS_AT", ("person", 2), ("company", 100))
    return g


def diamond(spark):
    g = PropertyGraph(spark)
    for i in range(1, 6):
        g.add_node("n", i)
    for a, b in ((1, 2), (2, 3), (2, 4), (3, 5), (4, 5)):
        g.add_edge("E", ("n", a), ("n", b))
    return g


def small(spark, n, edges, directed=True):
    g = PropertyGraph(spark, directed=directed)
    for i in range(1, n + 1):
        g.add_node("n", i)
    for a, b, *rel in edges:
        g.add_edge(rel[0] if rel else "E", ("n", a), ("n", b))
    return g


def test_additions_and_lookups(spark):
    g = PropertyGraph(spark)
    g.add_node("person", 1, name="Alice", age=30)
    g.add_node("person", 2, name="Bob", age=None)
    g.add_edge("KNOWS", ("person", 1), "person:2", since=2020)
    assert g.get_node("person", 1).properties == {"name": "Alice", "age": 30}
    assert g.get_edge("KNOWS", ("person", 1), ("person", 2)).properties == {"since": 2020}
    assert g.get_node("person", 2).properties == {"name": "Bob", "age": None}
    with pytest.raises(DuplicateNodeError):
        g.add_node("person", 1)
    with pytest.raises(DuplicateEdgeError):
        g.add_edge("KNOWS", ("person", 1), ("person", 2))
    with pytest.raises(NodeNotFoundError):
        g.add_edge("KNOWS", ("person", 1), ("person", 9))
    with pytest.raises(EdgeNotFoundError):
        g.get_edge("KNOWS", ("person", 2), ("person", 1))
    with pytest.raises(InvalidIdentifierError):
        g.add_node("a:b", 1)
    assert (g.node_count(), g.node_count("person"), g.node_count("x"), g.edge_count(), g.edge_count("KNOWS")) == (2, 2, 0, 1, 1)
    g.add_node("person", 3, age=3)
    g.update_node("person", 1, age=31, city="NYC")
    assert g.get_node("person", 1).properties == {"name": "Alice", "age": 31, "city": "NYC"}
    g.add_edge("KNOWS", ("person", 2), ("person", 3))
    g.remove_node("person", 2)
    assert (g.node_count(), g.edge_count()) == (2, 0)
    assert g.node_types() == ["person"] and g.edge_types() == ["KNOWS"]


def test_undirected_edges_are_seen_from_both_ends(spark):
    g = small(spark, 3, [(1, 2), (2, 3)], directed=False)
    assert g.edge_count() == 4 and g.has_edge("E", ("n", 2), ("n", 1))
    assert ids(traversal.neighbors(g, ("n", 2), "E")) == ["1", "3"]
    g.remove_edge("E", ("n", 2), ("n", 1))
    assert g.edge_count() == 2
    with pytest.raises(DuplicateEdgeError):
        g.add_edge("E", ("n", 3), ("n", 2))


def test_bulk_patch(spark):
    g = small(spark, 2, [])
    g.update_nodes("n", spark.createDataFrame([("1", 5)], "id string, score int"))
    assert {r["id"]: r["score"] for r in g.nodes("n").collect()} == {"1": 5, "2": None}


def test_scans_push_typed_filters(spark, tmp_path):
    spark.range(100).selectExpr("id as a", "id + 1 as b").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    g = PropertyGraph.from_tables(spark, {"n": (e, "a", [])}, {"E": (e, ("n", "a"), ("n", "b"), [])})
    found = g.edges("E", source=("n", 7))
    assert [(r["src_id"], r["dst_id"]) for r in found.collect()] == [("7", "8")]
    assert "EqualTo(a,7)" in found._jdf.queryExecution().executedPlan().toString()
    assert g.edges("E", source=("n", "x")).isEmpty()


@pytest.mark.parametrize("n,expected", [(0, ["1"]), (1, ["2"]), (2, ["3"]), (3, ["4"]), (4, ["5"]), (5, [])])
def test_multi_hop_is_exact_distance(chain, n, expected):
    assert ids(traversal.multi_hop(chain, ("person", 1), "KNOWS", n)) == expected


def test_ranges_walks_and_patterns(chain):
    found = traversal.multi_hop_range(chain, ("person", 1), "KNOWS", 1, 3)
    assert {(r["id"], r["depth"]) for r in found.collect()} == {("2", 1), ("3", 2), ("4", 3)}
    assert ids(traversal.walk(chain, ("person", 1), [("KNOWS", Direction.OUT), ("WORKS_AT", Direction.OUT)])) == ["100"]
    assert ids(traversal.walk(chain, ("person", 1), [("KNOWS", Direction.OUT), ("KNOWS", Direction.IN)])) == ["1"]
    assert ids(chain.query(":person:1 -[:KNOWS]-> *")) == ["2"]
    assert ids(chain.query(":person:1 -[:KNOWS*2]-> *")) == ["3"]
    assert ids(chain.query(":person:1 -[:KNOWS*1..3]-> *")) == ["2", "3", "4"]
    with pytest.raises(ValueError):
        chain.query(":person:1 -[:KNOWS]-> person")
    starts = chain.refs().where("type = 'person'")
    batch = traversal.multi_hop(chain, starts, "KNOWS", 2)
    assert sorted((r["start_id"], r["id"]) for r in batch.collect()) == [("1", "3"), ("2", "4"), ("3", "5")]


def test_neighbors_keep_duplicates(spark):
    g = small(spark, 2, [(1, 2), (1, 2, "R"), (2, 1)])
    assert ids(traversal.neighbors(g, ("n", 1))) == ["2", "2"]
    assert ids(traversal.neighbors(g, ("n", 1), direction=Direction.BOTH)) == ["2", "2", "2"]
    assert ids(traversal.neighbors(g, ("n", 1), distinct=True)) == ["2"]


def test_fluent_traversal_remembers(spark):
    g = small(spark, 4, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (2, 3)])
    assert g.start(("n", 1)).hop("E").collect() == [NodeRef("n", "2"), NodeRef("n", "3")]
    assert g.start(("n", 1)).hops(2, "E").collect() == [NodeRef("n", "4")]
    # a node that hop(where) turns down can be met later; one that filter() drops can't
    assert g.start(("n", 1)).hop("E", where=F.col("id") == "2").hop("E").collect() == [NodeRef("n", "3"), NodeRef("n", "4")]
    assert g.start(("n", 1)).hop("E").filter(F.col("id") == "2").hop("E").collect() == [NodeRef("n", "4")]
    assert g.start(("n", 1)).hop("E").count() == 2 and g.start(("n", 1)).hops(9, "E").first() is None


def test_shortest_paths(spark):
    g = diamond(spark)
    p = paths.shortest_path(g, ("n", 1), ("n", 5))
    assert p.length == 3 and [n.id for n in p.nodes] == ["1", "2", "3", "5"]
    assert paths.shortest_path(g, ("n", 1), ("n", 5), max_hops=2) is None
    assert paths.shortest_path(g, ("n", 1), ("n", 5), max_hops=3).length == 3
    assert paths.shortest_path(g, ("n", 5), ("n", 1)) is None and not paths.path_exists(g, ("n", 5), ("n", 1))
    back = paths.shortest_path(g, ("n", 5), ("n", 1), direction=Direction.IN)
    assert back.length == 3 and back.edges[0].source == NodeRef("n", "3") and back.edges[0].target == NodeRef("n", "5")
    assert paths.shortest_path(g, ("n", 9), ("n", 9)).length == 0
    assert paths.path_exists(g, ("n", 1), ("n", 5)) and not paths.path_exists(g, ("n", 1), ("n", 5), max_hops=2)
    assert {(r["id"], r["length"]) for r in paths.shortest_lengths(g, ("n", 1)).collect()} == {("1", 0), ("2", 1), ("3", 2), ("4", 2), ("5", 3)}


def test_all_paths(spark):
    g = diamond(spark)
    found = paths.all_paths(g, ("n", 1), ("n", 5)).collect()
    assert sorted([n["id"] for n in r["nodes"]] for r in found) == [["1", "2", "3", "5"], ["1", "2", "4", "5"]]
    assert paths.all_paths(g, ("n", 1), ("n", 5), max_hops=2).isEmpty()
    assert [r["length"] for r in paths.all_paths(g, ("n", 1), ("n", 1)).collect()] == [0]
    g = small(spark, 2, [(1, 2), (1, 2, "R")])
    assert paths.all_paths(g, ("n", 1), ("n", 2)).count() == 2
    turned = paths.all_paths(g, ("n", 2), ("n", 1), "E", direction=Direction.IN).first()["edges"][0]
    assert (turned["src_id"], turned["dst_id"]) == ("2", "1")


def test_components_and_connectivity(spark):
    assert analysis.is_connected(PropertyGraph(spark))
    g = small(spark, 4, [(1, 2), (3, 4)])
    assert analysis.component_count(g) == 2
    assert {(r["id"], r["component_id"]) for r in analysis.components(g).collect()} == {("1", "1"), ("2", "1"), ("3", "3"), ("4", "3")}
    g = small(spark, 2, [(1, 2)])
    assert analysis.is_connected(g)
    g.add_node("n", 3)
    assert not analysis.is_connected(g)
    assert analysis.component_count(small(spark, 30, [(i, i + 1) for i in range(1, 30)])) == 1


@pytest.mark.parametrize("n,edges,directed,cyclic", [
    (3, [(1, 2), (2, 3)], True, False), (3, [(1, 2), (2, 3), (3, 1)], True, True), (1, [(1, 1)], True, True),
    (2, [(1, 2)], False, False), (3, [(1, 2), (2, 3)], False, False), (3, [(1, 2), (2, 3), (3, 1)], False, True),
    (2, [(1, 2), (1, 2, "R")], False, True), (1, [(1, 1)], False, True), (0, [], True, False),
])
def test_cycles(spark, n, edges, directed, cyclic):
    assert analysis.has_cycle(small(spark, n, edges, directed)) is cyclic


def test_long_chain(spark):
    g = small(spark, 2000, [(i, i + 1) for i in range(1, 2000)])
    assert not analysis.has_cycle(g)
    g.add_edge("E", ("n", 2000), ("n", 1))
    assert analysis.has_cycle(g)


def test_degrees(spark):
    g = small(spark, 3, [(1, 2), (1, 1), (2, 1)])
    found = {r["id"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in analysis.degrees(g).collect()}
    assert found == {"1": (2, 2, 4), "2": (1, 1, 2), "3": (0, 0, 0)}
    assert analysis.degree_of(g, ("n", 1)) == (2, 2, 4) and analysis.degree_of(g, ("n", 9)) == (0, 0, 0)
    u = small(spark, 2, [(1, 2), (1, 2, "R")], directed=False)
    assert {r["id"]: r["degree"] for r in analysis.degrees(u).collect()} == {"1": 1, "2": 1}
    assert [r["id"] for r in analysis.hubs(g).collect()] == ["1"]
    assert {(r["kind"], r["name"], r["n"]) for r in analysis.stats(g).collect()} == {("node", "n", 3), ("edge", "E", 3)}
