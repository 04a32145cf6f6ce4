"""Text formats, dictionaries, exporters, streaming, layouts."""

import json
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from graphloom.model import DuplicateEdgeError, DuplicateNodeError, GraphError, NodeRef, PropertyGraph
from graphloom.operators import layout
from graphloom.sources import dicts, exporters, text
from graphloom.sources.values import FormatError
from graphloom.streaming import ingest

ODD = {"title": "Hello World", "tag": "a|b", "body": "line1\nline2", "note": "", "quote": 'say "hi"', "path": "c:\\new\tx", "number": "30", "flag": "true", "none": "null", "sharp": "#x"}


@pytest.fixture
def graph(spark):
    g = PropertyGraph(spark, name="g")
    g.add_node("doc", 1, **ODD, size=5, share=0.5, on=True)
    g.add_node("doc", 2, title="x", gone=None)
    g.add_node("city", "b", name="B")
    g.add_edge("IN", ("doc", 1), ("city", "b"), since=2020, why="a b")
    g.add_edge("NEXT", ("doc", 1), ("doc", 2))
    return g


def same(a, b):
    for g in (a, b):
        g._flush()
    for kind in ("nodes", "edges"):
        left, right = (sorted(map(repr, (sorted((k, v) for k, v in r.asDict().items() if v is not None and k not in ("_seq", "_nulls")) for df in getattr(g, f"_{kind}").values() for r in df.collect()))) for g in (a, b))
        assert left == right


def test_blocks_round_trip(spark, graph, tmp_path):
    made = text.to_blocks(graph)
    assert made.startswith("nodes.city\nid name\nb B\n\nnodes.doc\n") and ":doc:1 :city:b" in made
    same(graph, text.from_blocks(spark, made))
    text.save(graph, str(tmp_path / "g.graph"))
    again = text.load(spark, str(tmp_path / "g.graph"))
    assert again.name == "g"
    same(graph, again)


def test_lines_round_trip(spark, graph, tmp_path):
    same(graph, text.from_lines(spark, text.to_lines(graph)))
    text.save(graph, str(tmp_path / "g.isonl"))
    same(graph, text.load(spark, str(tmp_path / "g.isonl")))


def test_tabs_comments_and_aliases(spark):
    g = text.from_blocks(spark, "# a graph\ngraph.social\n\nnodes.person\nid\tname\tage\n1\tAlice\t30\n2\t\"Bob B\"\t~\n\nedges.KNOWS\nfrom\tto\n:person:1\t:person:2\n")
    assert g.get_node("person", 1).properties == {"name": "Alice", "age": 30} and g.get_node("person", 2).properties == {"name": "Bob B", "age": None}
    assert g.has_edge("KNOWS", "person:1", "person:2")


@pytest.mark.parametrize("bad", [
    "nodes.p\nid name\n1\n", "nodes.p\nname\nx\n", "edges.E\nsource\n:p:1\n", "edges.E\ntarget\n:p:1\n", "things.p\nid\n1\n", "nodes\nid\n1\n", "nodes.p\nid\n1\n1\n", "nodes.p\nid\n1\n\nedges.E\nsource target\n:p:1 :p:2\n",
    "nodes.p\nid\n1\n\nedges.E\nsource target\np1 :p:1\n", "nodes.p\nid\n1\n\nedges.E\nsource target\n:p:1 :p:1\n:p:1 :p:1\n", 'nodes.p\nid name\n1 "x\n',
])
def test_malformed_blocks(spark, bad):
    with pytest.raises((FormatError, GraphError)):
        text.from_blocks(spark, bad)


@pytest.mark.parametrize("bad", ["nodes.p|id|1 2", "nodes.p|name|x", "edges.E|source|:p:1", "things.p|id|1", "garbage", 'nodes.p|id name|1 "x', "nodes.p|id|1\nnodes.p|id|1", "nodes.p|id|1\nedges.E|source target|:p:1 :p:9"])
def test_malformed_lines(spark, bad):
    lines = spark.createDataFrame([(x,) for x in bad.split("\n")], "value string")
    with pytest.raises(FormatError):
        text.from_lines(spark, lines)
    assert text.from_lines(spark, lines, permissive=True).edge_count() == 0


def test_dictionaries(spark, graph):
    same(graph, dicts.from_dict(spark, dicts.to_dict(graph)))
    g = dicts.from_dict(spark, {"nodes": [{"id": 1, "name": "a"}, {"id": 2}], "edges": [{"source": 1, "target": "2", "w": 3}]})
    assert g.get_edge("RELATED_TO", ("entity", 1), ("entity", 2)).properties == {"w": 3}
    with pytest.raises(DuplicateNodeError):
        dicts.from_dict(spark, {"nodes": [{"id": 1}, {"id": 1}]})
    with pytest.raises(DuplicateEdgeError):
        dicts.from_dict(spark, {"nodes": [{"id": 1}], "edges": [{"source": 1, "target": 1}] * 2})
    assert all(json.loads(r["value"]) for r in dicts.to_json_lines(graph).collect())


def test_parquet_store(spark, graph, tmp_path):
    dicts.save_parquet(graph, str(tmp_path / "store"))
    again = dicts.load_parquet(spark, str(tmp_path / "store"))
    same(graph, again)
    assert again.name == "g" and again.directed


def test_exports(graph):
    for form in exporters.FORMATS:
        assert "Hello World" in exporters.document(graph, form)
    assert len(json.loads(exporters.document(graph, "json"))["nodes"]) == 3 and json.loads(exporters.document(graph, "json_ld"))["@graph"]
    assert len(xml.dom.minidom.parseString(exporters.document(graph, "graphml")).getElementsByTagName("node")) == 3
    assert 'CREATE (n_doc_1)-[:IN {since: 2020, why: "a b"}]->(n_city_b)' in exporters.document(graph, "cypher")
    with pytest.raises(ValueError):
        exporters.export(graph, "dot")


def test_streaming_ingest(spark, graph, tmp_path):
    text.to_lines(graph).write.text(str(tmp_path / "in"))
    ingest.write_tables(ingest.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("error IS NULL").count() == 5 and got.where(F.col("properties")["title"] == "Hello World").count() == 1
    q = ingest.running_counts(ingest.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["kind"], r["name"]): r["n"] for r in spark.table("counts").collect()} == {("nodes", "doc"): 2, ("nodes", "city"): 1, ("edges", "IN"): 1, ("edges", "NEXT"): 1}


@pytest.fixture(scope="module")
def team(spark):
    g = PropertyGraph(spark)
    for i, name in (("alice", "Alice"), ("bob", "Bob"), ("carol", "Carol")):
        g.add_node("person", i, name=name)
    g.add_node("company", "acme", name="Acme")
    g.add_node("project", "p1", name="Alpha")
    for rel, a, b in (("KNOWS", ("person", "alice"), ("person", "bob")), ("KNOWS", ("person", "bob"), ("person", "carol")), ("WORKS_AT", ("person", "alice"), ("company", "acme")), ("WORKS_ON", ("person", "carol"), ("project", "p1"))):
        g.add_edge(rel, a, b)
    return g


def test_tab_blocks(spark):
    """Values by tabs, sections without empty lines, other names of the ends, the first field as id."""
    read = "graph.demo\nnodes.person\nid\tname\tage\nalice\tAlice A. Smith\t30\n\nbob\t\"Bob\"\t41\n# a comment\nnodes.city\ncode\tname\nx1\tNew York\nedges.LIVES_IN\nfrom\tto\tsince\nperson:alice\t:city:x1\t2001\n"
    g = text.from_blocks(spark, read)
    assert g.get_node("person", "alice").properties == {"name": "Alice A. Smith", "age": 30} and g.get_node("person", "bob").properties["name"] == "Bob"
    assert g.get_node("city", "x1").properties == {"name": "New York"}
    assert g.get_edge("LIVES_IN", ("person", "alice"), ("city", "x1")).properties == {"since": 2001}
    for bad in ("nodes.a\nid\tx\n1\n", "nodes.a\nid\tx\n1\t2\t3\n", "edges.R\nfrom\tx\na:1\t2\n"):
        with pytest.raises(text.FormatError):
            text.from_blocks(spark, bad)


def test_lines_of_pairs(spark):
    read = ['graph.demo', "# note", 'nodes.person alice name="Alice A." age=30', "nodes.person bob", "nodes.city|id name|x1 \"New York\"", "edges.LIVES_IN :person:alice :city:x1 since=2001 main=true"]
    g = text.from_lines(spark, spark.createDataFrame([(x,) for x in read], "value string"))
    assert g.get_node("person", "alice").properties == {"name": "Alice A.", "age": 30} and g.get_node("person", "bob").properties == {}
    assert g.get_edge("LIVES_IN", ("person", "alice"), ("city", "x1")).properties == {"since": 2001, "main": True}
    for bad in ("nodes.person eve nonsense", "edges.R :person:alice", "nodes.person eve a=1 a=2"):
        with pytest.raises(text.FormatError):
            text.from_lines(spark, spark.createDataFrame([(x,) for x in [*read, bad]], "value string"))


def test_layout_is_the_known_one_to_the_last_bit(team):
    assert layout.compute_layout(team) == {
        NodeRef("company", "acme"): (60.0, 60.0), NodeRef("person", "alice"): (293.3277424315421, 60.0), NodeRef("person", "bob"): (377.3280362355162, 354.58580004430877),
        NodeRef("person", "carol"): (601.3804168633184, 540.0), NodeRef("project", "p1"): (840.0, 540.0),
    }


def test_what_goes_to_the_driver_is_bounded(team, monkeypatch):
    from graphloom.operators import common

    monkeypatch.setattr(common.held_by_driver, "__defaults__", (5,))
    for run in (lambda: text.to_blocks(team), lambda: dicts.to_dict(team), lambda: exporters.document(team, "json")):
        with pytest.raises(common.TooLargeError):
            run()
    monkeypatch.setattr(layout._bounded, "__defaults__", (2,))
    for run in (layout.circular_layout, layout.hierarchical_layout):
        with pytest.raises(common.TooLargeError):
            run(team.refs())


def test_layout_bounds(team, spark):
    with pytest.raises(layout.TooLargeError):
        layout.compute_layout(team, most=3)
    assert layout.compute_layout(PropertyGraph(spark)) == {}
    radii = dict.fromkeys(layout.compute_layout(team), 80.0)
    p = list(layout.compute_layout(team, radii=radii).values())
    assert min((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 for i, a in enumerate(p) for b in p[i + 1 :]) ** 0.5 > 150


def test_drawings(team, tmp_path):
    svg = layout.render_svg(team, label="name")
    assert svg.count('class="node"') == 5 and svg.count('class="edge"') == 4 and ">Alice<" in svg
    xml.dom.minidom.parseString(svg)
    layout.save(team, str(tmp_path / "g.html"), label="name")
    assert "Alice" in (tmp_path / "g.html").read_text()
    assert layout.circular_layout(team.refs()).count() == 5 and layout.hierarchical_layout(team.refs()).select("y").distinct().count() == 3


def test_command(team, tmp_path):
    (tmp_path / "g.graph").write_text(text.to_blocks(team))
    assert layout.main([str(tmp_path / "g.graph"), str(tmp_path / "o.svg"), "--label", "name"]) == 0
    assert (tmp_path / "o.svg").read_text().startswith("<svg")
