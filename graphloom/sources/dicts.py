"""Graphs as dictionaries, JSON lines and Parquet folders."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HIDDEN, KEY, NodeRef, PropertyGraph
from ..operators.common import held_by_driver


def to_dict(graph: PropertyGraph) -> dict[str, Any]:
    """For graphs that the driver can hold (MOST_ROWS, else an error). A node's properties stand beside its type and id."""
    held_by_driver(graph)
    nodes = []
    for t, df in graph.node_tables.items():
        nodes += [{"type": t, "id": str(r["id"])} | {k: v for k, v in r.asDict().items() if k != "id" and k not in HIDDEN and v is not None} for r in df.collect()]
    edges = []
    for rel, df in graph.edge_tables.items():
        for r in df.collect():
            own = {k: v for k, v in r.asDict().items() if k not in KEY and k not in HIDDEN and v is not None}
            edges.append({"rel_type": rel, "source": {"type": r["src_type"], "id": str(r["src_id"])}, "target": {"type": r["dst_type"], "id": str(r["dst_id"])}, "properties": own})
    return {"name": graph.name, "directed": graph.directed, "nodes": nodes, "edges": edges}


def from_dict(spark: SparkSession, data: dict[str, Any]) -> PropertyGraph:
    """Nodes without a type are `entity`, edges without one RELATED_TO; an edge's properties may stand inline. An end is {type, id}, a pair, `:type:id` or a node's id alone."""
    graph = PropertyGraph(spark, directed=data.get("directed", True), name=data.get("name", "graph"))
    by_id: dict[str, NodeRef] = {}
    for n in data.get("nodes", []):
        ref = graph.add_node(n.get("type", "entity"), n["id"], **{k: v for k, v in n.items() if k not in ("type", "id", "properties")} | n.get("properties", {}))
        by_id.setdefault(ref.id, ref)

    def end(v: Any) -> NodeRef:
        if isinstance(v, dict):
            return NodeRef.of((v["type"], v["id"]))
        if isinstance(v, (list, tuple)):
            return NodeRef.of(tuple(v))
        return NodeRef.of(v) if isinstance(v, str) and ":" in v else by_id.get(str(v), NodeRef("entity", str(v)))

    for e in data.get("edges", []):
        fixed = ("rel_type", "type", "source", "target", "properties")
        graph.add_edge(e.get("rel_type", e.get("type", "RELATED_TO")), end(e["source"]), end(e["target"]), **{k: v for k, v in e.items() if k not in fixed} | e.get("properties", {}))
    return graph


def to_json_lines(graph: PropertyGraph) -> DataFrame:
    """(value): one JSON object for each node and edge, written by the executors."""
    nodes = graph.nodes().select(F.to_json(F.struct(F.lit("node").alias("kind"), "type", "id", "properties")).alias("value"))
    edges = graph.edges().select(F.to_json(F.struct(F.lit("edge").alias("kind"), "rel_type", *KEY, "properties")).alias("value"))
    return nodes.unionByName(edges)


def save_parquet(graph: PropertyGraph, path: str) -> None:
    """One folder for each type and relation: scans read only what they need, with filters pushed down."""
    for kind, tables in (("nodes", graph.node_tables), ("edges", graph.edge_tables)):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
    rows = [(kind, name, graph.name, graph.directed) for kind, tables in (("nodes", graph.node_tables), ("edges", graph.edge_tables)) for name in tables]
    graph.spark.createDataFrame(rows, "kind string, table string, graph string, directed boolean").coalesce(1).write.mode("overwrite").json(f"{path}/catalogue")


def load_parquet(spark: SparkSession, path: str) -> PropertyGraph:
    rows = spark.read.schema("kind string, table string, graph string, directed boolean").json(f"{path}/catalogue").orderBy("kind", "table").collect()
    read = lambda kind: {r["table"]: spark.read.parquet(f"{path}/{kind}/{r['table']}") for r in rows if r["kind"] == kind}
    return PropertyGraph(spark, read("nodes"), read("edges"), rows[0]["directed"] if rows else True, rows[0]["graph"] if rows else "graph")
