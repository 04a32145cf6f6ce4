"""Shortest and simple paths: breadth-first search level by level; each node carries the way it was found by, whose order is that of a queue."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Direction, Edge, NodeRef, Path, PropertyGraph
from .common import BROADCAST_ROWS, cut
from .traversal import _levels, reach, small, starts_of, steps

PATH_SCHEMA = "nodes array<struct<type:string,id:string>>, edges array<struct<rel_type:string,src_type:string,src_id:string,dst_type:string,dst_id:string>>, length int"


def path_frame(spark: SparkSession, paths: list[Path]) -> DataFrame:
    return spark.createDataFrame([([tuple(n) for n in p.nodes], [(e.rel_type, *e.source, *e.target) for e in p.edges], p.length) for p in paths], PATH_SCHEMA)


def shortest_path(graph: PropertyGraph, start: Any, end: Any, rel: str | None = None, max_hops: int | None = 10, direction: Direction = Direction.OUT) -> Path | None:
    """The first shortest path a queue would find (parents in order of discovery, edges out before edges in, by edge order); at most max_hops edges, or of any length where that is None. A start that is the end needs no edge and no node."""
    start, end = NodeRef.of(start), NodeRef.of(end)
    if start == end:
        return Path((start,), ())
    step = steps(graph, rel, direction).withColumnsRenamed({"a_type": "type", "a_id": "id"})
    level = cut(graph.spark.createDataFrame([(*start, [])], f"type string, id string, way {WAY}"))
    seen = level.select("type", "id")
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        joined = small(level)[0].join(step, ["type", "id"])
        here = F.struct("turned", F.col("_seq").alias("seq"), "rel_type", F.col("b_type").alias("type"), F.col("b_id").alias("id"))
        ways = joined.select(F.col("b_type").alias("type"), F.col("b_id").alias("id"), F.array_append("way", here).alias("way"))
        # ways of one length compare by the parent's place in its level, then by the edge
        level = cut(ways.groupBy("type", "id").agg(F.min("way").alias("way")).join(seen, ["type", "id"], "left_anti"))
        if level.isEmpty():
            return None
        found = level.where((F.col("type") == end.type) & (F.col("id") == end.id)).first()
        if found:
            return _path_of(start, found["way"])
        seen = seen.unionByName(level.select("type", "id"))
    return None


WAY = "array<struct<turned:int,seq:string,rel_type:string,type:string,id:string>>"


def _path_of(start: NodeRef, way: list) -> Path:
    nodes, edges = [start], []
    for s in way:
        nodes.append(NodeRef(s["type"], s["id"]))
        edges.append(Edge(s["rel_type"], *(reversed(nodes[-2:]) if s["turned"] else nodes[-2:])))
    return Path(tuple(nodes), tuple(edges))


def shortest_lengths(graph: PropertyGraph, start: Any, rel: str | None = None, max_hops: int = 10, direction: Direction = Direction.OUT) -> DataFrame:
    """(type, id, length) of every node within max_hops, by one breadth-first search."""
    return _levels(graph, start, rel, max_hops, direction, False).select("type", "id", F.col("depth").alias("length"))


def path_exists(graph: PropertyGraph, start: Any, end: Any, rel: str | None = None, max_hops: int = 10, direction: Direction = Direction.OUT) -> bool:
    start, end = NodeRef.of(start), NodeRef.of(end)
    if start == end:
        return True
    seen = cut(starts_of(graph, start))
    front = small(seen)[0]
    for _ in range(max_hops):
        new = cut(reach(graph, front, rel, direction).distinct().join(seen, ["type", "id"], "left_anti").select("start_type", "start_id", "type", "id"))
        front, n = small(new)
        if not n:
            return False
        if not new.where((F.col("type") == end.type) & (F.col("id") == end.id)).isEmpty():
            return True
        seen = seen.unionByName(new)
    return False


def all_paths(graph: PropertyGraph, start: Any, end: Any, rel: str | None = None, max_hops: int = 5, direction: Direction = Direction.OUT) -> DataFrame:
    """All paths of at most max_hops edges without a repeated node: (nodes, edges, length). Parallel relations give paths of their own; a step against an edge gives it reversed.

    The search is pruned to nodes whose distances from start and to end fit the bound; then paths grow by one join a level.
    """
    start, end = NodeRef.of(start), NodeRef.of(end)
    if start == end:
        return path_frame(graph.spark, [Path((start,), ())])
    back = {Direction.OUT: Direction.IN, Direction.IN: Direction.OUT}.get(direction, Direction.BOTH)
    ahead = _levels(graph, start, rel, max_hops, direction, False).select("type", "id", F.col("depth").alias("df"))
    behind = _levels(graph, end, rel, max_hops, back, False).select("type", "id", F.col("depth").alias("db"))
    useful = cut(ahead.join(behind, ["type", "id"]).where(F.col("df") + F.col("db") <= max_hops).select("type", "id", "db"))
    ref = lambda t, i: F.struct(F.col(t).alias("type"), F.col(i).alias("id"))
    near = useful.select(F.col("type").alias("b_type"), F.col("id").alias("b_id"), "db")
    step = steps(graph, rel, direction).join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, ["b_type", "b_id"])
    step = cut(step.select(ref("a_type", "a_id").alias("a"), ref("b_type", "b_id").alias("b"), F.struct("rel_type", F.col("a_type").alias("src_type"), F.col("a_id").alias("src_id"), F.col("b_type").alias("dst_type"), F.col("b_id").alias("dst_id")).alias("e"), "db"))
    here = graph.spark.createDataFrame([([tuple(start)], [], 0)], PATH_SCHEMA)
    goal = F.struct(F.lit(end.type).alias("type"), F.lit(end.id).alias("id"))
    found = None
    for depth in range(1, max_hops + 1):
        grown = here.join(step, F.element_at("nodes", -1) == F.col("a")).where(~F.array_contains("nodes", F.col("b")) & (F.col("db") <= max_hops - depth))
        grown = cut(grown.select(F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("edges", F.col("e")).alias("edges"), F.lit(depth).alias("length")))
        done = F.element_at("nodes", -1) == goal
        found = grown.where(done) if found is None else found.unionByName(grown.where(done))
        here = grown.where(~done)
        if here.isEmpty():
            break
    return found if found is not None else path_frame(graph.spark, [])
