"""Neighbours, hops, walks and the fluent traversal. Every operator takes one start or a table of starts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as st

from ..model import Direction, NodeRef, PropertyGraph
from ..plans.parser import Step
from .common import BROADCAST_ROWS, cut

START = ("start_type", "start_id")


def steps(graph: PropertyGraph, rel: str | Iterable[str] | None, direction: Direction = Direction.OUT) -> DataFrame:
    """(a_type, a_id, b_type, b_id, ...): where one step leads, duplicates kept; `turned` marks a step against its edge."""
    e = graph.links(rel)
    out = e.select("rel_type", "_seq", *(F.col(f"{x}_{y}").alias(f"{z}_{y}") for x, z in (("src", "a"), ("dst", "b")) for y in ("type", "id")), F.lit(0).alias("turned"))
    if direction is Direction.OUT:
        return out
    back = e.select("rel_type", "_seq", *(F.col(f"{x}_{y}").alias(f"{z}_{y}") for x, z in (("dst", "a"), ("src", "b")) for y in ("type", "id")), F.lit(1).alias("turned"))
    return back if direction is Direction.IN else out.unionByName(back)


def _native(id: Column, kind: st.DataType) -> Column:
    """A node's id as the key column of an edge table has it, so that the tables' own keys are joined; null where it can't be one of them."""
    if not isinstance(kind, st.IntegralType):
        return id
    key = id.try_cast(kind)
    return F.when(key.cast("string") == id, key)


def reach(graph: PropertyGraph, front: DataFrame, rel: str | Iterable[str] | None, direction: Direction, more: Iterable[str] = START) -> DataFrame:
    """(*more, type, id): where one step from the rows of front (*more, type, id) leads; duplicates occur. Each relation's table is joined as it is stored, by its own keys: nothing of the edges is copied, and a broadcast front moves none of them."""
    rels = [rel] if isinstance(rel, str) else None if rel is None else list(rel)
    out = None
    for name, df in graph.edge_tables.items():
        if rels is not None and name not in rels:
            continue
        for a, b, wanted in (("src", "dst", Direction.OUT), ("dst", "src", Direction.IN)):
            if graph.directed and direction not in (wanted, Direction.BOTH):
                continue
            kind = df.schema[f"{a}_id"].dataType
            key = F.col(f"{a}_id") if isinstance(kind, (st.IntegralType, st.StringType)) else F.col(f"{a}_id").cast("string")
            e = df.select(F.col(f"{a}_type").alias("_a_type"), key.alias("_a_id"), F.col(f"{b}_type").alias("_b_type"), F.col(f"{b}_id").cast("string").alias("_b_id"))
            own = e.join(front.withColumn("_key", _native(F.col("id"), kind)), (F.col("_a_type") == F.col("type")) & (F.col("_a_id") == F.col("_key")))
            own = own.select(*more, F.col("_b_type").alias("type"), F.col("_b_id").alias("id"))
            out = own if out is None else out.unionByName(own)
    return out if out is not None else front.select(*more, "type", "id").limit(0)


def small(front: DataFrame) -> tuple[DataFrame, int]:
    """A cut frontier, broadcast where it has few rows, and their number."""
    n = front.count()
    return (F.broadcast(front) if n <= BROADCAST_ROWS else front), n


def starts_of(graph: PropertyGraph, start: Any) -> DataFrame:
    """A start, or a table with (type, id), as (start_type, start_id, type, id)."""
    if isinstance(start, DataFrame):
        df = start.select(F.col("type").cast("string"), F.col("id").cast("string")).distinct()
    else:
        df = graph.spark.createDataFrame([tuple(NodeRef.of(start))], "type string, id string")
    return df.select(F.col("type").alias("start_type"), F.col("id").alias("start_id"), "type", "id")


def _result(df: DataFrame, batch: bool, *more: str) -> DataFrame:
    return df.select(*(START if batch else ()), "type", "id", *more)


def _follow(front: DataFrame, step: DataFrame) -> DataFrame:
    """One step of a frontier; no more than an equi-join, so that Catalyst may broadcast the smaller side by its own size."""
    joined = front.join(step, (front["type"] == step["a_type"]) & (front["id"] == step["a_id"]))
    return joined.select(*START, F.col("b_type").alias("type"), F.col("b_id").alias("id"))


def neighbors(graph: PropertyGraph, start: Any, rel: str | None = None, direction: Direction = Direction.OUT, distinct: bool = False) -> DataFrame:
    """(type, id) of all neighbours; with a table of starts also (start_type, start_id). A node appears once for each edge that leads to it."""
    batch = isinstance(start, DataFrame)
    if batch:
        out = _follow(starts_of(graph, start), steps(graph, rel, direction))
    else:
        ref = NodeRef.of(start)
        e = [graph.edges(rel, source=ref).select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"))] if direction is not Direction.IN else []
        e += [graph.edges(rel, target=ref).select(F.col("src_type").alias("type"), F.col("src_id").alias("id"))] if direction is not Direction.OUT else []
        out = e[0] if len(e) == 1 else e[0].unionByName(e[1])
    out = _result(out, batch)
    return out.distinct() if distinct else out


def _levels(graph: PropertyGraph, start: Any, rel: str | None, most: int, direction: Direction, lazy: bool) -> DataFrame:
    """(start_type, start_id, type, id, depth) of all nodes within `most` hops, the start itself at 0. Lazy plans chain the levels; else each level is cut."""
    seen = starts_of(graph, start).withColumn("depth", F.lit(0))
    if not lazy:
        seen = cut(seen)
    front = seen if lazy else small(seen)[0]
    for depth in range(1, most + 1):
        new = reach(graph, front.drop("depth"), rel, direction).distinct().join(seen.drop("depth"), [*START, "type", "id"], "left_anti").withColumn("depth", F.lit(depth))
        front, n = (new, 1) if lazy else small(new := cut(new))
        if not n:
            break
        seen = seen.unionByName(new)
    return seen


#: Hops up to which a plan is one lazy chain of joins.
LAZY_HOPS = 3


def multi_hop(graph: PropertyGraph, start: Any, rel: str | None, hops: int = 1, direction: Direction = Direction.OUT) -> DataFrame:
    """Nodes at a distance of exactly `hops`; the start where hops < 1."""
    seen = _levels(graph, start, rel, max(0, hops), direction, hops <= LAZY_HOPS)
    return _result(seen.where(F.col("depth") == max(0, hops)), isinstance(start, DataFrame))


def multi_hop_range(graph: PropertyGraph, start: Any, rel: str | None, least: int = 1, most: int = 3, direction: Direction = Direction.OUT) -> DataFrame:
    """Nodes at distances from `least` to `most`, with their depth; never the start."""
    seen = _levels(graph, start, rel, most, direction, most <= LAZY_HOPS)
    return _result(seen.where((F.col("depth") >= max(1, least)) & (F.col("depth") <= most)), isinstance(start, DataFrame), "depth")


def walk(graph: PropertyGraph, start: Any, pattern: list[tuple[str, Direction]], keep: Column | Callable | None = None) -> DataFrame:
    """Nodes at the end of walks along the pattern: a set at each step, nothing is remembered, one lazy chain of joins.

    keep: a Column over (type, id), or a function from such a DataFrame to the rows that stay, applied at every step.
    """
    front = starts_of(graph, start)
    for rel, direction in pattern:
        front = _kept(reach(graph, front, rel, direction).distinct(), keep)
    return _result(front, isinstance(start, DataFrame))


def _kept(df: DataFrame, keep: Column | Callable | None) -> DataFrame:
    if keep is None:
        return df
    return df.where(keep) if isinstance(keep, Column) else keep(df)


def traverse_statement(graph: PropertyGraph, start: NodeRef, pattern: list[Step], most: int | None) -> DataFrame:
    """The TRAVERSE statement: steps that remember visited nodes and keep those of the target type; then, where MAX is larger than the pattern, further hops along its last relation and direction, of any type, all united."""
    if not graph.has_node(*start):
        return graph.refs().limit(0)
    seen = cut(starts_of(graph, start))
    front, out = small(seen)[0], seen
    for s in pattern:
        new = reach(graph, front, s.relation, s.direction).distinct()
        if s.target:
            new = new.where(F.col("type") == s.target)
        out = cut(new.join(seen, ["type", "id"], "left_anti").select(*START, "type", "id"))
        front = small(out)[0]
        seen = seen.unionByName(out)
    if most is not None and most > len(pattern):
        last = pattern[-1] if pattern else Step(Direction.OUT, None)
        for _ in range(most - len(pattern)):
            new = cut(reach(graph, front, last.relation, last.direction).distinct().join(seen, ["type", "id"], "left_anti").select(*START, "type", "id"))
            front, n = small(new)
            if not n:
                break
            seen, out = seen.unionByName(new), out.unionByName(new)
    return out.select("type", "id")


_PATTERN = re.compile(r"\s*:(?P<type>[^:\s]+):(?P<id>\S+)\s+-\[:(?P<rel>\w+)(?:\*(?P<lo>\d+)(?:\.\.(?P<hi>\d+))?)?\]->\s*\*\s*")


def pattern_query(graph: PropertyGraph, text: str) -> DataFrame:
    """`:type:id -[:REL]-> *`, `*N` for exactly N hops, `*N..M` for a range."""
    m = _PATTERN.fullmatch(text)
    if not m:
        raise ValueError(f"not a pattern: {text!r}")
    ref = NodeRef(m["type"], m["id"])
    if m["lo"] is None:
        return neighbors(graph, ref, m["rel"])
    if m["hi"] is None:
        return multi_hop(graph, ref, m["rel"], int(m["lo"]))
    return multi_hop_range(graph, ref, m["rel"], int(m["lo"]), int(m["hi"])).select("type", "id")


class GraphTraversal:
    """Fluent traversal. Visited nodes are remembered over hops; a node that hop(where=...) turns down isn't visited, one that filter() drops stays so."""

    def __init__(self, graph: PropertyGraph, start: NodeRef):
        self.graph = graph
        self._front = starts_of(graph, start).select("type", "id")
        self._seen = self._front
        self._hops = 0

    def hop(self, rel: str | None = None, direction: Direction = Direction.OUT, where: Column | Callable | None = None) -> GraphTraversal:
        new = reach(self.graph, self._front, rel, direction, ()).distinct()
        new = _kept(new.join(self._seen, ["type", "id"], "left_anti"), where)
        self._hops += 1
        self._front = cut(new) if self._hops > LAZY_HOPS else new
        self._seen = self._seen.unionByName(self._front)
        return self

    def hops(self, n: int, rel: str | None = None, direction: Direction = Direction.OUT) -> GraphTraversal:
        for _ in range(n):
            self.hop(rel, direction)
        return self

    def filter(self, keep: Column | Callable) -> GraphTraversal:
        self._front = _kept(self._front, keep)
        return self

    def frame(self) -> DataFrame:
        return self._front

    def collect(self) -> list[NodeRef]:
        return [NodeRef(*r) for r in self._front.orderBy("type", "id").collect()]

    def collect_nodes(self):
        return [self.graph.get_node(*r) for r in self.collect()]

    def count(self) -> int:
        return self._front.count()

    def first(self) -> NodeRef | None:
        r = self._front.orderBy("type", "id").first()
        return NodeRef(*r) if r else None
