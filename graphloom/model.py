"""Property graph on DataFrames: a table for each node type and each relation type, typed columns, lazy views."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

NULLS = "_nulls"
SEQ = "_seq"
KEY = ("src_type", "src_id", "dst_type", "dst_id")
HIDDEN = (NULLS, SEQ)


class GraphError(Exception):
    """Base of all graph errors."""


class NodeNotFoundError(GraphError):
    pass


class EdgeNotFoundError(GraphError):
    pass


class DuplicateNodeError(GraphError):
    pass


class DuplicateEdgeError(GraphError):
    pass


class InvalidIdentifierError(GraphError):
    pass


class NodeRef(NamedTuple):
    """A node's type and id; ids compare as strings."""

    type: str
    id: str

    @staticmethod
    def of(value: NodeRef | tuple | str) -> NodeRef:
        if isinstance(value, str):
            kind, _, own = value.removeprefix(":").partition(":")
            return NodeRef(kind, own)
        return NodeRef(value[0], str(value[1]))


class Direction(Enum):
    OUT = "out"
    IN = "in"
    BOTH = "both"


@dataclass(frozen=True)
class Node:
    """Equal by reference, whatever the properties."""

    type: str
    id: str
    properties: dict[str, Any] = field(default_factory=dict, compare=False)

    @property
    def ref(self) -> NodeRef:
        return NodeRef(self.type, self.id)


@dataclass(frozen=True)
class Edge:
    rel_type: str
    source: NodeRef
    target: NodeRef
    properties: dict[str, Any] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodeRef, ...] = ()
    edges: tuple[Edge, ...] = ()

    @property
    def length(self) -> int:
        return len(self.edges)

    @property
    def start(self) -> NodeRef | None:
        return self.nodes[0] if self.nodes else None

    @property
    def end(self) -> NodeRef | None:
        return self.nodes[-1] if self.nodes else None


def _spark_type(values: list[Any]) -> st.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return st.BooleanType()
    if kinds == {int}:
        return st.LongType()
    if kinds and kinds <= {int, float}:
        return st.DoubleType()
    return st.StringType()


def _fit(value: Any, kind: st.DataType) -> Any:
    if value is None or isinstance(kind, (st.BooleanType, st.LongType)):
        return value
    if isinstance(kind, st.DoubleType):
        return float(value)
    if isinstance(value, tuple) and len(value) == 2:
        return f":{value[0]}:{value[1]}"
    return value if isinstance(value, str) else json.dumps(value)


def _name(kind: str, *more: str) -> None:
    for x in (kind, *more):
        if ":" in str(x):
            raise InvalidIdentifierError(f"a ':' in {x!r}")


class PropertyGraph:
    """Nodes by type (id, properties...) and edges by relation (src_type, src_id, dst_type, dst_id, properties...).

    SQL NULL means that a property is absent; the optional column `_nulls` lists those that are explicitly null. Single
    additions are buffered and become rows of the tables at the next read. An undirected graph stores each edge once
    and its views add the reverse.
    """

    def __init__(self, spark: SparkSession, nodes: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None, directed: bool = True, name: str = "graph"):
        self.spark, self.directed, self.name = spark, directed, name
        self._nodes, self._edges = dict(nodes or {}), dict(edges or {})
        self._new_nodes: dict[str, dict[str, dict[str, Any]]] = {}
        self._new_edges: dict[str, dict[tuple, dict[str, Any]]] = {}
        self._serial = 0
        self._key_sets: dict[str, set] = {}

    @classmethod
    def from_tables(cls, spark: SparkSession, nodes: dict[str, tuple], edges: dict[str, tuple], **more) -> PropertyGraph:
        """nodes: type -> (df, id column, [properties]); edges: relation -> (df, (source type, column), (target type, column), [properties])."""
        made = {t: df.select(F.col(key).alias("id"), *props) for t, (df, key, props) in nodes.items()}
        linked = {r: df.select(F.lit(s[0]).alias("src_type"), F.col(s[1]).alias("src_id"), F.lit(t[0]).alias("dst_type"), F.col(t[1]).alias("dst_id"), *props) for r, (df, s, t, props) in edges.items()}
        return cls(spark, made, linked, **more)

    # buffered additions

    def _flush(self) -> None:
        for kind, rows in list(self._new_nodes.items()):
            made = self._frame([({"id": i}, props) for i, props in rows.items()], ["id"])
            self._nodes[kind] = self._nodes[kind].withColumn("id", F.col("id").cast("string")).unionByName(made, allowMissingColumns=True) if kind in self._nodes else made
        for rel, rows in list(self._new_edges.items()):
            made = self._frame([(dict(zip((*KEY, SEQ), key, strict=True)), props) for key, props in rows.items()], [*KEY, SEQ])
            old = self._edges.get(rel)
            self._edges[rel] = made if old is None else old.withColumns({c: F.col(c).cast("string") for c in KEY}).unionByName(made, allowMissingColumns=True)
        self._new_nodes, self._new_edges = {}, {}

    def _frame(self, rows: list[tuple[dict, dict]], fixed: list[str]) -> DataFrame:
        keys = sorted({k for _, props in rows for k in props})
        kinds = {k: _spark_type([p.get(k) for _, p in rows]) for k in keys}
        nulls = any(v is None for _, p in rows for v in p.values())
        schema = st.StructType([*(st.StructField(c, st.LongType() if c == SEQ else st.StringType()) for c in fixed), *(st.StructField(k, kinds[k]) for k in keys), *([st.StructField(NULLS, st.ArrayType(st.StringType()))] if nulls else [])])
        data = [(*(f[c] for c in fixed), *(_fit(p.get(k), kinds[k]) for k in keys), *([[k for k, v in p.items() if v is None]] if nulls else [])) for f, p in rows]
        return self.spark.createDataFrame(data, schema)

    def add_node(self, type: str, id: Any, **props: Any) -> NodeRef:
        _name(type, str(id))
        ref = NodeRef(type, str(id))
        if self.has_node(*ref):
            raise DuplicateNodeError(f"{ref} exists")
        self._new_nodes.setdefault(type, {})[ref.id] = props
        return ref

    def add_edge(self, rel: str, source: Any, target: Any, **props: Any) -> None:
        source, target = NodeRef.of(source), NodeRef.of(target)
        for ref in (source, target):
            if not self.has_node(*ref):
                raise NodeNotFoundError(f"no node {ref}")
        if self.has_edge(rel, source, target):
            raise DuplicateEdgeError(f"{rel} from {source} to {target} exists")
        self._serial += 1
        self._new_edges.setdefault(rel, {})[(*source, *target, self._serial)] = props
        self._keys(rel).add((*source, *target))

    def _keys(self, rel: str) -> set:
        """Keys of buffered edges, for constant-time checks."""
        return self._key_sets.setdefault(rel, set())

    # scans and point lookups

    @property
    def node_tables(self) -> dict[str, DataFrame]:
        self._flush()
        return self._nodes

    @property
    def edge_tables(self) -> dict[str, DataFrame]:
        self._flush()
        return self._edges

    def node_types(self) -> list[str]:
        return list(self.node_tables)

    def edge_types(self) -> list[str]:
        return list(self.edge_tables)

    def nodes(self, type: str | None = None) -> DataFrame:
        """One type's table, or all as (type, id, properties as JSON)."""
        if type is not None:
            return self.node_tables[type] if type in self.node_tables else self.spark.createDataFrame([], "id string")
        parts = [df.select(F.lit(t).alias("type"), F.col("id").cast("string").alias("id"), properties(df, ("id",)).alias("properties")) for t, df in self.node_tables.items()]
        return _union(parts, self.spark, "type string, id string, properties string")

    def edges(self, rel: str | None = None, source: Any = None, target: Any = None) -> DataFrame:
        """(rel_type, src_type, src_id, dst_type, dst_id, properties as JSON); endpoint filters reach the scans as typed comparisons."""
        parts = []
        for r, df in self.edge_tables.items():
            if rel not in (None, r):
                continue
            df = both_ways(df) if not self.directed else df
            for side, ref in (("src", source), ("dst", target)):
                if ref is not None:
                    df = df.where(at(df, side, NodeRef.of(ref)))
            parts.append(df.select(F.lit(r).alias("rel_type"), *(F.col(c).cast("string").alias(c) for c in KEY), properties(df, KEY).alias("properties")))
        return _union(parts, self.spark, "rel_type string, src_type string, src_id string, dst_type string, dst_id string, properties string")

    def links(self, rels: Iterable[str] | str | None = None) -> DataFrame:
        """Edge keys (rel_type, src_type, src_id, dst_type, dst_id, _seq) as strings, for traversal."""
        rels = [rels] if isinstance(rels, str) else None if rels is None else list(rels)
        parts = []
        for r, df in self.edge_tables.items():
            if rels is None or r in rels:
                df = both_ways(df) if not self.directed else df
                seq = F.col(SEQ).cast("string") if SEQ in df.columns else F.concat_ws("\0", *(F.col(c).cast("string") for c in KEY))
                parts.append(df.select(F.lit(r).alias("rel_type"), *(F.col(c).cast("string").alias(c) for c in KEY), F.lpad(seq, 20, "0").alias(SEQ) if SEQ in df.columns else seq.alias(SEQ)))
        return _union(parts, self.spark, "rel_type string, src_type string, src_id string, dst_type string, dst_id string, _seq string")

    def refs(self) -> DataFrame:
        """(type, id) of all nodes."""
        return _union([df.select(F.lit(t).alias("type"), F.col("id").cast("string").alias("id")) for t, df in self.node_tables.items()], self.spark, "type string, id string")

    def node_count(self, type: str | None = None) -> int:
        tables = self.node_tables
        return sum(df.count() for t, df in tables.items() if type in (None, t))

    def edge_count(self, rel: str | None = None) -> int:
        return sum((df if self.directed else both_ways(df)).count() for r, df in self.edge_tables.items() if rel in (None, r))

    def get_node(self, type: str, id: Any) -> Node:
        if str(id) in self._new_nodes.get(type, {}):
            return Node(type, str(id), dict(self._new_nodes[type][str(id)]))
        df = self._nodes.get(type)
        row = None if df is None else df.where(same(df, "id", str(id))).first()
        if row is None:
            raise NodeNotFoundError(f"no node {type}:{id}")
        return Node(type, str(id), _values(row, ("id",)))

    def has_node(self, type: str, id: Any) -> bool:
        try:
            self.get_node(type, id)
        except NodeNotFoundError:
            return False
        return True

    def get_edge(self, rel: str, source: Any, target: Any) -> Edge:
        source, target = NodeRef.of(source), NodeRef.of(target)
        self._flush()
        df = self._edges.get(rel)
        df = df if df is None or self.directed else both_ways(df)
        row = None if df is None else df.where(at(df, "src", source) & at(df, "dst", target)).first()
        if row is None:
            raise EdgeNotFoundError(f"no {rel} from {source} to {target}")
        return Edge(rel, source, target, _values(row, KEY))

    def has_edge(self, rel: str, source: Any, target: Any) -> bool:
        source, target = NodeRef.of(source), NodeRef.of(target)
        keys = self._keys(rel)
        if (*source, *target) in keys or not self.directed and (*target, *source) in keys:
            return True
        if rel not in self._edges:
            return False
        df = self._edges[rel]
        found = at(df, "src", source) & at(df, "dst", target)
        if not self.directed:
            found = found | (at(df, "src", target) & at(df, "dst", source))
        return not df.where(found).isEmpty()

    # changes

    def update_node(self, type: str, id: Any, **props: Any) -> None:
        """Merges properties into one node."""
        old = self.get_node(type, id)
        if str(id) in self._new_nodes.get(type, {}):
            self._new_nodes[type][str(id)] = old.properties | props
            return
        df, hit = self._nodes[type], same(self._nodes[type], "id", str(id))
        for k, v in props.items():
            kind = df.schema[k].dataType if k in df.columns else _spark_type([v])
            now = F.lit(None).cast(kind) if v is None else F.lit(_fit(v, kind)).cast(kind)
            df = df.withColumn(k, F.when(hit, now).otherwise(F.col(k) if k in df.columns else F.lit(None).cast(kind)))
        self._nodes[type] = df

    def update_nodes(self, type: str, patch: DataFrame) -> None:
        """Merges a table of patches (id, properties...) by one join: a patch's values win where they aren't null."""
        df = self.node_tables[type]
        new = [c for c in patch.columns if c != "id"]
        joined = df.join(patch.select("id", *(F.col(c).alias(f"_p_{c}") for c in new)), "id", "left")
        merged = {c: F.coalesce(f"_p_{c}", c) if c in df.columns else F.col(f"_p_{c}") for c in new}
        self._nodes[type] = joined.withColumns(merged).drop(*(f"_p_{c}" for c in new))

    def remove_node(self, type: str, id: Any) -> None:
        """Removes a node with all edges into and out of it."""
        ref = NodeRef(type, str(id))
        if not self.has_node(*ref):
            raise NodeNotFoundError(f"no node {ref}")
        self._flush()
        self._key_sets = {}
        df = self._nodes[type].where(~same(self._nodes[type], "id", ref.id))
        if df.isEmpty():
            del self._nodes[type]
        else:
            self._nodes[type] = df
        for rel, e in self._edges.items():
            self._edges[rel] = e.where(~(at(e, "src", ref) | at(e, "dst", ref)))

    def remove_edge(self, rel: str, source: Any, target: Any) -> None:
        source, target = NodeRef.of(source), NodeRef.of(target)
        self.get_edge(rel, source, target)
        self._key_sets = {}
        df = self._edges[rel]
        gone = at(df, "src", source) & at(df, "dst", target)
        if not self.directed:
            gone = gone | (at(df, "src", target) & at(df, "dst", source))
        self._edges[rel] = df.where(~gone)

    # queries that read like the operators

    def start(self, ref: Any):
        from .operators.traversal import GraphTraversal

        return GraphTraversal(self, NodeRef.of(ref))

    def query(self, pattern: str) -> DataFrame:
        from .operators.traversal import pattern_query

        return pattern_query(self, pattern)


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def properties(df: DataFrame, fixed: Iterable[str]) -> Column:
    """All other columns as one JSON object; absent ones are left out."""
    own = [c for c in df.columns if c not in fixed and c not in HIDDEN]
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in own))) if own else F.lit("{}")


def _values(row, fixed: Iterable[str]) -> dict[str, Any]:
    every = row.asDict()
    nulls = every.get(NULLS) or []
    return {k: v for k, v in every.items() if k not in fixed and k not in HIDDEN and (v is not None or k in nulls)}


def both_ways(df: DataFrame) -> DataFrame:
    """An undirected relation's edges in both directions, each key once; a self-loop stays one edge."""
    turned = df.withColumns({"src_type": F.col("dst_type"), "src_id": F.col("dst_id"), "dst_type": F.col("src_type"), "dst_id": F.col("src_id")})
    return df.unionByName(turned).dropDuplicates(list(KEY))


def same(df: DataFrame, column: str, id: str) -> Column:
    """column = id, with the id cast to the column's type, so that the comparison can reach the scan."""
    kind = df.schema[column].dataType
    if isinstance(kind, st.IntegralType):
        return F.col(column) == F.lit(int(id)) if id.lstrip("-").isdigit() and str(int(id)) == id else F.lit(False)
    return (F.col(column) if isinstance(kind, st.StringType) else F.col(column).cast("string")) == F.lit(id)


def at(df: DataFrame, side: str, ref: NodeRef) -> Column:
    return (F.col(f"{side}_type") == ref.type) & same(df, f"{side}_id", ref.id)
