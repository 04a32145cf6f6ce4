"""Schema validation: field, edge and graph rules compiled to expressions; the result is a table of errors.

Each table is scanned once for all of its row rules; uniqueness, cardinality and references are aggregations and anti
joins. validate() changes nothing; apply_defaults() returns a graph with defaults filled in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from dataclasses import fields as fields_of
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

from ..model import KEY, PropertyGraph
from . import analysis

# The error codes.
CODES = (
    "REQUIRED_FIELD", "INVALID_TYPE", "MIN_LENGTH", "MAX_LENGTH", "PATTERN_MISMATCH", "INVALID_EMAIL", "INVALID_ENUM",
    "MIN_VALUE", "MAX_VALUE", "REF_NOT_FOUND", "REF_WRONG_TYPE", "INVALID_SOURCE_TYPE", "INVALID_TARGET_TYPE", "SELF_LOOP",
    "DUPLICATE_EDGE", "CARDINALITY_VIOLATION", "CYCLE_DETECTED", "NOT_CONNECTED", "ORPHAN_NODE", "CUSTOM",
)
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ERROR = "code string, message string, location string, context map<string,string>"
#: How often a node may be a source and a target.
CARDINALITIES = {"1:1": (True, True), "1:N": (False, True), "N:1": (True, False), "N:N": (False, False)}


@dataclass(frozen=True)
class Rule:
    code: str
    message: str
    broken: Column


@dataclass
class Field:
    """Base of the field types. Rules see the column of one property, and aren't asked where it is null."""

    required: bool = False
    default: Any = None

    def valid_type(self, column: Column, kind: st.DataType) -> Column:
        raise NotImplementedError

    def rules(self, column: Column, kind: st.DataType) -> list[Rule]:
        return []

    def value(self, column: Column, kind: st.DataType) -> Column:
        return column

    def compile(self, name: str, df: DataFrame) -> list[Rule]:
        missing = Rule("REQUIRED_FIELD", f"{name} is required", F.lit(True))
        need = self.required and self.default is None
        if name not in df.columns:
            return [missing] if need else []
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        valid = F.coalesce(self.valid_type(column, kind), F.lit(False))
        out = [Rule("INVALID_TYPE", f"{name} is no {type(self).__name__}", column.isNotNull() & ~valid)]
        if need:
            out.append(Rule(missing.code, missing.message, column.isNull()))
        return out + [Rule(r.code, r.message, column.isNotNull() & valid & F.coalesce(r.broken, F.lit(False))) for r in self.rules(self.value(column, kind), kind)]


@dataclass
class String(Field):
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    email: bool = False
    enum: list[str] | None = None

    def valid_type(self, column, kind):
        return F.lit(isinstance(kind, st.StringType))

    def rules(self, column, kind):
        out = []
        if self.min_length is not None:
            out.append(Rule("MIN_LENGTH", f"shorter than {self.min_length}", F.length(column) < self.min_length))
        if self.max_length is not None:
            out.append(Rule("MAX_LENGTH", f"longer than {self.max_length}", F.length(column) > self.max_length))
        if self.pattern is not None:
            out.append(Rule("PATTERN_MISMATCH", f"doesn't match {self.pattern}", ~column.rlike(f"^(?:{self.pattern})")))
        if self.email:
            out.append(Rule("INVALID_EMAIL", "no email address", ~column.rlike(EMAIL)))
        if self.enum is not None:
            out.append(Rule("INVALID_ENUM", f"none of {self.enum}", ~column.isin(self.enum)))
        return out


@dataclass
class _Number(Field):
    min: float | None = None
    max: float | None = None

    def range(self, low, high):
        self.min, self.max = low, high
        return self

    def rules(self, column, kind):
        out = []
        if self.min is not None:
            out.append(Rule("MIN_VALUE", f"less than {self.min}", column < self.min))
        if self.max is not None:
            out.append(Rule("MAX_VALUE", f"more than {self.max}", column > self.max))
        return out


@dataclass
class Int(_Number):
    def valid_type(self, column, kind):
        return column.try_cast("bigint").isNotNull() if isinstance(kind, st.StringType) else F.lit(isinstance(kind, st.IntegralType))

    def value(self, column, kind):
        return column.try_cast("bigint") if isinstance(kind, st.StringType) else column


@dataclass
class Float(_Number):
    def valid_type(self, column, kind):
        return column.try_cast("double").isNotNull() if isinstance(kind, st.StringType) else F.lit(isinstance(kind, st.NumericType))

    def value(self, column, kind):
        return column.try_cast("double") if isinstance(kind, st.StringType) else column


@dataclass
class Bool(Field):
    def valid_type(self, column, kind):
        return F.lower(column).isin("true", "false") if isinstance(kind, st.StringType) else F.lit(isinstance(kind, st.BooleanType))


@dataclass
class Ref(Field):
    """A reference: struct(type, id), or text `:type:id`; whether the node exists isn't asked."""

    type: str | None = None

    def valid_type(self, column, kind):
        if isinstance(kind, st.StructType):
            return F.lit({"type", "id"} <= set(kind.names))
        return column.rlike("^:[^:]+:.+$") if isinstance(kind, st.StringType) else F.lit(False)

    def rules(self, column, kind):
        own = column["type"] if isinstance(kind, st.StructType) else F.split_part(column, F.lit(":"), F.lit(2))
        return [Rule("REF_WRONG_TYPE", f"no {self.type}", own != self.type)] if self.type else []


@dataclass
class NodeType:
    name: str
    id: Field | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    constraints: list[tuple[str, Column | Callable]] = field(default_factory=list)

    def field(self, name: str, kind: Field) -> NodeType:
        self.fields[name] = kind
        return self

    def constraint(self, message: str, holds: Column | Callable[[DataFrame], DataFrame]) -> NodeType:
        """A Column that must be true, or a function from the table to its broken rows."""
        self.constraints.append((message, holds))
        return self


@dataclass
class EdgeType:
    name: str
    source: str | None = None
    target: str | None = None
    no_self_loop: bool = False
    unique: bool = False
    cardinality: str = "N:N"
    acyclic: bool = False
    bidirectional: bool = False
    fields: dict[str, Field] = field(default_factory=dict)
    constraints: list[tuple[str, Column | Callable]] = field(default_factory=list)

    def __post_init__(self):
        if self.cardinality not in CARDINALITIES:
            raise ValueError(f"cardinality is one of {', '.join(CARDINALITIES)}")

    field = NodeType.field
    constraint = NodeType.constraint


def _rows(df: DataFrame, rules: list[tuple[Rule, Column]]) -> DataFrame | None:
    """Errors of all row rules by one scan; each rule has its location."""
    if not rules:
        return None
    errors = F.array(*(F.when(r.broken, F.struct(F.lit(r.code).alias("code"), F.lit(r.message).alias("message"), where.alias("location"))) for r, where in rules))
    return df.select(F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("e")).select("e.code", "e.message", "e.location", F.create_map().cast("map<string,string>").alias("context"))


def _error(df: DataFrame, code: str, message: Column, location: Column, context: Column | None = None) -> DataFrame:
    return df.select(F.lit(code).alias("code"), message.alias("message"), location.alias("location"), (context if context is not None else F.create_map()).cast("map<string,string>").alias("context"))


def _custom(df: DataFrame, constraints, where: Column) -> list[DataFrame]:
    out = []
    for message, holds in constraints:
        broken = df.where(~F.coalesce(holds, F.lit(False))) if isinstance(holds, Column) else holds(df)
        out.append(_error(broken, "CUSTOM", F.lit(message), where))
    return out


@dataclass
class ValidationResult:
    errors: DataFrame

    @property
    def is_valid(self) -> bool:
        return self.errors.isEmpty()

    def codes(self) -> list[str]:
        return sorted(r["code"] for r in self.errors.select("code").collect())


class GraphSchema:
    """Declared node and edge types with graph rules; what isn't declared isn't looked at. max_depth is only kept."""

    def __init__(self, connected: bool = False, no_orphans: bool = False, max_depth: int | None = None):
        self.nodes: dict[str, NodeType] = {}
        self.edges: dict[str, EdgeType] = {}
        self.connected, self.no_orphans, self.max_depth = connected, no_orphans, max_depth
        self.constraints: list[Callable[[PropertyGraph], DataFrame | list[str]]] = []

    def node(self, kind: NodeType) -> GraphSchema:
        self.nodes[kind.name] = kind
        return self

    def edge(self, kind: EdgeType) -> GraphSchema:
        self.edges[kind.name] = kind
        return self

    def constraint(self, check: Callable[[PropertyGraph], DataFrame | list[str]]) -> GraphSchema:
        """check(graph) gives a table of errors, or messages."""
        self.constraints.append(check)
        return self

    def validate(self, graph: PropertyGraph) -> ValidationResult:
        parts: list[DataFrame] = []
        for kind in self.nodes.values():
            if kind.name in graph.node_tables:
                parts += self._node_errors(kind, graph.node_tables[kind.name])
        for kind in self.edges.values():
            if kind.name in graph.edge_tables:
                parts += self._edge_errors(kind, graph)
        one = graph.spark.range(1)
        if self.connected and not analysis.is_connected(graph):
            parts.append(_error(one, "NOT_CONNECTED", F.lit("the graph isn't connected"), F.lit("graph")))
        if self.no_orphans:
            e = graph.links()
            ends = e.select(F.col("src_type").alias("type"), F.col("src_id").alias("id")).unionByName(e.select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id")))
            parts.append(_error(graph.refs().join(ends, ["type", "id"], "left_anti"), "ORPHAN_NODE", F.lit("the node has no edges"), F.concat(F.lit("nodes."), "type", F.lit("["), "id", F.lit("]"))))
        for check in self.constraints:
            found = check(graph)
            parts.append(found if isinstance(found, DataFrame) else graph.spark.createDataFrame([("CUSTOM", m, "graph", {}) for m in found], ERROR))
        empty = graph.spark.createDataFrame([], ERROR)
        return ValidationResult(reduce(lambda a, b: a.unionByName(b), parts, empty))

    def _node_errors(self, kind: NodeType, df: DataFrame) -> list[DataFrame]:
        base = F.concat(F.lit(f"nodes.{kind.name}["), F.col("id").cast("string"), F.lit("]"))
        rules = [(r, base) for r in kind.id.compile("id", df)] if kind.id else []
        rules += [(r, F.concat(base, F.lit(f".{name}"))) for name, f in kind.fields.items() for r in f.compile(name, df)]
        found = _rows(df, rules)
        return [*([found] if found is not None else []), *_custom(df, kind.constraints, base)]

    def _edge_errors(self, kind: EdgeType, graph: PropertyGraph) -> list[DataFrame]:
        df = graph.edge_tables[kind.name]
        text = lambda c: F.col(c).cast("string")
        base = F.concat(F.lit(f"edges.{kind.name}["), F.concat_ws(":", "src_type", text("src_id")), F.lit("->"), F.concat_ws(":", "dst_type", text("dst_id")), F.lit("]"))
        out: list[DataFrame] = []
        if kind.unique:
            again = df.groupBy(*KEY).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("_n"))))
            out.append(_error(again, "DUPLICATE_EDGE", F.lit("the edge is given more than once"), base))
        for once, side, word in zip(CARDINALITIES[kind.cardinality], ("src", "dst"), ("outgoing", "incoming"), strict=True):
            if once:
                many = df.groupBy(f"{side}_type", f"{side}_id").agg(F.count("*").alias("n")).where("n > 1")
                out.append(_error(many, "CARDINALITY_VIOLATION", F.concat(F.lit(f"{kind.cardinality} allows one {word} edge, there are "), F.col("n").cast("string")), F.concat(F.lit(f"edges.{kind.name}["), F.concat_ws(":", f"{side}_type", text(f"{side}_id")), F.lit("]")), F.create_map(F.lit("count"), F.col("n").cast("string"))))
        if kind.acyclic and analysis.has_cycle(graph, kind.name):
            out.append(_error(graph.spark.range(1), "CYCLE_DETECTED", F.lit(f"{kind.name} has a cycle"), F.lit(f"edges.{kind.name}")))
        if kind.bidirectional:
            back = df.select(F.col("dst_type").alias("src_type"), F.col("dst_id").alias("src_id"), F.col("src_type").alias("dst_type"), F.col("src_id").alias("dst_id"))
            out.append(_error(df.select(*KEY).join(back, list(KEY), "left_anti"), "DUPLICATE_EDGE", F.lit("the reverse edge is missing"), base))
        rules: list[tuple[Rule, Column]] = []
        for want, side, code in ((kind.source, "src", "INVALID_SOURCE_TYPE"), (kind.target, "dst", "INVALID_TARGET_TYPE")):
            if want:
                rules.append((Rule(code, f"must be {want}", F.col(f"{side}_type") != want), base))
        if kind.no_self_loop:
            rules.append((Rule("SELF_LOOP", "the edge leads to its own start", (F.col("src_type") == F.col("dst_type")) & (F.col("src_id") == F.col("dst_id"))), base))
        rules += [(r, F.concat(base, F.lit(f".{name}"))) for name, f in kind.fields.items() for r in f.compile(name, df)]
        found = _rows(df, rules)
        out += [found] if found is not None else []
        for side in ("src", "dst"):
            refs = graph.refs().select(F.col("type").alias("_t"), F.col("id").alias("_i"))
            lost = df.join(refs, (F.col(f"{side}_type") == F.col("_t")) & (text(f"{side}_id") == F.col("_i")), "left_anti")
            out.append(_error(lost, "REF_NOT_FOUND", F.concat(F.lit("no node "), F.concat_ws(":", f"{side}_type", text(f"{side}_id"))), base))
        return out + _custom(df, kind.constraints, base)

    def apply_defaults(self, graph: PropertyGraph) -> PropertyGraph:
        """A graph whose absent properties have their declared defaults; the given one stays as it is."""

        def filled(df: DataFrame, kinds: dict[str, Field]) -> DataFrame:
            new = {n: F.coalesce(F.col(f"`{n}`"), F.lit(f.default)) if n in df.columns else F.lit(f.default) for n, f in kinds.items() if f.default is not None}
            return df.withColumns(new) if new else df

        nodes = {t: filled(df, self.nodes[t].fields) if t in self.nodes else df for t, df in graph.node_tables.items()}
        edges = {r: filled(df, self.edges[r].fields) if r in self.edges else df for r, df in graph.edge_tables.items()}
        return PropertyGraph(graph.spark, nodes, edges, graph.directed, graph.name)


def unique_edge_constraint() -> None:
    """Nothing: EdgeType.unique says it."""


def describe(kind: Field) -> dict[str, Any]:
    """A field type's settings that are set."""
    return {f.name: getattr(kind, f.name) for f in fields_of(kind) if getattr(kind, f.name) not in (None, False)}
