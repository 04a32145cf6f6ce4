"""Query engine: statements and builders to lazy DataFrames."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from .functions.conditions import Condition, any_group
from .model import HIDDEN, KEY, SEQ, NodeRef, PropertyGraph, both_ways, properties
from .operators import paths, traversal
from .plans.parser import Statement, parse


class QueryResult:
    """A lazy result: `df` is the plan, `data`, `count` and `total_count` (rows before paging) run it when asked."""

    def __init__(self, df: DataFrame, query: str, kind: str, before: DataFrame | None = None, rows=None, total=None):
        self.df, self.query, self.query_type, self._before, self._rows, self._total = df, query, kind, before, rows, total
        self.execution_time_ms = 0.0

    @cached_property
    def data(self) -> list[Any]:
        began = time.perf_counter()
        out = [self._rows(r) if self._rows else r.asDict(recursive=True) for r in self.df.collect()]
        self.execution_time_ms = (time.perf_counter() - began) * 1000
        return out

    @property
    def count(self) -> int:
        return len(self.data)

    @cached_property
    def total_count(self) -> int:
        if self._total:
            return self._total(self.df)
        return self.count if self._before is None else self._before.count()

    def first(self) -> Any:
        return self.data[0] if self.data else None

    def to_list(self) -> list[Any]:
        return list(self.data)

    def __iter__(self) -> Iterator[Any]:
        return iter(self.data)

    def __len__(self) -> int:
        return len(self.data)


class QueryEngine:
    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    def execute(self, text: str) -> QueryResult:
        return self.run(parse(text), text)

    def match(self, type: str | None = None) -> QueryBuilder:
        return QueryBuilder(self, Statement("NODES", type))

    def match_edges(self, rel: str | None = None) -> EdgeQueryBuilder:
        return EdgeQueryBuilder(self, Statement("EDGES", rel))

    def run(self, s: Statement, text: str = "") -> QueryResult:
        return {"NODES": self._nodes, "EDGES": self._edges, "TRAVERSE": self._traverse, "PATH": self._path, "COUNT": self._count}.get(s.kind, self._aggregate)(s, text)

    def _tables(self, s: Statement) -> list[tuple[str, DataFrame]]:
        """The node tables a statement reads, filtered: only those of its type are touched."""
        out = []
        for kind, df in self.graph.node_tables.items():
            if s.type in (None, kind):
                keep = any_group(s.groups, df, ("id",))
                out.append((kind, df if keep is None else df.where(keep)))
        return out

    def _nodes(self, s: Statement, text: str) -> QueryResult:
        parts = self._tables(s)
        if not parts:
            return QueryResult(self.graph.spark.createDataFrame([], "type string, id string, properties string"), text, "NODES")
        keys = _order_keys([df.schema[s.order].dataType if s.order in df.columns and s.order not in ("id", *HIDDEN) else None for _, df in parts]) if s.order else None
        made = []
        for kind, df in parts:
            columns = [df[f"`{f}`"].alias(f) if f in df.columns and f not in ("id", *HIDDEN) else F.lit(None).cast("string").alias(f) for f in s.fields]
            if not s.fields:
                columns = [F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"), properties(df, ("id",)).alias("properties")]
            rank = [F.col(SEQ).alias("_s") if SEQ in df.columns else F.lit(0).cast("long").alias("_s"), F.lit(kind).alias("_t"), F.col("id").alias("_i") if len(parts) == 1 else F.col("id").cast("string").alias("_i")]
            if keys:
                own = F.col(f"`{s.order}`") if s.order in df.columns and s.order not in ("id", *HIDDEN) else F.lit(None)
                rank += [own.isNull().alias("_absent"), *(k(own, df.schema[s.order].dataType if s.order in df.columns else None).alias(f"_k{i}") for i, k in enumerate(keys))]
            made.append(df.select(*columns, *rank))
        whole = made[0]
        for x in made[1:]:
            whole = whole.unionByName(x)
        out = whole
        if keys:
            way = (lambda c: F.col(c).desc()) if s.descending else (lambda c: F.col(c).asc())
            out = out.orderBy(F.col("_absent").asc(), *(way(f"_k{i}") for i in range(len(keys))), "_s", "_t", "_i")
        elif s.limit is not None or s.offset:
            out = out.orderBy("_s", "_t", "_i")
        if s.offset:
            out = out.offset(s.offset)
        if s.limit is not None:
            out = out.limit(s.limit)
        return QueryResult(out.select(*(s.fields or ["type", "id", "properties"])), text, "NODES", whole)

    def _edges(self, s: Statement, text: str) -> QueryResult:
        out = None
        for rel, df in self.graph.edge_tables.items():
            if s.type not in (None, rel):
                continue
            df = df if self.graph.directed else both_ways(df)
            keep = any_group(s.groups, df, KEY)
            df = df if keep is None else df.where(keep)
            own = df.select(F.lit(rel).alias("rel_type"), *(F.col(c).cast("string").alias(c) for c in KEY), properties(df, KEY).alias("properties"))
            out = own if out is None else out.unionByName(own)
        if out is None:
            out = self.graph.edges("\0none")
        page = out if s.limit is None else out.orderBy("rel_type", *KEY).limit(s.limit)
        return QueryResult(page, text, "EDGES", out)

    def _count(self, s: Statement, text: str) -> QueryResult:
        parts = [df.agg(F.count("*").alias("n")) for _, df in self._tables(s)]
        df = _stack(parts, self.graph, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
        return QueryResult(df, text, "COUNT", rows=lambda r: r["count"])

    def _aggregate(self, s: Statement, text: str) -> QueryResult:
        """Of the numeric values of one property; booleans and texts don't count. value and how many values there were."""
        parts, integral = [], True
        for _, df in self._tables(s):
            if s.property in df.columns and s.property != "id" and isinstance(df.schema[s.property].dataType, st.NumericType):
                own = F.col(f"`{s.property}`")
                integral &= isinstance(df.schema[s.property].dataType, st.IntegralType)
                parts.append(df.agg(F.sum(own).cast("double").alias("s"), F.min(own).cast("double").alias("lo"), F.max(own).cast("double").alias("hi"), F.count(own).alias("n")))
        n = F.sum("n")
        value = {"SUM": F.sum("s"), "AVG": F.sum("s") / F.nullif(n, F.lit(0)), "MIN": F.min("lo"), "MAX": F.max("hi")}[s.kind]
        if integral and s.kind != "AVG":
            value = value.cast("long")
        df = _stack(parts, self.graph, "s double, lo double, hi double, n long").agg(value.alias("value"), F.coalesce(n, F.lit(0)).alias("n_values"))
        return QueryResult(df, text, s.kind, rows=lambda r: r["value"], total=lambda d: d.first()["n_values"])

    def _traverse(self, s: Statement, text: str) -> QueryResult:
        whole = traversal.traverse_statement(self.graph, s.start, s.steps, s.most)
        page = whole.orderBy("type", "id")
        return QueryResult(page if s.limit is None else page.limit(s.limit), text, "TRAVERSE", whole, rows=lambda r: NodeRef(r["type"], r["id"]))

    def _path(self, s: Statement, text: str) -> QueryResult:
        found = paths.shortest_path(self.graph, s.start, s.end, s.property, s.most)
        return QueryResult(paths.path_frame(self.graph.spark, [found] if found else []), text, "PATH")


def _stack(parts: list[DataFrame], graph: PropertyGraph, schema: str) -> DataFrame:
    if not parts:
        return graph.spark.createDataFrame([], schema)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _order_keys(kinds: list[st.DataType | None]):
    """Sort keys over columns of any types: booleans before numbers before texts."""
    held = {k for k in kinds if k is not None}
    if len(held) <= 1:
        kind = next(iter(held), st.StringType())
        return [lambda c, k: c.cast(kind)]
    level = lambda c, k: F.lit(0 if isinstance(k, st.BooleanType) else 1 if isinstance(k, st.NumericType) else 2)
    number = lambda c, k: c.cast("double") if isinstance(k, (st.NumericType, st.BooleanType)) else F.lit(None).cast("double")
    return [level, number, lambda c, k: F.lit(None).cast("string") if k is None or isinstance(k, (st.NumericType, st.BooleanType)) else c.cast("string")]


class _Builder:
    def __init__(self, engine: QueryEngine, statement: Statement):
        self._engine, self._s = engine, statement

    def where(self, field: str, op: str, value: Any = None):
        """Conditions of one builder are joined by AND."""
        return self._and(Condition.of(field, op, value))

    def _and(self, condition: Condition):
        self._s.groups = [[*(self._s.groups[0] if self._s.groups else []), condition]]
        return self

    def limit(self, n: int):
        self._s.limit = n
        return self

    def _text(self) -> str:
        s = self._s
        where = " AND ".join(f"{c.field} {c.op} {c.value!r}" for g in s.groups for c in g)
        order = f" ORDER BY {s.order} {'DESC' if s.descending else 'ASC'}" if s.order else ""
        return f"{s.kind} {s.type or ''}{' WHERE ' + where if where else ''}{order}{'' if s.limit is None else f' LIMIT {s.limit}'}{f' OFFSET {s.offset}' if s.offset else ''}{' RETURN ' + ', '.join(s.fields) if s.fields else ''}"

    def execute(self) -> QueryResult:
        return self._engine.run(self._s, self._text())


class QueryBuilder(_Builder):
    def where_exists(self, field: str) -> QueryBuilder:
        return self._and(Condition(field, "EXISTS"))

    def where_not_exists(self, field: str) -> QueryBuilder:
        return self._and(Condition(field, "NOT_EXISTS"))

    def order_by(self, field: str, direction: str = "ASC") -> QueryBuilder:
        self._s.order, self._s.descending = field, direction.upper() == "DESC"
        return self

    def offset(self, n: int) -> QueryBuilder:
        self._s.offset = n
        return self

    def return_fields(self, *fields: str) -> QueryBuilder:
        self._s.fields = list(fields)
        return self

    def count(self) -> int:
        return self.execute().total_count


class EdgeQueryBuilder(_Builder):
    pass
