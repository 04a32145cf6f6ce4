"""Conditions on properties as Column expressions; all are false where the property is absent, but NOT_EXISTS."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from ..model import HIDDEN, NULLS

#: Spellings of the operators in query text and builders.
OPERATORS = {
    "=": "EQ", "==": "EQ", "!=": "NE", "<>": "NE", ">": "GT", ">=": "GE", "<": "LT", "<=": "LE",
    "IN": "IN", "NOT IN": "NOT_IN", "CONTAINS": "CONTAINS", "STARTS_WITH": "STARTS_WITH", "ENDS_WITH": "ENDS_WITH", "MATCHES": "MATCHES",
}
COMPARISONS = {"GT", "GE", "LT", "LE"}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None

    @staticmethod
    def of(field: str, op: str, value: Any) -> Condition:
        known = OPERATORS.get(op.upper().replace("STARTSWITH", "STARTS_WITH").replace("ENDSWITH", "ENDS_WITH").replace("NOT_IN", "NOT IN"))
        if known is None:
            raise ValueError(f"unknown operator {op!r}; there are {', '.join(OPERATORS)}")
        return Condition(field, known, value)


def _is_null(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.array_contains(NULLS, name), F.lit(False)) if NULLS in df.columns else F.lit(False)


def present(df: DataFrame, name: str, fixed: tuple[str, ...]) -> Column:
    if name not in df.columns or name in fixed or name in HIDDEN:
        return F.lit(False)
    return F.col(f"`{name}`").isNotNull() | _is_null(df, name) if NULLS in df.columns else F.col(f"`{name}`").isNotNull()


def _equal(column: Column, kind: st.DataType, value: Any) -> Column:
    """column = value where the types can be equal at all; numbers, and booleans as 0 and 1, compare as numbers."""
    if isinstance(kind, st.BooleanType) and isinstance(value, (bool, int, float)):
        return column == F.lit(bool(value)) if value in (0, 1) else F.lit(False)
    if isinstance(kind, st.NumericType) and isinstance(value, (bool, int, float)):
        return column == F.lit(int(value) if isinstance(value, bool) else value)
    if isinstance(kind, st.StringType) and isinstance(value, str):
        return column == F.lit(value)
    if isinstance(kind, (st.TimestampType, st.DateType)) and isinstance(value, str):
        return column.cast("string") == F.lit(value)
    return F.lit(False)


def as_text(column: Column, kind: st.DataType) -> Column:
    return F.when(column, F.lit("True")).otherwise(F.lit("False")) if isinstance(kind, st.BooleanType) else column.cast("string")


def to_column(condition: Condition, df: DataFrame, fixed: tuple[str, ...]) -> Column:
    """The condition over a node or edge table; `fixed` names its key columns, which aren't properties."""
    name, op, value = condition.field, condition.op, condition.value
    there = present(df, name, fixed)
    if op == "EXISTS":
        return there
    if op == "NOT_EXISTS":
        return ~there
    if name not in df.columns or name in fixed or name in HIDDEN:
        return F.lit(False)
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    null = _is_null(df, name)
    if op in ("EQ", "NE"):
        hit = null if value is None else F.coalesce(_equal(column, kind, value), F.lit(False))
        return hit if op == "EQ" else there & ~hit
    if op in ("IN", "NOT_IN"):
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{op} needs a list")
        fit = [v for v in value if v is not None]
        if isinstance(kind, st.StringType):
            own = [v for v in fit if isinstance(v, str)]
        elif isinstance(kind, st.NumericType):
            own = [v for v in fit if isinstance(v, (int, float))]
        else:
            own = None
        hit = column.isin(own) if own else F.lit(False)
        if own is None:
            hit = reduce(lambda a, b: a | b, [_equal(column, kind, v) for v in fit], F.lit(False))
        hit = F.coalesce(hit, F.lit(False))
        return hit if op == "IN" else there & ~hit
    if op in COMPARISONS:
        compare = {"GT": lambda a, b: a > b, "GE": lambda a, b: a >= b, "LT": lambda a, b: a < b, "LE": lambda a, b: a <= b}[op]
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            if isinstance(kind, st.StringType):
                column = column.try_cast("double")
            elif not isinstance(kind, (st.NumericType, st.BooleanType)):
                return F.lit(False)
            elif isinstance(kind, st.BooleanType):
                column = column.cast("int")
            return F.coalesce(compare(column, F.lit(value)), F.lit(False))
        if isinstance(value, str) and isinstance(kind, (st.StringType, st.TimestampType, st.DateType)):
            return F.coalesce(compare(column if isinstance(kind, st.StringType) else column.cast("string"), F.lit(value)), F.lit(False))
        return F.lit(False)
    text = as_text(column, kind)
    if op == "MATCHES":
        re.compile(str(value))  # a bad pattern is an error of the query, not of its run
        hit = text.rlike(f"^(?:{value})")
    else:
        hit = {"CONTAINS": text.contains, "STARTS_WITH": text.startswith, "ENDS_WITH": text.endswith}[op](str(value))
    return F.coalesce(hit, F.lit(False))


def any_group(groups: list[list[Condition]], df: DataFrame, fixed: tuple[str, ...]) -> Column | None:
    """OR of AND groups; None without conditions."""
    groups = [g for g in groups if g]
    if not groups:
        return None
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [to_column(c, df, fixed) for c in g]) for g in groups])
