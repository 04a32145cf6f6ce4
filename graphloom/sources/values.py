"""Values of the text formats: how they are quoted, split and typed."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as st

#: A text is quoted where it is empty, holds one of these, or would be read as something else.
SPECIAL = r"[ |\"\n\t\\]"
TYPED = r"(?:-?[0-9]+(?:\.[0-9]+)?|true|false|null|~|#.*|:.*)"


class FormatError(ValueError):
    """The text isn't of the format."""


def split_fields(line: str, by: str = " \t") -> list[tuple[str, bool]]:
    """(text, quoted) of each field; quotes hold separators together and a backslash escapes."""
    out, at = [], 0
    while at < len(line):
        if line[at] in by and by != "|":
            at += 1
            continue
        if line[at] == '"':
            m = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S).match(line, at)
            if not m:
                raise FormatError(f"a quote isn't closed in {line!r}")
            out.append((re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1]), True))
            at = m.end()
        else:
            m = re.compile(f"[^{re.escape(by)}]*").match(line, at)
            out.append((m[0], False))
            at = m.end()
        if by == "|" and at < len(line):
            if line[at] != "|":
                raise FormatError(f"text after a quote in {line!r}")
            at += 1
            if at == len(line):
                out.append(("", False))
    return out


def typed(text: str, quoted: bool) -> Any:
    if quoted:
        return text
    if text in ("null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+(?:[eE][+-]?\d+)?", text):
        return float(text)
    if text[:1] in "[{":
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


def quoted(column: Column, kind: st.DataType) -> Column:
    """A column as it stands in the text: null, true, false, numbers plain, texts quoted where they must be."""
    if isinstance(kind, (st.StructType, st.ArrayType, st.MapType)):
        column, kind = F.to_json(column), st.StringType()
    if not isinstance(kind, st.StringType):
        return F.coalesce(column.cast("string"), F.lit("null"))
    escaped = F.replace(F.replace(F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    need = (column == "") | column.rlike(SPECIAL) | column.rlike(f"^{TYPED}$")
    return F.when(column.isNull(), F.lit("null")).when(need, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(column)
