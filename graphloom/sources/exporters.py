"""Other text forms of a graph: one row of text for each node and edge, made by column functions; frame() adds head and tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from ..model import HIDDEN, KEY, PropertyGraph
from ..operators.common import held_by_driver

FORMATS = ("json", "json_compact", "cypher", "turtle", "json_ld", "graphml", "gml", "toon")


def _own(df: DataFrame, fixed: tuple[str, ...]) -> list[str]:
    return sorted(c for c in df.columns if c not in fixed and c not in HIDDEN)


def _json(column: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(column.cast("string").alias("x"))), r"^\{\"x\":(.*)\}$", 1)


def _xml(column: Column) -> Column:
    out = F.replace(column.cast("string"), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _value(column: Column, kind: st.DataType) -> Column:
    return column.cast("string") if isinstance(kind, (st.NumericType, st.BooleanType)) else _json(column)


def _pairs(df: DataFrame, names: list[str], one, by: str) -> Column:
    """Present properties rendered by one(name, column, type), joined."""
    parts = [F.when(F.col(f"`{c}`").isNotNull(), one(c, F.col(f"`{c}`"), df.schema[c].dataType)) for c in names]
    return F.array_join(F.array(*parts), by) if parts else F.lit("")


def _key(t: str | Column, i: str | Column) -> Column:
    return F.concat_ws("_", t, i)


def export(graph: PropertyGraph, form: str) -> DataFrame:
    """(part, value): part 0 nodes, part 1 edges; rows of one part may come in any order."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; there are {', '.join(FORMATS)}")
    parts = [df.select(F.lit(0).alias("part"), _node(form, t, df).alias("value")) for t, df in graph.node_tables.items()]
    parts += [df.select(F.lit(1).alias("part"), _edge(form, r, df).alias("value")) for r, df in graph.edge_tables.items()]
    out = parts[0] if parts else graph.spark.createDataFrame([], "part int, value string")
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _node(form: str, kind: str, df: DataFrame) -> Column:
    names, i = _own(df, ("id",)), F.col("id").cast("string")
    key = _key(F.lit(kind), i)
    if form in ("json", "json_compact"):
        return F.to_json(F.struct(F.lit(kind).alias("type"), i.alias("id"), *(F.col(f"`{c}`") for c in names)))
    if form == "json_ld":
        return F.to_json(F.struct(F.concat(F.lit("urn:"), key).alias("@id"), F.lit(kind).alias("@type"), *(F.col(f"`{c}`") for c in names)))
    if form == "cypher":
        return F.concat(F.lit("CREATE (n_"), key, F.lit(f":{kind} {{id: "), _json(i), F.lit("" if not names else ", "), _pairs(df, names, lambda c, v, k: F.concat(F.lit(f"{c}: "), _value(v, k)), ", "), F.lit("})"))
    if form == "turtle":
        return F.concat(F.lit(":"), key, F.lit(f" a :{kind}"), _pairs(df, names, lambda c, v, k: F.concat(F.lit(f" ;\n  :{c} "), _value(v, k)), ""), F.lit(" ."))
    if form == "graphml":
        return F.concat(F.lit('<node id="'), _xml(key), F.lit(f'"><data key="type">{kind}</data>'), _pairs(df, names, lambda c, v, k: F.concat(F.lit(f'<data key="{c}">'), _xml(v), F.lit("</data>")), ""), F.lit("</node>"))
    if form == "gml":
        return F.concat(F.lit("node [ id "), _json(key), F.lit(f' type "{kind}" '), _pairs(df, names, lambda c, v, k: F.concat(F.lit(f"{c} "), _value(v, k)), " "), F.lit(" ]"))
    return F.concat(F.lit(f"{kind}: "), F.array_join(F.array(_json(i), *(F.coalesce(_value(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("null")) for c in names)), ","))


def _edge(form: str, rel: str, df: DataFrame) -> Column:
    names = _own(df, KEY)
    a, b = _key("src_type", F.col("src_id").cast("string")), _key("dst_type", F.col("dst_id").cast("string"))
    if form in ("json", "json_compact"):
        end = lambda s: F.struct(F.col(f"{s}_type").alias("type"), F.col(f"{s}_id").cast("string").alias("id"))
        return F.to_json(F.struct(F.lit(rel).alias("type"), end("src").alias("source"), end("dst").alias("target"), *(F.col(f"`{c}`") for c in names)))
    if form == "json_ld":
        return F.to_json(F.struct(F.concat(F.lit("urn:"), a).alias("@id"), F.struct(F.concat(F.lit("urn:"), b).alias("@id"), *(F.col(f"`{c}`") for c in names)).alias(rel)))
    if form == "cypher":
        return F.concat(F.lit("CREATE (n_"), a, F.lit(f")-[:{rel} {{"), _pairs(df, names, lambda c, v, k: F.concat(F.lit(f"{c}: "), _value(v, k)), ", "), F.lit("}]->(n_"), b, F.lit(")"))
    if form == "turtle":
        return F.concat(F.lit(":"), a, F.lit(f" :{rel} :"), b, F.lit(" ."))
    if form == "graphml":
        return F.concat(F.lit('<edge source="'), _xml(a), F.lit('" target="'), _xml(b), F.lit(f'"><data key="type">{rel}</data>'), _pairs(df, names, lambda c, v, k: F.concat(F.lit(f'<data key="{c}">'), _xml(v), F.lit("</data>")), ""), F.lit("</edge>"))
    if form == "gml":
        return F.concat(F.lit("edge [ source "), _json(a), F.lit(" target "), _json(b), F.lit(f' label "{rel}" '), _pairs(df, names, lambda c, v, k: F.concat(F.lit(f"{c} "), _value(v, k)), " "), F.lit(" ]"))
    return F.concat(F.lit(f"{rel}: "), a, F.lit(","), b, F.lit("," if names else ""), F.array_join(F.array(*(F.coalesce(_value(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("null")) for c in names)), ",") if names else F.lit(""))


# What stands before, between and after the rows of a whole document.
FRAMES = {
    "json": ('{"nodes": [\n', '\n], "edges": [\n', "\n]}", ",\n"),
    "json_compact": ('{"nodes":[', '],"edges":[', "]}", ","),
    "json_ld": ('{"@graph": [\n', ",\n", "\n]}", ",\n"),
    "cypher": ("", ";\n", ";\n", ";\n"),
    "turtle": ("@prefix : <urn:graph:> .\n", "\n", "\n", "\n"),
    "graphml": ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">\n', "\n", "\n</graph></graphml>", "\n"),
    "gml": ("graph [ directed 1\n", "\n", "\n]", "\n"),
    "toon": ("", "\n", "\n", "\n"),
}


def document(graph: PropertyGraph, form: str) -> str:
    """The whole document, for graphs that the driver can hold (MOST_ROWS, else an error)."""
    held_by_driver(graph)
    head, middle, tail, between = FRAMES[form]
    rows = export(graph, form).orderBy("part", "value").collect()
    nodes, edges = ([r["value"] for r in rows if r["part"] == p] for p in (0, 1))
    return head + between.join(nodes) + middle + between.join(edges) + tail


def token_counts(df: DataFrame, column: str = "value", encoding: str = "o200k_base") -> DataFrame:
    """Adds n_tokens by a public tokenizer, in Arrow batches; the encoding's file must be there."""

    def run(batches):
        import pyarrow as pa
        import tiktoken

        code = tiktoken.get_encoding(encoding)
        for batch in batches:
            counts = [len(x) for x in code.encode_ordinary_batch([t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_tokens"])

    return df.mapInArrow(run, st.StructType([*df.schema.fields, st.StructField("n_tokens", st.LongType())]))
