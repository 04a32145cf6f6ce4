"""The block format and its one-row-per-line variant, read and written.

Blocks: `nodes.<type>` or `edges.<relation>`, a header of field names, rows, an empty line. Lines: `kind.name|fields|values`
with the fields by spaces: each line stands alone, so any number of tasks may read a file; prefer it for large graphs.
Read as well: blocks whose header has tabs (values by tabs alone, sections that follow without an empty line, the first
field as id where none has that name, references without the first colon), and lines `kind.name id key=value`, of edges
`kind.name :type:id :type:id key=value`.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HIDDEN, KEY, SEQ, NodeRef, PropertyGraph, both_ways
from ..operators.common import held_by_driver, stored
from .values import FormatError, quoted, split_fields, typed

# Fixed value: the extension of files in the line format.
LINE_SUFFIX = ".isonl"
LINE = r"^(nodes|edges)\.([^|]+)\|([^|]*)\|(.*)$"
KEYED = r"^(nodes|edges)\.(\w+)[ \t]+([^|].*)$"
ROW = "kind string, name string, fields array<string>, texts array<string>, plain array<boolean>, error string"


def _ordered(df: DataFrame, fixed: tuple[str, ...]) -> list[str]:
    return sorted(c for c in df.columns if c not in fixed and c not in HIDDEN)


def _node_texts(df: DataFrame) -> tuple[list[str], list]:
    own = _ordered(df, ("id",))
    return ["id", *own], [quoted(F.col("id").cast("string"), df.schema["id"].dataType), *(quoted(F.col(f"`{c}`"), df.schema[c].dataType) for c in own)]


def _edge_texts(df: DataFrame) -> tuple[list[str], list]:
    own = _ordered(df, KEY)
    ref = lambda s: F.concat(F.lit(":"), f"{s}_type", F.lit(":"), F.col(f"{s}_id").cast("string"))
    return ["source", "target", *own], [ref("src"), ref("dst"), *(quoted(F.col(f"`{c}`"), df.schema[c].dataType) for c in own)]


def _tables(graph: PropertyGraph) -> Iterator[tuple[str, str, DataFrame, list[str], list]]:
    for name in sorted(graph.node_tables):
        df = graph.node_tables[name]
        yield "nodes", name, df, *_node_texts(df)
    for name in sorted(graph.edge_tables):
        df = graph.edge_tables[name] if graph.directed else both_ways(graph.edge_tables[name])
        yield "edges", name, df, *_edge_texts(df)


def to_lines(graph: PropertyGraph) -> DataFrame:
    """(value): the line format, one row for each node and edge; absent properties are left out of a line."""
    out = None
    for kind, name, df, fields, texts in _tables(graph):
        keys = len(fields) - len(_ordered(df, ("id",) if kind == "nodes" else KEY))
        pairs = [F.struct(F.lit(f).alias("f"), t.alias("t"), (F.lit(True) if i < keys else F.col(f"`{f}`").isNotNull()).alias("p")) for i, (f, t) in enumerate(zip(fields, texts, strict=True))]
        held = F.filter(F.array(*pairs), lambda x: x["p"])
        own = df.select(F.concat(F.lit(f"{kind}.{name}|"), F.array_join(F.transform(held, lambda x: x["f"]), " "), F.lit("|"), F.array_join(F.transform(held, lambda x: x["t"]), " ")).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else graph.spark.createDataFrame([], "value string")


def to_blocks(graph: PropertyGraph) -> str:
    """The block format as one text, rows in order. It is one file by nature: for graphs that the driver can hold (MOST_ROWS, else an error)."""
    held_by_driver(graph)
    blocks = []
    for kind, name, df, fields, texts in _tables(graph):
        order = [SEQ] if SEQ in df.columns else []
        rows = df.select(F.array_join(F.array(*texts), " ").alias("line"), *order)
        rows = rows.orderBy(*order) if order else rows
        blocks.append("\n".join([f"{kind}.{name}", " ".join(fields), *(r["line"] for r in rows.toLocalIterator())]))
    return "\n\n".join(blocks) + "\n" if blocks else ""


def _rows_of(text: str) -> Iterator[tuple[str, str, list[str], list[tuple[str, bool]], bool]]:
    """(kind, name, fields, values, tabs) of the block format; comments and `graph.` lines are passed over."""
    kind = name = None
    fields: list[str] | None = None
    tabs = False
    for number, line in enumerate(text.splitlines(), 1):
        line = line.rstrip("\r")
        if not line.strip():
            if not tabs:
                kind, fields = None, None
            continue
        if line.lstrip().startswith("#") or (kind is None or tabs) and line.startswith("graph."):
            continue
        if kind is None or tabs and "\t" not in line.strip() and line.startswith(("nodes.", "edges.")):
            kind, dot, name = line.strip().partition(".")
            fields, tabs = None, False
            if not dot or not name:
                raise FormatError(f"line {number}: no block header: {line!r}")
            if kind not in ("nodes", "edges"):
                raise FormatError(f"line {number}: unknown kind {kind!r}")
        elif fields is None:
            tabs = "\t" in line.strip()
            fields = [f for f, _ in _split(line, tabs)]
        else:
            values = _split(line, tabs)
            if len(values) != len(fields):
                raise FormatError(f"line {number}: {len(values)} values for {len(fields)} fields")
            yield kind, name, fields, values, tabs


def _split(line: str, tabs: bool) -> list[tuple[str, bool]]:
    return [(x.strip(), False) if not x.strip().startswith('"') else split_fields(x.strip(), "\t")[0] for x in line.split("\t")] if tabs else split_fields(line)


def _add(graph: PropertyGraph, kind: str, name: str, fields: list[str], values: list[tuple[str, bool]], tabs: bool = False) -> None:
    if tabs and kind == "nodes" and "id" not in fields:
        fields = ["id", *fields[1:]]
    got = dict(zip(fields, values, strict=True))
    props = lambda *keys: {k: typed(*v) for k, v in got.items() if k not in keys}
    if kind == "nodes":
        if "id" not in got:
            raise FormatError(f"a node of {name} has no id")
        graph.add_node(name, got["id"][0], **props("id"))
        return
    ends = []
    for own, other in (("source", "from"), ("target", "to")):
        text = got.get(own, got.get(other, (None,)))[0]
        if text is None:
            raise FormatError(f"an edge of {name} has no {own}")
        ref = NodeRef.of(text)
        if not (text.startswith(":") or tabs) or not ref.type or not ref.id:
            raise FormatError(f"{text!r} is no reference :type:id")
        ends.append(ref)
    graph.add_edge(name, *ends, **props("source", "target", "from", "to"))


def from_blocks(spark: SparkSession, text: str, name: str = "graph") -> PropertyGraph:
    """Strict: wrong arity, missing ids or endpoints, repeated rows and undefined endpoints are errors."""
    graph = PropertyGraph(spark, name=name)
    rows = list(_rows_of(text))
    for row in sorted(rows, key=lambda r: r[0] != "nodes"):
        _add(graph, *row)
    return graph


def parse_lines(lines: DataFrame) -> DataFrame:
    """(value) -> (kind, name, fields, texts, plain, error), one row for each line that isn't empty or a comment; a bad line has an error.

    Column functions only: the quoted fields of a line are found by one pattern.
    """
    line = F.trim(F.regexp_replace("value", "\r$", ""))
    rows = lines.select(line.alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    part = lambda k: F.regexp_extract("value", LINE, k)
    pattern = r'("(?:[^"\\]|\\.)*"|[^ \t"]+)'
    raw = F.regexp_extract_all(part(4), F.lit(pattern), F.lit(1))
    fields = F.filter(F.split(part(3), "[ \t]+"), lambda f: f != "")
    unescape = lambda t: F.replace(F.replace(F.replace(F.replace(F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit("\\\\"), F.lit("\0")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\0"), F.lit("\\"))
    rows = rows.select("value", part(1).alias("kind"), part(2).alias("name"), fields.alias("fields"), raw.alias("raw"), (part(4) != "").alias("some"), F.trim(F.regexp_replace(part(4), pattern, "")).alias("rest"))
    error = F.when(F.col("kind") == "", F.lit("no line of the format")).when(F.col("rest") != "", F.lit("a quote isn't closed")).when(F.size("fields") != F.size("raw"), F.lit("values and fields differ in number"))
    error = F.coalesce(error, F.when((F.col("kind") == "nodes") & ~F.array_contains("fields", "id"), F.lit("no id")).when((F.col("kind") == "edges") & ~(F.array_contains("fields", "source") & F.array_contains("fields", "target")), F.lit("no source or target")))
    texts = F.transform("raw", lambda t: F.when(F.startswith(t, F.lit('"')), unescape(t)).otherwise(t))
    plain = F.transform("raw", lambda t: ~F.startswith(t, F.lit('"')))
    keyed = _keyed()
    own = {"kind": F.col("kind"), "name": F.col("name"), "fields": F.col("fields"), "texts": texts, "plain": plain, "error": error}
    is_keyed = (F.col("kind") == "") & F.col("value").rlike(KEYED)
    rows = rows.where((F.col("kind") != "") | ~F.startswith("value", F.lit("graph.")))
    return rows.select(*(F.when(is_keyed, keyed[c]).otherwise(own[c]).alias(c) for c in own))


def _keyed() -> dict:
    """The parts of a line of key=value pairs, as columns over value."""
    part = lambda k: F.regexp_extract("value", KEYED, k)
    words = F.regexp_extract_all(part(3), F.lit(r'(\w+="[^"]*"|"[^"]*"|[^ \t]+)'), F.lit(1))
    ends = F.when(part(1) == "nodes", 1).otherwise(2)
    pairs = F.slice(words, ends + 1, F.size(words))
    value = lambda w: F.regexp_replace(w, r"(?s)^\w+=", "")
    bare = F.transform(pairs, lambda w: F.regexp_replace(value(w), r'(?s)^"(.*)"$', "$1"))
    keys = F.transform(pairs, lambda w: F.regexp_extract(w, r"^(\w+)=", 1))
    first = F.when(part(1) == "nodes", F.array(F.lit("id"))).otherwise(F.array(F.lit("source"), F.lit("target")))
    error = F.when(F.size(words) < ends, F.lit("no id, source or target")).when(F.exists(keys, lambda k: k == ""), F.lit("no key=value pair"))
    error = F.coalesce(error, F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("a key is given twice")))
    return {
        "kind": part(1), "name": part(2), "fields": F.concat(first, keys), "texts": F.concat(F.slice(words, 1, ends), bare),
        "plain": F.concat(F.transform(first, lambda x: F.lit(True)), F.transform(pairs, lambda w: ~F.startswith(value(w), F.lit('"')))), "error": error,
    }


def from_lines(spark: SparkSession, lines: DataFrame, name: str = "graph", permissive: bool = False) -> PropertyGraph:
    """A graph over parsed lines, one table for each type and relation, typed by what its values look like.

    Bad lines, repeated rows and undefined endpoints are errors, or are left out where permissive. The lines are parsed
    once, into a table by kind and name in the shared folder; small aggregates of it tell names and types, and each type
    reads its own part. No row is held by the driver.
    """
    pairs = F.when(F.col("error").isNull(), F.map_from_arrays("fields", F.arrays_zip("texts", "plain")))  # guarded: filters may be moved past it
    whole = F.col("error").isNull()
    parsed = stored(parse_lines(lines).select(pairs.alias("m"), "error", F.when(whole, F.col("kind")).otherwise("bad").alias("kind"), F.when(whole, F.col("name")).otherwise("bad").alias("name")), "kind", "name")
    if not permissive and (first := parsed.where("kind = 'bad'").first()):
        raise FormatError(first["error"])
    good = parsed.where("kind != 'bad'").select("kind", "name", "m")
    value = F.explode("m").alias("key", "v")
    look = F.when(~F.col("v.plain"), "string").when(F.col("v.texts").isin("null", "~"), "null").when(F.col("v.texts").isin("true", "false"), "boolean").when(F.col("v.texts").rlike(r"^-?\d{1,18}$"), "bigint").when(F.col("v.texts").rlike(r"^-?\d+\.\d+(?:[eE][+-]?\d+)?$"), "double").otherwise("string")
    kinds: dict[tuple[str, str], dict[str, set[str]]] = {}
    for r in good.select("kind", "name", value).groupBy("kind", "name", "key").agg(F.collect_set(look).alias("looks")).collect():
        kinds.setdefault((r["kind"], r["name"]), {})[r["key"]] = set(r["looks"]) - {"null"}
    nodes, edges = {}, {}
    for (kind, own), columns in kinds.items():
        rows = good.where((F.col("kind") == kind) & (F.col("name") == own))
        fixed = ("id",) if kind == "nodes" else ("source", "target")
        text = lambda c: F.col("m")[c]["texts"]
        made = []
        for c in sorted(set(columns) - set(fixed)):
            looks = columns[c]
            to = looks.copy().pop() if len(looks) == 1 else "double" if looks and looks <= {"bigint", "double"} else "string"
            null = F.col("m")[c]["plain"] & text(c).isin("null", "~")
            made.append(F.when(~null | ~F.col("m")[c]["plain"], text(c)).try_cast(to).alias(c))
        if kind == "nodes":
            nodes[own] = rows.select(text("id").alias("id"), *made)
        else:
            end = lambda c, n: F.split_part(text(c), F.lit(":"), F.lit(n))
            edges[own] = rows.select(end("source", 2).alias("src_type"), end("source", 3).alias("src_id"), end("target", 2).alias("dst_type"), end("target", 3).alias("dst_id"), *made)
    graph = PropertyGraph(spark, nodes, edges, name=name)
    if permissive:
        graph._nodes = {own: df.dropDuplicates(["id"]) for own, df in nodes.items()}
        refs = graph.refs()
        for own, df in edges.items():
            df = df.dropDuplicates(list(KEY))
            for side in ("src", "dst"):
                df = df.join(refs.select(F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id")), [f"{side}_type", f"{side}_id"], "left_semi")
            graph._edges[own] = df
        return graph
    if twice := graph.refs().groupBy("type", "id").count().where("count > 1").first():
        raise FormatError(f"node {tuple(twice)[:-1]} is given more than once")
    links = graph.links().drop(SEQ)
    if twice := links.groupBy("rel_type", *KEY).count().where("count > 1").first():
        raise FormatError(f"edge {tuple(twice)[:-1]} is given more than once")
    ends = links.select("rel_type", F.explode(F.array(*(F.struct(F.col(f"{x}_type").alias("type"), F.col(f"{x}_id").alias("id")) for x in ("src", "dst")))).alias("e")).select("rel_type", "e.type", "e.id")
    if lost := ends.distinct().join(graph.refs(), ["type", "id"], "left_anti").first():
        raise FormatError(f"edge {lost['rel_type']} leads to an undefined node :{lost['type']}:{lost['id']}")
    return graph


def load(spark: SparkSession, path: str, permissive: bool = False) -> PropertyGraph:
    """By extension: LINE_SUFFIX line by line, anything else as blocks; the graph is named after the file."""
    name = PurePosixPath(path).stem
    if path.endswith(LINE_SUFFIX):
        return from_lines(spark, spark.read.text(path), name, permissive)
    rows = spark.read.text(path, wholetext=True).collect()
    return from_blocks(spark, rows[0]["value"] if rows else "", name)


def save(graph: PropertyGraph, path: str) -> None:
    """By extension; the line format becomes a folder of part files, blocks one file in it."""
    if path.endswith(LINE_SUFFIX):
        to_lines(graph).write.mode("overwrite").text(path)
    else:
        graph.spark.createDataFrame([(to_blocks(graph).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
