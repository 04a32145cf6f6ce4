"""Degrees, components, connectivity, cycles and statistics of a graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY, NodeRef, PropertyGraph, both_ways
from .common import ONE_TASK_EDGES, cut

#: Rounds of peeling before the rest of a small core goes to one task.
PEEL_ROUNDS = 8


def degrees(graph: PropertyGraph, rel: str | None = None) -> DataFrame:
    """(type, id, in_degree, out_degree, degree) of every node. In an undirected graph degree counts distinct pairs of nodes, in a directed one a self-loop counts twice."""
    e = graph.links(rel)
    ends = e.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("type", "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = graph.refs().join(sums, ["type", "id"], "left").select("type", "id", zero("in_degree"), zero("out_degree"))
    if graph.directed:
        return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    pairs = e.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), "dst_type", "dst_id").distinct().groupBy("type", "id").agg(F.count("*").alias("degree"))
    return out.join(pairs, ["type", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def degree_of(graph: PropertyGraph, ref, rel: str | None = None) -> tuple[int, int, int]:
    """(in, out, degree) of one node by filtered scans; zeros for an unknown one."""
    ref = NodeRef.of(ref)
    into, out = graph.edges(rel, target=ref), graph.edges(rel, source=ref)
    n_in, n_out = into.count(), out.count()
    return n_in, n_out, n_in + n_out if graph.directed else out.select("dst_type", "dst_id").distinct().count()


def components(graph: PropertyGraph, rel: str | None = None) -> DataFrame:
    """(type, id, component_type, component_id): weak components named by their smallest node; isolated nodes are their own.

    Large-star and small-star steps over node keys, each round cut by a checkpoint, until nothing changes.
    """
    key = lambda t, i: F.concat_ws(":", t, i)
    e = graph.links(rel)
    now = cut(e.select(key("src_type", "src_id").alias("u"), key("dst_type", "dst_id").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if told == mark or not told["n"]:
            break
        mark = told
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        turned = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = turned.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
    own = graph.refs().withColumn("u", key("type", "id")).join(now.select("u", "v").distinct(), "u", "left").withColumn("v", F.coalesce("v", "u"))
    return own.select("type", "id", F.substring_index("v", ":", 1).alias("component_type"), F.expr("substring(v, locate(':', v) + 1)").alias("component_id"))


def component_count(graph: PropertyGraph, rel: str | None = None) -> int:
    return components(graph, rel).select("component_type", "component_id").distinct().count()


def is_connected(graph: PropertyGraph) -> bool:
    """Weakly; an empty graph is."""
    return component_count(graph) <= 1


def has_cycle(graph: PropertyGraph, rel: str | None = None) -> bool:
    """Directed: some edges lead back to their start (a self-loop does). Undirected: the edges aren't a forest, where parallel relations are edges of their own."""
    return _directed_cycle(graph.links(rel)) if graph.directed else _undirected_cycle(graph, rel)


def _directed_cycle(links: DataFrame) -> bool:
    e = cut(links.select(F.concat_ws(":", "src_type", "src_id").alias("u"), F.concat_ws(":", "dst_type", "dst_id").alias("v")).distinct())
    if not e.where("u = v").isEmpty():
        return True
    count, rounds = e.count(), 0
    while count:
        # an edge is on a cycle only if something leads to its start and its end leads on
        left = cut(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        n, rounds = left.count(), rounds + 1
        if n == count:
            return True
        e, count = left, n
        if rounds >= PEEL_ROUNDS and n <= ONE_TASK_EDGES:
            return not e.groupBy(F.lit(0).alias("one")).applyInPandas(_kahn, "cyclic boolean").where("cyclic").isEmpty()
    return False


def _kahn(edges: pd.DataFrame) -> pd.DataFrame:
    """Takes away nodes without incoming edges in linear time; what is left is cyclic."""
    codes, _ = pd.factorize(pd.concat([edges["u"], edges["v"]]))
    n, m = codes.max() + 1, len(edges)
    source, target = codes[:m], codes[m:]
    order = source.argsort(kind="stable")
    target, starts = target[order], pd.Series(source).value_counts().reindex(range(n), fill_value=0).cumsum().to_numpy()
    into = pd.Series(target).value_counts().reindex(range(n), fill_value=0).to_numpy().copy()
    ready, gone = [i for i in range(n) if not into[i]], 0
    while ready:
        u = ready.pop()
        gone += 1
        for v in target[(starts[u - 1] if u else 0) : starts[u]]:
            into[v] -= 1
            if not into[v]:
                ready.append(v)
    return pd.DataFrame({"cyclic": [bool(gone < n)]})


def _undirected_cycle(graph: PropertyGraph, rel: str | None) -> bool:
    """By counting: a self-loop, or more distinct (relation, pair) edges than nodes less components."""
    e = graph.links(rel)
    u, v = F.concat_ws(":", "src_type", "src_id"), F.concat_ws(":", "dst_type", "dst_id")
    pairs = e.select("rel_type", F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    told = pairs.agg(F.count("*").alias("n"), F.count(F.when(F.col("u") == F.col("v"), 1)).alias("loops")).first()
    if told["loops"]:
        return True
    return told["n"] > graph.refs().count() - component_count(graph, rel)


def hubs(graph: PropertyGraph, top: int = 5) -> DataFrame:
    """(type, id, degree, mean_degree, max_degree) of the `top` nodes of more than mean degree."""
    d = degrees(graph)
    stats = d.agg(F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    return d.join(F.broadcast(stats)).where("degree > mean_degree").orderBy(F.col("degree").desc(), "type", "id").limit(top).select("type", "id", "degree", "mean_degree", "max_degree")


def degree_histogram(graph: PropertyGraph, rel: str | None = None) -> DataFrame:
    return degrees(graph, rel).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def stats(graph: PropertyGraph) -> DataFrame:
    """(kind, name, n): rows by node type and by relation."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(t).alias("name"), "n") for t, df in graph.node_tables.items()]
    parts += [(df if graph.directed else both_ways(df.select(*KEY))).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit(r).alias("name"), "n") for r, df in graph.edge_tables.items()]
    out = parts[0] if parts else graph.spark.createDataFrame([], "kind string, name string, n long")
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
