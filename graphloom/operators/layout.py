"""Layouts and drawing of small graphs on the driver: the bound is checked before anything is collected."""

from __future__ import annotations

import argparse
import html
import json
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import NodeRef, PropertyGraph
from .common import TooLargeError

#: Most nodes that are drawn; pick a subgraph beyond.
MOST_NODES = 5_000
COLOURS = ("#3366cc", "#dc7f18", "#2f8f4e", "#b5355b", "#7b52ab", "#00838f", "#8a6d3b", "#5c6b73")
OTHER = "#9aa0a6"


def _held(graph: PropertyGraph, most: int) -> tuple[list[NodeRef], list[tuple[str, NodeRef, NodeRef]]]:
    n = graph.node_count()
    if n > most:
        raise TooLargeError(f"{n} nodes; at most {most} can be laid out")
    refs = [NodeRef(*r) for r in graph.refs().orderBy("type", "id").collect()]
    edges = [(r["rel_type"], NodeRef(r["src_type"], r["src_id"]), NodeRef(r["dst_type"], r["dst_id"])) for r in graph.edges().select("rel_type", "src_type", "src_id", "dst_type", "dst_id").collect()]
    return refs, sorted(edges)


def _bounded(nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """nodes, whose order over all passes one task, if they are few enough to draw."""
    n = nodes.limit(most + 1).count()
    if n > most:
        raise TooLargeError(f"more than {most} nodes can't be laid out")
    return nodes


# Fixed values of the shared generator: multiplier 1664525, increment 1013904223, modulus 2**32; layouts take 170 iterations and seed 42.
def _random(seed: int, n: int) -> list[float]:
    """n numbers in [0, 1) of the linear congruential generator that layouts share."""
    state, out = seed & 0xFFFFFFFF, []
    for _ in range(n):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(state / 2.0**32)
    return out


def _length(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.sqrt(x * x + y * y)
    return np.where(d == 0, 0.01, d)


def compute_layout(graph: PropertyGraph, width: int = 900, height: int = 600, iterations: int = 170, seed: int = 42, margin: int = 60, radii: dict[NodeRef, float] | None = None, spacing: float = 1.0, most: int = MOST_NODES) -> dict[NodeRef, tuple[float, float]]:
    """Force-directed positions (Fruchterman and Reingold), the same for the same graph, size and seed to the last bit.

    Forces are matrices over nodes in the order of (type, id); sums run along that order, as their rounding depends on
    it. With radii, overlapping circles are pushed apart afterwards, in at most 50 rounds.
    """
    refs, edges = _held(graph, most)
    n = len(refs)
    if n < 2:
        return {r: (width / 2.0, height / 2.0) for r in refs}
    inner = max(1.0, width - 2.0 * margin), max(1.0, height - 2.0 * margin)
    p = margin + np.array(_random(seed, 2 * n)).reshape(n, 2) * np.array(inner)
    place = {r: i for i, r in enumerate(refs)}
    pairs = sorted({tuple(sorted((place[a], place[b]))) for _, a, b in edges if a != b and a in place and b in place})
    ends = np.array(pairs, np.int64).reshape(-1, 2)
    k = np.sqrt(inner[0] * inner[1] / n)
    heat = min(inner) / 10.0
    cooling = heat / (iterations + 1)
    low, high = np.array([margin, margin], float), np.array([width - margin, height - margin], float)
    for _ in range(iterations):
        dx, dy = p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1]
        d = _length(dx, dy)
        push = (k * k) / d
        move = np.stack([((dx / d) * push).cumsum(1)[:, -1], ((dy / d) * push).cumsum(1)[:, -1]], 1)
        if len(ends):
            dx, dy = (p[ends[:, 0]] - p[ends[:, 1]]).T
            d = _length(dx, dy)
            pull = (d * d) / k
            force = np.stack([(dx / d) * pull, (dy / d) * pull], 1)
            np.add.at(move, ends.ravel(), np.stack([-force, force], 1).reshape(-1, 2))
        d = _length(move[:, 0], move[:, 1])
        p = np.minimum(high, np.maximum(low, p + (move / d[:, None]) * np.minimum(d, heat)[:, None]))
        heat = max(0.01, heat - cooling)
    if radii:
        _push_apart(p, np.array([float(radii.get(r, 0.0)) for r in refs]), spacing, low, high)
    return {r: (float(x), float(y)) for r, (x, y) in zip(refs, p, strict=True)}


def _push_apart(p: np.ndarray, radius: np.ndarray, spacing: float, low: np.ndarray, high: np.ndarray) -> None:
    """Moves both circles of an overlapping pair by half of what they lack, pair after pair."""
    for _ in range(50):
        moved = False
        for i in range(len(p) - 1):
            j = i + 1
            while j < len(p):
                gap = p[j:] - p[i]
                lack = (radius[i] + radius[j:]) * spacing - np.sqrt(gap[:, 0] ** 2 + gap[:, 1] ** 2)
                hit = np.flatnonzero(lack > 0)
                if not len(hit):
                    break
                step, way, short = hit[0], gap[hit[0]], lack[hit[0]]
                d = np.sqrt(way[0] * way[0] + way[1] * way[1])
                way = way / d if d >= 1e-9 else np.array([1.0, 0.0])
                p[i] = np.minimum(high, np.maximum(low, p[i] - way * (short / 2)))
                p[j + step] = np.minimum(high, np.maximum(low, p[j + step] + way * (short / 2)))
                moved = True
                j += step + 1
        if not moved:
            return


def circular_layout(nodes: DataFrame, width: int = 900, height: int = 600) -> DataFrame:
    """(type, id) -> with x, y on a circle, in the order of (type, id); at most MOST_NODES."""
    nodes = _bounded(nodes)
    at = (F.row_number().over(Window.orderBy("type", "id")) - 1) * F.lit(2 * np.pi) / F.count("*").over(Window.partitionBy())
    return nodes.select("type", "id", (F.lit(width / 2) + F.lit(min(width, height) / 3) * F.cos(at)).alias("x"), (F.lit(height / 2) + F.lit(min(width, height) / 3) * F.sin(at)).alias("y"))


def hierarchical_layout(nodes: DataFrame, width: int = 900, top: int = 50, step: int = 150) -> DataFrame:
    """(type, id) -> with x, y: a row for each type, in the order of types; at most MOST_NODES."""
    nodes = _bounded(nodes)
    level = F.dense_rank().over(Window.orderBy("type")) - 1
    own = Window.partitionBy("type")
    x = F.row_number().over(own.orderBy("id")) * F.lit(float(width)) / (F.count("*").over(own) + 1)
    return nodes.select("type", "id", x.alias("x"), (F.lit(float(top)) + level * step).alias("y"))


def render_svg(graph: PropertyGraph, width: int = 900, height: int = 600, label: str | None = None, seed: int = 42, title: str | None = None) -> str:
    """A drawing: colour by type, radius by degree; of an undirected edge's two directions one line."""
    refs, edges = _held(graph, MOST_NODES)
    degree = dict.fromkeys(refs, 0)
    for _, a, b in edges:
        for r in (a, b):
            degree[r] = degree.get(r, 0) + 1
    low, high = min(degree.values(), default=0), max(degree.values(), default=0)
    radius = {r: 8.0 if high == low else 8.0 + 10.0 * (d - low) / (high - low) for r, d in degree.items()}
    at = compute_layout(graph, width, height, seed=seed, radii=radius, spacing=1.2)
    kinds = sorted({r.type for r in refs})
    colour = {t: COLOURS[i] if i < len(COLOURS) else OTHER for i, t in enumerate(kinds)}
    names = {}
    if label:
        for t, df in graph.node_tables.items():
            if label in df.columns:
                names |= {NodeRef(t, str(r["id"])): str(r[label]) for r in df.select("id", label).collect() if r[label] is not None}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}" role="img">', f"<title>{html.escape(title or graph.name)}</title>"]
    if graph.directed:
        out.append('<defs><marker id="tip" viewBox="0 0 8 8" refX="8" refY="4" markerWidth="7" markerHeight="7" orient="auto"><path d="M0 0L8 4L0 8z" fill="#666"/></marker></defs>')
    drawn = set()
    for rel, a, b in edges:
        if a == b or a not in at or b not in at or (not graph.directed and (rel, b, a) in drawn):
            continue
        drawn.add((rel, a, b))
        (x1, y1), (x2, y2) = at[a], at[b]
        d = float(np.hypot(x2 - x1, y2 - y1)) or 1.0
        x2, y2 = x2 - (x2 - x1) / d * (radius[b] + 3), y2 - (y2 - y1) / d * (radius[b] + 3)
        out.append(f'<line class="edge" x1="{x1:.2f}" y1="{y1:.2f}" x2="{x2:.2f}" y2="{y2:.2f}" stroke="#999"{" marker-end=\"url(#tip)\"" if graph.directed else ""}><title>{html.escape(rel)}</title></line>')
    for r in refs:
        x, y = at[r]
        out.append(f'<g class="node"><circle cx="{x:.2f}" cy="{y:.2f}" r="{radius[r]:.2f}" fill="{colour[r.type]}"><title>{html.escape(f"{r.type}:{r.id}")}</title></circle><text x="{x:.2f}" y="{y + radius[r] + 12:.2f}" text-anchor="middle" font-size="11">{html.escape(names.get(r, r.id))}</text></g>')
    for i, t in enumerate(kinds):
        out.append(f'<g class="legend"><circle cx="16" cy="{16 + 18 * i}" r="6" fill="{colour[t]}"/><text x="28" y="{20 + 18 * i}" font-size="12">{html.escape(t)}</text></g>')
    return "\n".join([*out, "</svg>"])


def render_html(graph: PropertyGraph, **options) -> str:
    """The drawing in a page of its own, with the nodes' properties as data."""
    nodes = {f"{r['type']}:{r['id']}": json.loads(r["properties"]) for r in graph.nodes().collect()}
    data = json.dumps(nodes, ensure_ascii=True).replace("<", "\\u003c")
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{html.escape(graph.name)}</title></head>\n<body>\n{render_svg(graph, **options)}\n<script type="application/json" id="nodes">{data}</script>\n</body></html>\n'


def save(graph: PropertyGraph, path: str, **options) -> None:
    Path(path).write_text(render_svg(graph, **options) if path.endswith(".svg") else render_html(graph, **options), encoding="utf-8")


def main(args: list[str] | None = None) -> int:
    """python -m graphloom.operators.layout GRAPH OUT [--label PROPERTY]"""
    from pyspark.sql import SparkSession

    from ..sources.text import load

    parser = argparse.ArgumentParser(description="Draws a graph file as SVG or HTML.")
    parser.add_argument("graph"), parser.add_argument("out"), parser.add_argument("--label")
    given = parser.parse_args(args)
    save(load(SparkSession.builder.getOrCreate(), given.graph), given.out, label=given.label)
    return 0


if __name__ == "__main__":
    sys.exit(main())
