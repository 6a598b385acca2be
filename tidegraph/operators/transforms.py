"""Graphs from graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.graph import Graph, running_sum
from tidegraph.store import materialize


def symmetrize(graph: Graph) -> Graph:
    """Adds every edge's reverse, but for self-loops; nothing is merged."""
    back = graph.transposed().edges.where("src <> dst")
    return Graph(graph.vertices, graph.edges.unionByName(back))


def permute(graph: Graph, mapping: DataFrame) -> Graph:
    """Renames vertices by ``mapping(id, new_id)``, a bijection on them."""
    m = mapping.select(F.col("id").alias("__id"), F.col("new_id").alias("__new"))
    out = {}
    for c in ("src", "dst"):
        out[c] = m.withColumnsRenamed({"__id": f"__{c}", "__new": f"__new_{c}"})
    edges = graph.edges.join(out["src"], F.col("src") == F.col("__src")).join(out["dst"], F.col("dst") == F.col("__dst"))
    edges = edges.withColumns({"src": F.col("__new_src"), "dst": F.col("__new_dst")}).select(graph.edges.columns)
    vertices = graph.vertices.join(m, F.col("id") == F.col("__id")).withColumn("id", F.col("__new")).select(graph.vertices.columns)
    return Graph(vertices, edges)


def sort_edges(graph: Graph, *by: str) -> DataFrame:
    """``(src, pos, ...)``: each vertex's edges numbered in the order of ``by``."""
    w = Window.partitionBy("src").orderBy(*(by or ("dst",)))
    return graph.edges.withColumn("pos", F.row_number().over(w).cast("int"))


def balanced_ranges(graph: Graph, parts: int, node_weight: int = 1, edge_weight: int = 1) -> DataFrame:
    """``(part, first_id, last_id, weight)``: contiguous id ranges of about equal weight."""
    d = graph.degrees().withColumn("w", (F.lit(node_weight) + F.lit(edge_weight) * F.col("degree")).cast("long"))
    total = d.agg(F.sum("w").alias("total"))
    d = running_sum(d, "id", F.col("w"), "before").join(F.broadcast(total))
    part = F.floor(F.col("before") * parts / F.col("total")).cast("int")
    return d.groupBy(part.alias("part")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("w").alias("weight"))


def add_vertices(graph: Graph, ids: DataFrame) -> Graph:
    return Graph(graph.vertices.unionByName(ids, allowMissingColumns=True).dropDuplicates(["id"]), graph.edges)


def add_edges(graph: Graph, edges: DataFrame, *, unique: bool = False) -> Graph:
    """Adds edges; ``unique``: only those whose ends aren't joined yet, once each."""
    if unique:
        edges = edges.dropDuplicates(["src", "dst"]).join(graph.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return Graph(graph.vertices, graph.edges.unionByName(edges, allowMissingColumns=True))


def remove_edges(graph: Graph, pairs: DataFrame) -> Graph:
    """Drops all edges between the pairs ``(src, dst)``."""
    return Graph(graph.vertices, graph.edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(graph.edges.columns))


def remove_vertices(graph: Graph, ids: DataFrame) -> Graph:
    """Drops vertices and the edges at them."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    edges = graph.edges.join(gone, F.col("src") == F.col("__gone"), "left_anti").join(gone, F.col("dst") == F.col("__gone"), "left_anti")
    return Graph(graph.vertices.join(gone, F.col("id") == F.col("__gone"), "left_anti"), edges)


def nearest_point(points: DataFrame, queries: DataFrame, *, cell: float, within: float | None = None) -> DataFrame:
    """``queries(qid, qx, qy)`` -> ``(qid, id, distance)``: the nearest of
    ``points(id, x, y)``, ties by smaller id; null where there are no points, or,
    if ``within`` is given, none as near as that. Null, NaN and infinite coordinates have no distance.

    Points and queries meet by grid cells: a query looks at its own and the eight
    around it, not at all points. What is found within the size of a cell is the
    nearest; the other queries look again at cells of twice the size, until one
    look takes in all points.
    """
    fine = lambda x, y: (F.abs(x) < math.inf) & (F.abs(y) < math.inf)
    points = points.where(fine("x", "y"))
    ends = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    a, b = ends(points, "x", "y"), ends(queries.where(fine("qx", "qy")), "qx", "qy")
    last = 0.0 if a[0] is None or b[0] is None else math.hypot(max(a[1], b[1]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[2], b[2]))
    last = last if within is None else min(last, within)
    left, found, size = queries.where(fine("qx", "qy")).select("qid", "qx", "qy"), None, cell
    while True:
        at = lambda c, size=size: F.floor(F.col(c) / size).cast("long")
        own = points.select("id", "x", "y", at("x").alias("cx"), at("y").alias("cy"))
        steps = lambda c, n, at=at: F.explode(F.array(*(at(c) + d for d in (-1, 0, 1)))).alias(n)
        asked = left.select("qid", "qx", "qy", steps("qx", "cx")).select("*", steps("qy", "cy"))
        d = F.sqrt((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2)
        near = asked.join(own, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= (size if within is None else min(size, within)))
        best = materialize(near.groupBy("qid").agg(F.min(F.struct("distance", "id")).alias("best")), "nearest")
        found = best if found is None else found.unionAll(best)
        if size >= last:
            break
        left = materialize(left.join(best, "qid", "left_anti"), "unanswered")
        if left.isEmpty():
            break
        size *= 2
    return queries.select("qid").join(found, "qid", "left").select("qid", F.col("best.id").alias("id"), F.col("best.distance").alias("distance"))


def bin_edges(graph: Graph, bits: int, value: Column) -> DataFrame:
    """``(bin, n, total)``: messages by the high bits of their destination."""
    return graph.edges.groupBy(F.shiftright("dst", bits).alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
