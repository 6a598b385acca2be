"""Breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.plans.loop import Rounds
from tidegraph.store import materialize, release

#: Tables of single levels that are merged into one.
MERGE = 12


class Levels:
    """Tables of the levels so far, few of them however deep the graph is."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, level: DataFrame) -> None:
        self.parts.append(level)
        if len(self.parts) > MERGE:
            merged = materialize(self.all(), "levels")
            release(*self.parts)
            self.parts = [merged]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionAll(p)
        return out


def bfs(graph: Graph, start: int, *, rounds: Rounds | None = None) -> DataFrame:
    """``(id, depth, parent)`` of the vertices that ``start`` reaches; it is its own
    parent, others have their smallest in-neighbour of the level before.

    A round takes the last level's edges, leaves out those to vertices that have a depth
    before they are aggregated, and writes the new level only.
    """
    level = graph.vertices.where(F.col("id") == start).select("id", F.lit(0).alias("depth"), F.col("id").alias("parent"))
    level = materialize(level, "bfs")
    known, depth, size = Levels(level), 0, level.count()
    degrees = materialize(graph.degrees(), "degrees") if rounds is not None else None
    while size:
        if rounds is not None:
            rounds.add("bfs", size, level.join(degrees, "id").agg(F.sum("degree")).first()[0] or 0)
        depth += 1
        sent = graph.edges.select("src", "dst").join(level.select(F.col("id").alias("src")), "src")
        fresh = sent.join(known.all().select(F.col("id").alias("dst")), "dst", "left_anti")
        level = materialize(fresh.groupBy(F.col("dst").alias("id")).agg(F.lit(depth).alias("depth"), F.min("src").alias("parent")), "bfs")
        size = level.count()
        known.add(level)
        level = known.parts[-1].where(F.col("depth") == depth)
    if degrees is not None:
        release(degrees)
    return known.all()
