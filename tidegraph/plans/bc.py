"""Betweenness centrality from one source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.plans.bfs import Levels
from tidegraph.plans.loop import Rounds
from tidegraph.store import materialize, release


def betweenness(graph: Graph, start: int, *, rounds: Rounds | None = None) -> DataFrame:
    """``(id, level, sigma, dependency)``: shortest paths from ``start`` (multi-edges
    count) and Brandes' dependency; nulls where ``start`` doesn't reach, sigma 0.

    Forward rounds leave out edges to vertices that have a level before they are
    aggregated; backward rounds look only at edges between a level and the next.
    """
    level = materialize(graph.vertices.where(F.col("id") == start).select("id", F.lit(0).alias("level"), F.lit(1.0).alias("sigma")), "bc")
    known, depth, size = Levels(level), 0, level.count()
    out_degrees, in_degrees = (materialize(graph.degrees(d), "degrees") for d in ("out", "in")) if rounds is not None else (None, None)
    edges_of = lambda some, degrees: some.join(degrees, "id").agg(F.sum("degree")).first()[0] or 0
    while size:
        if rounds is not None:
            rounds.add("bc_forward", size, edges_of(level, out_degrees))
        depth += 1
        sent = graph.edges.select("src", "dst").join(level.select(F.col("id").alias("src"), "sigma"), "src")
        fresh = sent.join(known.all().select(F.col("id").alias("dst")), "dst", "left_anti")
        level = materialize(fresh.groupBy(F.col("dst").alias("id")).agg(F.lit(depth).alias("level"), F.sum("sigma").alias("sigma")), "bc")
        size = level.count()
        known.add(level)
        level = known.parts[-1].where(F.col("level") == depth)
    reached = materialize(known.all(), "bc")
    release(*known.parts)
    done, share = None, 1 / F.col("sigma")
    for k in range(depth - 1, -1, -1):
        own = reached.where(F.col("level") == k)
        if done is None:
            dep = own.withColumn("dep", share)
        else:
            below = last.where(F.col("level") == k + 1).select(F.col("id").alias("dst"), "dep")  # noqa: F821
            if rounds is not None:
                rounds.add("bc_backward", below.count(), edges_of(below.withColumnRenamed("dst", "id"), in_degrees))
            back = graph.edges.select("src", "dst").join(own.select(F.col("id").alias("src")), "src").join(below, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("dep").alias("msg"))
            dep = own.join(back, "id", "left").withColumn("dep", share + F.coalesce("msg", F.lit(0.0))).drop("msg")
        last = materialize(dep, "bc")
        if done is None:
            done = Levels(last)
        else:
            done.add(last)
            last = done.parts[-1]
    found = reached.withColumn("dep", F.lit(0.0)).where("false") if done is None else done.all()
    found = found.select("id", "level", "sigma", ((F.col("dep") - 1 / F.col("sigma")) * F.col("sigma")).alias("dependency"))
    out = materialize(graph.vertices.select("id").join(found, "id", "left").withColumn("sigma", F.coalesce("sigma", F.lit(0.0))), "bc")
    release(reached, *(done.parts if done else []), *(d for d in (out_degrees, in_degrees) if d is not None))
    return out
