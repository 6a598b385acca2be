"""Sparse matrix by vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.operators.edge_map import edge_map, merge
from tidegraph.plans.loop import Rounds
from tidegraph.store import materialize, release


def spmv(graph: Graph, *, rounds: int = 20, weight: str = "2.0", accumulate: bool = True, rounds_log: Rounds | None = None) -> DataFrame:
    """``(id, value)`` after some rounds of ``value[dst] = sum(weight * value[src])``
    from ones. ``weight`` is an expression over ``edge.*``; ``accumulate``: sums go
    on from round to round instead of starting at zero."""
    state = graph.vertices.select("id", F.lit(1.0).alias("value"), F.lit(0.0).alias("sum"))
    size = (graph.vertices.count(), graph.edges.count()) if rounds_log is not None else (0, 0)
    for _ in range(rounds):
        came = F.coalesce("msg", F.lit(0.0))
        total = F.col("sum") + came if accumulate else came
        new = merge(state, edge_map(graph, state, message=f"({weight}) * src.value"), sum=total).withColumn("value", F.col("sum"))
        if rounds > 1:
            new = materialize(new, "spmv")
            release(state)
        if rounds_log is not None:
            rounds_log.add("spmv", *size)
        state = new
    return state.select("id", "value")
