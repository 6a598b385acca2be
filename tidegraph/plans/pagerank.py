"""Delta PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.operators.edge_map import edge_map, merge
from tidegraph.plans.loop import Rounds
from tidegraph.store import materialize, release


def pagerank(graph: Graph, *, damping: float = 0.85, epsilon: float = 1e-2, epsilon2: float = 1e-7, max_rounds: int = 1000, stop: str = "delta", rounds: Rounds | None = None) -> DataFrame:
    """``(id, score, delta, active)``.

    Vertices whose last change was more than ``epsilon`` of their score send
    theirs on; a smaller change is dropped. What vertices without out-edges have
    is not dealt out again. Ends when changes sum to less than ``epsilon2``
    (``stop="frontier"``: when no vertex is active), or after ``max_rounds``.
    """
    n = graph.vertices.count()
    state = graph.degrees().select("id", F.col("degree").alias("od"), F.lit(0.0).alias("score"), F.lit(1.0 / max(n, 1)).alias("delta"), F.lit(True).alias("active"))
    state = last = materialize(state, "pagerank")
    sent = (n, state.agg(F.sum("od")).first()[0]) if rounds is not None else (0, 0)
    for k in range(1, max_rounds + 1):
        msgs = edge_map(graph, state, message="src.delta / src.od", active="src.active")
        came = damping * F.coalesce("msg", F.lit(0.0))
        if k == 1:
            base = (1 - damping) / max(n, 1)
            state = merge(state, msgs, __d=came + base).select("id", "od", (F.col("score") + F.col("__d")).alias("score"), (F.col("__d") - 1.0 / max(n, 1)).alias("delta"))
            state = state.withColumn("active", F.abs("delta") > epsilon * F.col("score"))
        else:
            state = merge(state, msgs, __d=came).withColumn("active", F.abs("__d") > epsilon * F.col("score"))
            state = state.select("id", "od", F.when(F.col("active"), F.col("score") + F.col("__d")).otherwise(F.col("score")).alias("score"), F.col("__d").alias("delta"), "active")
        new = materialize(state, "pagerank")
        release(last)
        state = last = new
        if rounds is not None:
            rounds.add("pagerank", sent[0], sent[1] or 0)
        if k == max_rounds:
            break
        change, active, edges = state.agg(F.sum(F.abs("delta")), F.count_if("active"), F.sum(F.when(F.col("active"), F.col("od")))).first()
        sent = active, edges
        if (change or 0.0) < epsilon2 if stop == "delta" else not active:
            break
    return state.select("id", "score", "delta", "active")
