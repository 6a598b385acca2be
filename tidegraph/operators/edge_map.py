"""Messages along edges: the join, filter and aggregate of one round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import Graph

COMBINE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "and": F.bool_and, "or": F.bool_or, "list": F.collect_list, "set": F.collect_set}


def edge_map(graph: Graph, state: DataFrame, *, message: Column | str, combine: str | Callable[[Column], Column] = "sum", active: Column | str | None = None, cond: Column | str | None = None, direction: str = "out", prop_blocking: bool = False, gather: dict[str, Column] | None = None, no_output: bool = False):
    """``(id, msg)``: what the active vertices' messages come to at each vertex.

    With ``gather``, columns set from a vertex's own ones and ``msg`` where one came: the new state, and
    the frontier of vertices that got a message; with ``no_output`` the new state alone.

    ``message`` is an expression over ``src.*`` and ``edge.*``; ``active`` one over
    ``src.*`` (all vertices without it); ``cond`` one over ``dst.*``, applied before
    messages are aggregated. ``direction``: along edges ("out"), against them
    ("in") or both. ``prop_blocking`` is accepted and means nothing here: every
    combine is a shuffle with a map-side part.
    """
    views = {"out": [graph], "in": [graph.transposed()], "both": [graph, graph.transposed()]}[direction]
    expr = lambda e: F.expr(e) if isinstance(e, str) else e
    src = state.alias("src") if active is None else state.alias("src").where(expr(active))
    out = None
    for view in views:
        sent = view.edges.alias("edge").join(src, F.col("edge.src") == F.col("src.id"))
        if cond is not None:
            sent = sent.join(state.alias("dst").where(expr(cond)), F.col("edge.dst") == F.col("dst.id"))
        sent = sent.select(F.col("edge.dst").alias("id"), expr(message).alias("msg"))
        out = sent if out is None else out.unionAll(sent)
    f = COMBINE[combine] if isinstance(combine, str) else combine
    messages = out.groupBy("id").agg(f(F.col("msg")).alias("msg"))
    if gather is None:
        return messages
    came = F.col("__came").isNotNull()
    after = state.join(messages.withColumn("__came", F.lit(True)), "id", "left").withColumns({k: F.when(came, v).otherwise(F.col(k)) for k, v in gather.items()}).drop("msg", "__came")
    return after if no_output else (after, messages.select("id"))


def merge(state: DataFrame, messages: DataFrame, **columns: Column) -> DataFrame:
    """``state`` with columns set from its own ones and ``msg`` (null: none came)."""
    return state.join(messages, "id", "left").withColumns(columns).drop("msg")


def gather_apply_scatter(graph: Graph, state: DataFrame, *, gather: Column | str, combine: str = "sum", apply: dict[str, Column], scatter: Column | None = None, direction: str = "in") -> DataFrame:
    """One synchronous round in the gather, apply, scatter form: combine what comes
    along in-edges (or "out"), set columns from ``msg``, mark who is active next."""
    along = {"in": "out", "out": "in"}[direction]
    after = merge(state, edge_map(graph, state, message=gather, combine=combine, direction=along), **apply)
    return after if scatter is None else after.withColumn("active", scatter)
