"""Weakly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.plans.loop import Rounds
from tidegraph.store import materialize, release

#: Labels (two numbers each) that are broadcast; more are joined by a shuffle.
FEW_LABELS = 1 << 20


def wcc(graph: Graph, *, rounds: Rounds | None = None) -> DataFrame:
    """``(id, label)``: the smallest id of each vertex's component.

    Vertices start as their own labels. In each round, a label learns the smallest label
    across any edge of its vertices, follows that to its end, and vertices take it over: with edges
    relabelled and those within a label dropped, the graph shrinks to the
    components' own labels, in a few rounds. Only labels that change are looked up by vertices, by a broadcast where
    they are few: no shuffle is keyed by a label that most vertices share.
    """
    state = materialize(graph.vertices.select("id", F.col("id").alias("label")), "wcc")
    ends = graph.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    left = materialize(ends.where("a <> b").distinct(), "wcc")
    while True:
        m = left.count()
        if rounds is not None:
            rounds.add("wcc", left.select("a").unionAll(left.select("b")).distinct().count(), 2 * m)
        if not m:
            release(left)
            return state
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("label"), F.least("a", "m").alias("to")), "wcc")
        while True:  # follow labels to their ends; each step doubles what is followed
            onward = up.select(F.col("label").alias("__at"), F.col("to").alias("__on"))
            jumped = materialize(up.join(onward, F.col("to") == F.col("__at"), "left").select("label", F.coalesce("__on", "to").alias("next"), "to"), "wcc")
            moved = not jumped.where("next <> to").isEmpty()
            release(up)
            up = materialize(jumped.select("label", F.col("next").alias("to")), "wcc")
            release(jumped)
            if not moved:
                break
        changed = materialize(up.where("label <> to"), "wcc")
        few = changed.count() <= FEW_LABELS
        look = (lambda df: F.broadcast(df)) if few else (lambda df: df)
        new = materialize(state.join(look(changed), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "wcc")
        a, b = (look(changed.select(F.col("label").alias(c), F.col("to").alias(f"{c}_to"))) for c in ("a", "b"))
        ends = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        rest = materialize(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "wcc")
        release(state, left, up, changed)
        state, left = new, rest


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def component_summary(labels: DataFrame) -> DataFrame:
    """One row: components, those of more than one vertex, the largest (ties: smaller
    label), its size and share of all vertices."""
    s = component_sizes(labels)
    one = s.agg(F.count("*").alias("n_components"), F.count_if(F.col("size") > 1).alias("n_nontrivial"), F.max(F.struct("size", -F.col("label"))).alias("top"), F.sum("size").alias("n"))
    return one.select("n_components", "n_nontrivial", (-F.col("top.col2")).alias("largest"), F.col("top.size").alias("largest_size"), F.round(F.try_divide("top.size", "n"), 9).alias("ratio"))
