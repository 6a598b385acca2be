"""Connected components of an edge table that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import materialize, spread_join
from tidegraph.store import release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(id, root)``: for each id in an edge, the smallest id
    that it reaches. Ids without an edge are absent; an empty table gives no rows.

    Large-star and small-star rounds until the edges are stars around their
    smallest id; the round count grows with the logarithm of the diameter. The
    neighbours of an id are never gathered: the minimum is an aggregate with a
    map-side combine, and ``spread_join`` brings it back, so that an id with
    very many neighbours is no task's alone. Each round is written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "cc")
    before = None
    for _ in range(max_rounds):
        # Large star: all greater neighbours of an id move to the least of it and its neighbours.
        both = e.select("a", "b", F.lit(0).alias("up")).unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1)))
        low = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"), F.sum("up").alias("n")).where("n > 0")
        up = materialize(low.select("b", F.least("m", "b").alias("m"), "n"), "cc")
        large = materialize(spread_join(e, up, "b", "n").select("a", F.col("m").alias("b")).distinct(), "cc")
        # Small star: all smaller neighbours of an id, and it itself, move to the least of them.
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "cc")
        moved = spread_join(large, low, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        release(e, up, large, low)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
