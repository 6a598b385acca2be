"""k-core numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.plans.bfs import MERGE
from tidegraph.plans.loop import Rounds
from tidegraph.store import materialize, release


def kcore(graph: Graph, *, min_k: int = 1, max_k: int = 10_000, rounds: Rounds | None = None) -> DataFrame:
    """``(id, core)``: the largest k of whose core a vertex is part. Degrees count both
    directions, multi-edges, and self-loops twice. Vertices that are left at
    ``max_k`` have core null. A step peels the vertices below k and counts their edges away from
    those that stay; only these are written again."""
    both = graph.degrees("out").unionAll(graph.degrees("in")).groupBy("id").agg(F.sum("degree").alias("deg"))
    full = materialize(both, "degrees")
    steps, left, done = 0, *(materialize(full.select("id", "deg"), "kcore"), None)
    k = min_k
    while k <= max_k:
        low = left.agg(F.min("deg")).first()[0]
        if low is None:
            break
        if low >= k:  # nothing to peel: on to the first k that peels
            k = int(low) + 1
            continue
        goes = materialize(left.where(F.col("deg") < k).select("id", F.lit(k - 1).alias("core")), "kcore")
        if rounds is not None:
            n, m = goes.join(full, "id").agg(F.count("*"), F.sum("deg")).first()
            rounds.add("kcore", n, m or 0)
        done = goes if done is None else done.unionAll(goes)
        sent = None
        for a, b in (("src", "dst"), ("dst", "src")):
            part = graph.edges.select("src", "dst").join(goes.select(F.col("id").alias(a)), a).select(F.col(b).alias("id"))
            sent = part if sent is None else sent.unionAll(part)
        peeled = sent.groupBy("id").agg(F.count("*").alias("msg"))
        stays = left.where(F.col("deg") >= k).join(peeled, "id", "left").select("id", (F.col("deg") - F.coalesce("msg", F.lit(0))).alias("deg"))
        new = materialize(stays, "kcore")
        release(left)
        left = new
        steps = steps + 1
        if steps % MERGE == 0:  # few tables, however many steps there are
            done = materialize(done, "kcore")
    rest = left.select("id", F.lit(None).cast("int").alias("core"))
    out = materialize(rest if done is None else done.unionAll(rest), "kcore")
    release(full, left)
    return out
