"""Rounds and what they report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of a graph's edges above which a round counts as dense.
DENSE_SHARE = 0.005


@dataclass
class Rounds:
    """A row for each edge map: its number, kind, active vertices and their edges, seconds."""

    rows: list[tuple[int, str, int, int, float]] = field(default_factory=list)
    began: float = field(default_factory=time.perf_counter)

    def add(self, kind: str, n_active: int, m_active: int) -> None:
        now = time.perf_counter()
        self.rows.append((len(self.rows) + 1, kind, n_active, m_active, now - self.began))
        self.began = now

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "round int, kind string, n_active long, m_active long, seconds double")

    def report(self, spark: SparkSession, graph_edges: int, edge_bytes: int = 4) -> DataFrame:
        """Rounds with their direction (dense or sparse) and the bytes of the edges they look at."""
        dense = F.col("n_active") + F.col("m_active") > DENSE_SHARE * graph_edges
        return self.frame(spark).withColumns({"direction": F.when(dense, "dense").otherwise("sparse"), "bytes": F.col("m_active") * edge_bytes})

    def totals(self, spark: SparkSession, edge_bytes: int = 4) -> DataFrame:
        """Per kind: rounds, edges, bytes, seconds and bytes a second."""
        f = self.frame(spark).groupBy("kind").agg(F.count("*").alias("rounds"), F.sum("m_active").alias("edges"), F.sum("seconds").alias("seconds"))
        return f.withColumn("bytes", F.col("edges") * edge_bytes).withColumn("bytes_per_second", F.try_divide("bytes", "seconds"))


def derived(tasks: DataFrame, edges: int, edge_bytes: int = 4) -> DataFrame:
    """``tasks(round, task, bytes, seconds)`` of a run over so many edges -> one row of what follows:
    bytes read a second, bytes read for each byte of edges, and how unevenly tasks read and ran
    (the sum over rounds of the greatest, by that of the least)."""
    per = tasks.groupBy("round").agg(F.sum("bytes").alias("b"), F.max("seconds").alias("slow"), F.min("seconds").alias("fast"), F.max("bytes").alias("much"), F.min("bytes").alias("little"))
    one = per.agg(F.sum("b").alias("bytes"), F.sum("slow").alias("seconds"), F.sum("fast").alias("fast"), F.sum("much").alias("much"), F.sum("little").alias("little"))
    return one.select("bytes", "seconds", F.try_divide("bytes", "seconds").alias("io_bw"), (F.col("bytes") / F.lit(edges * edge_bytes)).alias("io_amp"), F.try_divide("much", "little").alias("io_skew"), F.try_divide("seconds", "fast").alias("compute_skew"))
