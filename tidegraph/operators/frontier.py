"""Sets of active vertices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.graph import Graph, running_sum

#: Share of a graph's edges above which a frontier counts as dense.
DENSE_SHARE = 0.005


@dataclass(frozen=True)
class Frontier:
    """A set of vertex ids: a table ``(id)`` without repeats."""

    ids: DataFrame

    @staticmethod
    def of(df: DataFrame, column: str = "id") -> Frontier:
        return Frontier(df.select(F.col(column).cast("long").alias("id")).distinct())

    @staticmethod
    def all(graph: Graph) -> Frontier:
        return Frontier(graph.vertices.select("id"))

    @staticmethod
    def empty(graph: Graph) -> Frontier:
        return Frontier(graph.vertices.select("id").where(F.lit(False)))

    def activate(self, *ids: int) -> Frontier:
        more = self.ids.sparkSession.createDataFrame([(i,) for i in ids], "id long")
        return Frontier(self.ids.unionAll(more).distinct())

    def contains(self, df: DataFrame) -> DataFrame:
        return df.join(self.ids, "id", "left_semi")

    def union(self, other: Frontier) -> Frontier:
        return Frontier(self.ids.union(other.ids).distinct())

    def intersect(self, other: Frontier) -> Frontier:
        return Frontier(self.ids.join(other.ids, "id", "left_semi"))

    def minus(self, other: Frontier) -> Frontier:
        return Frontier(self.ids.join(other.ids, "id", "left_anti"))

    def xor(self, other: Frontier) -> Frontier:
        return Frontier(self.minus(other).ids.unionAll(other.minus(self).ids))

    def reset(self, first: int, last: int) -> Frontier:
        """Without the ids from ``first`` to ``last``, both included."""
        return Frontier(self.ids.where(~F.col("id").between(first, last)))

    def offsets(self) -> DataFrame:
        """``(id, place)``: the ids in order, numbered from 0."""
        return running_sum(self.ids, "id", F.lit(1), "place").select("id", F.col("place").cast("long").alias("place"))

    def count(self) -> int:
        return self.ids.count()

    def is_empty(self) -> bool:
        return self.ids.isEmpty()

    def save(self, path: str) -> None:
        self.ids.write.mode("overwrite").parquet(path)

    def edges(self, graph: Graph) -> DataFrame:
        """One row ``(n_active, m_active, kind)``: active vertices, their out-edges, and
        whether the two make a dense share of the graph's edges."""
        d = graph.degrees().join(self.ids.withColumn("__on", F.lit(True)), "id", "left")
        on = F.col("__on").isNotNull()
        c = d.agg(F.count_if(on).alias("n_active"), F.coalesce(F.sum(F.when(on, F.col("degree"))), F.lit(0)).alias("m_active"), F.sum("degree").alias("m"))
        return c.select("n_active", "m_active", F.when(F.col("n_active") + F.col("m_active") > DENSE_SHARE * F.col("m"), "dense").otherwise("sparse").alias("kind"))
