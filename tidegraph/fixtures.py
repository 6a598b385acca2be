"""Graphs derived from the driver's tables, and the tiny golden ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.store import materialize

T0 = (10, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (1, 2), (2, 1), (3, 3), (0, 2), (6, 7), (8, 5)])
T1 = (4, [(0, 1), (0, 2), (1, 3)])
T2 = (7, [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (6, 0)])
T3 = (6, [(5, 2), (5, 4), (3, 1)])


def tiny(spark: SparkSession, n: int, edges: list[tuple[int, int]]) -> Graph:
    return Graph(spark.range(n).select("id"), spark.createDataFrame(edges, "src long, dst long"))


def part_graph(spark: SparkSession, sf_dir: str, least_quantity: float | None = None) -> Graph:
    """Parts that follow each other in an order; ``least_quantity``: only edges of at least that, a sparser and deeper graph."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    edges = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").alias("q")).where("dst is not null")
    if least_quantity is not None:
        edges = edges.where(F.col("q") >= least_quantity)
    vertices = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    return Graph(vertices, edges.select("src", "dst", F.col("q").alias("weight")))


def settled_parts(spark: SparkSession, sf_dir: str, least_quantity: float | None = None) -> Graph:
    return part_graph(spark, sf_dir, least_quantity).settled()


def start_vertex(graph: Graph) -> int:
    """The vertex of most out-edges, ties by smaller id."""
    return graph.degrees().orderBy(F.desc("degree"), "id").first()["id"]


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


__all__ = ["T0", "T1", "T2", "T3", "materialize", "part_graph", "settled_parts", "start_vertex", "tiny", "user_events"]
