"""Parquet edge tables, the native format."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidegraph.graph import Graph


def read(spark: SparkSession, edges: str, vertices: str | None = None) -> Graph:
    return Graph.of(spark.read.parquet(edges), spark.read.parquet(vertices) if vertices else None)


def write(graph: Graph, folder: str) -> None:
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    graph.vertices.write.mode("overwrite").parquet(f"{folder}/vertices")
