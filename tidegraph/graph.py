"""The property graph: a vertex table and a multiset of directed edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.store import bucketed, materialize

PAGE_BYTES = 4096
EDGE_BYTES = 4
#: Rows in a block of a running sum, about: one task sums a block.
SUM_BLOCK = 1 << 20


def running_sum(df: DataFrame, order: str, value: Column, name: str, block: int = SUM_BLOCK) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over rows of smaller ``order`` (unique integers, however sparse).

    Rows are cut into blocks of about ``block`` rows by the quantiles of ``order``, so that no task
    sees more than a block, or one row for each block.
    """
    n = df.count()
    blocks = -(-n // block)
    cuts = df.stat.approxQuantile(order, [k / blocks for k in range(1, blocks)], min(0.01, 0.2 / blocks)) if blocks > 1 else []
    number = F.lit(0)
    if cuts:
        edges = F.array(*(F.lit(int(c)) for c in sorted(set(cuts))))
        number = F.size(F.filter(edges, lambda c: c < F.col(order)))
    keyed = df.withColumns({"__block": number, "__value": value})
    totals = keyed.groupBy("__block").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__block"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    # One row for each block.
    return summed.join(F.broadcast(totals), "__block").withColumn(name, F.col("__before") + F.col("__inside")).drop("__block", "__value", "__inside", "__before")


@dataclass(frozen=True)
class Graph:
    """``vertices(id BIGINT, ...)`` and ``edges(src BIGINT, dst BIGINT, ...)``.

    Duplicate edges and self-loops count. Ids are unique, and every edge's ends
    are vertices.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """A graph of an edge table; by default its vertices are the edges' ends."""
        edges = edges.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")})
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        return Graph(vertices.withColumn("id", F.col("id").cast("long")), edges)

    def settled(self, *, bucket: bool = True) -> Graph:
        """The same graph as written tables, for loops that read it in every round;
        ``bucket``: edges by src, so that rounds don't shuffle them. ``release`` them when done."""
        edges = bucketed(self.edges, "src", "edges") if bucket else materialize(self.edges, "edges")
        return Graph(materialize(self.vertices, "vertices"), edges)

    def transposed(self) -> Graph:
        """The in-view: edges turned round."""
        turned = {"src": "dst", "dst": "src"}
        return Graph(self.vertices, self.edges.select(*(F.col(turned.get(c, c)).alias(c) for c in self.edges.columns)))

    def degrees(self, direction: str = "out") -> DataFrame:
        """``(id, degree)`` of every vertex."""
        end = "src" if direction == "out" else "dst"
        counts = self.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def non_empty(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("id")).distinct()

    def neighbors(self, vertex: int, direction: str = "out") -> DataFrame:
        """Ends of a vertex's edges: ``dst``, or of in-edges ``src``."""
        at, other = ("src", "dst") if direction == "out" else ("dst", "src")
        return self.edges.where(F.col(at) == vertex).select(other)

    def in_edges(self, symmetric: bool = False) -> DataFrame:
        """``(id, nbr, ...)``: each vertex's in-edges; of a symmetric graph its out-edges, which are the same."""
        at, other = ("src", "dst") if symmetric else ("dst", "src")
        return self.edges.withColumnsRenamed({at: "id", other: "nbr"})

    def edge_blocks(self, width: int) -> DataFrame:
        """Edges laid out by ``(src_block, dst_block)``, blocks of ``width`` ids: a tile of the
        adjacency matrix lies in one partition, ordered by tile."""
        block = lambda c: F.floor(F.col(c) / width).cast("long")
        tiled = self.edges.withColumns({"src_block": block("src"), "dst_block": block("dst")})
        return tiled.repartition("src_block", "dst_block").sortWithinPartitions("src_block", "dst_block", "src", "dst")

    def has_edge(self, pairs: DataFrame) -> DataFrame:
        """``pairs(src, dst)`` with ``found``."""
        own = self.edges.select("src", "dst").distinct().withColumn("__found", F.lit(True))
        return pairs.join(own, ["src", "dst"], "left").select(*pairs.columns, F.coalesce("__found", F.lit(False)).alias("found"))

    def summary(self) -> DataFrame:
        """One row: vertices, edges, vertices with and without out-edges, percent with."""
        d = self.degrees().agg(F.count("*").alias("n_vertices"), F.coalesce(F.sum("degree"), F.lit(0)).alias("n_edges"), F.count_if(F.col("degree") > 0).alias("n_non_empty"))
        return d.select("n_vertices", "n_edges", "n_non_empty", (F.col("n_vertices") - F.col("n_non_empty")).alias("n_empty"), F.round(F.try_divide(F.lit(100.0) * F.col("n_non_empty"), F.col("n_vertices")), 6).alias("pct_non_empty"))

    def offsets(self) -> DataFrame:
        """``(id, degree, offset)``: where a vertex's edges start in edge order."""
        return running_sum(self.degrees(), "id", F.col("degree"), "offset").select("id", "degree", F.col("offset").cast("long").alias("offset"))

    def page_ranges(self) -> DataFrame:
        """``(id, first_page, last_page)`` of vertices with edges: the pages that hold them."""
        o = self.offsets().where("degree > 0")
        page = lambda c: F.floor(c * EDGE_BYTES / PAGE_BYTES).cast("long")
        return o.select("id", page(F.col("offset")).alias("first_page"), page(F.col("offset") + F.col("degree") - 1).alias("last_page"))

    def page_vertices(self) -> DataFrame:
        """``(page, first_vertex, last_vertex)``: whose edges a page holds."""
        pages = self.page_ranges().select("id", F.explode(F.sequence("first_page", "last_page")).alias("page"))
        return pages.groupBy("page").agg(F.min("id").alias("first_vertex"), F.max("id").alias("last_vertex"))
