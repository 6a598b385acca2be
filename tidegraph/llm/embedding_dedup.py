"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut in halves, each half with a codebook of its own; pairs of
codewords are the cells of a product grid, and every vector lies in one. A
multi-sequence traversal deals out the cells nearest to a vector, in rising
distance, until the target recall is reached, and cosines in double
precision verify what the vector meets there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidegraph.llm.common import materialize, spread_join
from tidegraph.llm.components import connected_components
from tidegraph.llm.simhash import Forest

#: Share of the links that the traversal is to find: fitted on one half of the probes, held against the other.
TARGET = 0.98
#: Vectors that codebooks are fitted on, at most (about), and those for each codeword, at least.
SAMPLE, PER_CODEWORD = 16_384, 16
#: Queries of the sample that are compared with all vectors, to fit the stop to links that occur.
PROBES = 256
#: Steps of squared distance in which the stop is fitted.
STEPS = np.linspace(0, 2, 401)
#: Vectors that one task compares queries with, about.
HOMES = 4096
BLOCK = 512


def codewords(n: int, sample: int = SAMPLE) -> int:
    """Codewords of a half for ``n`` vectors: 32 vectors for each, up to 256 of them, then
    the root of n, as far as the sample can fit them."""
    return int(max(4, min(n // 32, max(256, np.sqrt(n)), sample // PER_CODEWORD)))


def multi_sequence(da: np.ndarray, db: np.ndarray, limit: float = np.inf) -> Iterator[tuple[int, int, float]]:
    """Cells of a product grid in rising order of the sum of two sorted distances, up to ``limit``."""
    if not len(da) or not len(db) or da[0] + db[0] > limit:
        return
    heap, seen = [(float(da[0] + db[0]), 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        yield i, j, d
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(da) and v < len(db) and (u, v) not in seen:
                seen.add((u, v))
                d = float(da[u] + db[v])
                if d <= limit:
                    heapq.heappush(heap, (d, u, v))


@dataclass
class MultiIndex:
    """Two codebooks, and where the traversal stops: at cells that are farther than the
    nearest one by more than ``margin`` (squared). ``recall``: what that finds of held-out links."""

    books: tuple[np.ndarray, np.ndarray]
    margin: float
    recall: float = 1.0

    @property
    def k(self) -> int:
        return max(len(self.books[0]), len(self.books[1]))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its codewords."""
        h = len(self.books[0][0])
        return tuple(np.maximum(((part**2).sum(axis=1)[:, None] - 2 * part @ b.T + (b**2).sum(axis=1)), 0) for part, b in ((x[:, :h], self.books[0]), (x[:, h:], self.books[1])))  # type: ignore[return-value]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(axis=1), b.argmin(axis=1)

    def visits(self, x: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """Of each vector, the cells that the traversal deals out up to its stop, nearest first."""
        for da, db in zip(*self.distances(x), strict=True):
            limit = da.min() + db.min() + self.margin
            a, b = np.flatnonzero(da + db.min() <= limit), np.flatnonzero(db + da.min() <= limit)
            a, b = a[np.argsort(da[a], kind="stable")], b[np.argsort(db[b], kind="stable")]
            yield [(int(a[i]), int(b[j])) for i, j, _ in multi_sequence(da[a], db[b], limit)]


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)
        for c in np.unique(near):
            centers[c] = x[near == c].mean(axis=0)
    return centers


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column as unit vectors in double precision, whatever their size."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def gaps(index: MultiIndex, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least margin at which either of each pair visits the other's cell."""
    out = []
    at = np.arange(len(q))
    for one, other in ((q, y), (y, q)):
        a, b = index.distances(one)
        i, j = index.home(other)
        out.append(a[at, i] + b[at, j] - a.min(axis=1) - b.min(axis=1))
    return np.minimum(*out)


def fit_index(reps: DataFrame, dim: int, least: float, *, sample: int = SAMPLE, probes: int = PROBES, target: float = TARGET, seed: int = 5) -> MultiIndex:
    """``reps(rid, v)`` -> codebooks and stop, fitted on at most about ``sample`` vectors.

    The stop is the least margin that finds ``target`` of two kinds of links on average: of
    4096 vectors with a partner at exactly the least cosine in a random direction, the
    hardest there are, and of ``probes`` vectors with all that occur, by brute force against
    all vectors. Every other vector is held out; where the stop falls short of the target on
    those, it is widened until they reach it too.
    """
    n = reps.count()
    u = F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1_000_000))
    picked = reps.where(u < int(min(1.0, sample / max(n, 1)) * 1_000_000) + 1).select("v").orderBy("rid").collect()
    picked = picked or reps.select("v").orderBy("rid").limit(100).collect()
    x = unit(pa.array([r[0] for r in picked], pa.list_(pa.float64())), dim)
    k, half = codewords(min(n, len(x) * 64), sample), dim // 2
    index = MultiIndex((k_means(x[:, :half], k), k_means(x[:, half:], k)), 0.0)

    rng = np.random.default_rng(seed)
    q = x[rng.integers(0, len(x), 4096)]
    r = rng.standard_normal(q.shape)
    r -= (r * q).sum(axis=1, keepdims=True) * q
    r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    hard = gaps(index, q, least * q + np.sqrt(1 - least**2) * r)
    asked = x[rng.permutation(len(x))[:probes]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(asked), len(STEPS) + 1), "i8")
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                y = unit(batch.column(0).slice(at, 4 * BLOCK), dim)
                s = asked @ y.T
                i, j = np.nonzero((s >= least) & (s < 1 - 1e-12))
                if len(i):
                    np.add.at(count, (i, np.searchsorted(STEPS, gaps(index, asked[i], y[j]))), 1)
        i, j = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(count[i, j])], names=["probe", "step", "n"])

    seen = reps.select("v").mapInArrow(run, "probe long, step long, n long").groupBy("probe", "step").agg(F.sum("n")).collect()  # probes x steps at most
    found = np.zeros((len(asked), len(STEPS) + 1))
    for i, j, c in seen:
        found[i, j] = c
    found = found[found.sum(axis=1) > 0]

    def curve(held: int) -> list[np.ndarray]:
        """Recall at each step, by kind of link."""
        kinds = [np.searchsorted(np.sort(hard[held::2]), STEPS, side="right") / len(hard[held::2])]
        own = found[held::2]
        return kinds + ([(np.cumsum(own, axis=1) / own.sum(axis=1, keepdims=True)).mean(axis=0)[: len(STEPS)]] if len(own) else [])

    reach = [np.flatnonzero(c >= target) for half_of in (0, 1) for c in curve(half_of)]
    stop = max(int(r[0]) if len(r) else len(STEPS) - 1 for r in reach)
    index.margin, index.recall = float(STEPS[stop]) + 1e-9, float(min(c[stop] for c in curve(1)))
    return index


def _linked(reps: DataFrame, dim: int, least: float) -> DataFrame:
    """Distinct vectors ``reps(rid, v, n)`` -> ``(kind, a, b)``: of kind 0, rid and vectors
    linked (in part); of kind 1, links that keep the components.

    A pair counts for both of its vectors wherever one of them visits the other: a
    visitor counts for itself, and for the vector at home only if that doesn't come to the visitor's cell.
    """
    spark = reps.sparkSession
    index = fit_index(reps, dim, least)
    total = reps.count()
    side = len(index.books[1])
    parts = int(np.clip(np.ceil(total / index.k / HOMES), 1, side))  # of each first codeword's cells
    width = -(-side // parts)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = unit(part.column(1), dim)
                home = [i * side + j for i, j in zip(*(h.tolist() for h in index.home(x)), strict=True)]
                groups, kinds, own, cells = [], [], [], []
                for row, found in enumerate(index.visits(x)):
                    by: dict[int, list[int]] = {}
                    for i, j in found:
                        by.setdefault(i * parts + j // width, []).append(i * side + j)
                    groups += [home[row] // side * parts + home[row] % side // width, *by]
                    kinds += [0] + [1] * len(by)
                    own += [row] * (1 + len(by))
                    cells += [[i * side + j for i, j in found], *by.values()]
                take = pa.array(own, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(kinds, pa.int32()), *(part.column(c).take(take) for c in range(3)), pa.array(home, pa.int32()).take(take), pa.array(cells, pa.list_(pa.int32()))], names=names)

    schema = f"grp int, kind int, rid long, v {reps.schema['v'].dataType.simpleString()}, n long, home int, cells array<int>"
    names = ["grp", "kind", "rid", "v", "n", "home", "cells"]
    met = reps.select("rid", "v", "n").mapInArrow(placed, schema)
    # A crowded part of the grid is dealt to several tasks, and its visitors go to each.
    homes = reps.select("rid", "v", "n").mapInArrow(_homes_only(index, dim, parts, width), "grp int")
    heavy = homes.groupBy("grp").agg(F.count("*").alias("c")).where(F.col("c") > 2 * HOMES).select(F.col("grp").alias("g"), F.ceil(F.col("c") / HOMES).cast("int").alias("ways"))
    # As many rows as the grid has parts, at most: a million of two numbers at 1024 codewords.
    met = met.join(F.broadcast(heavy), F.col("grp") == F.col("g"), "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
    own_way = F.array(F.pmod(F.xxhash64("rid"), F.col("ways")).cast("int"))
    met = met.withColumn("way", F.explode(F.when(F.col("kind") == 0, own_way).otherwise(F.sequence(F.lit(0), F.col("ways") - 1)))).select("grp", "way", *names[1:])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, queries, waiting = None, [], [], 0
        homes: Homes | None = None

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal queries, waiting
            if homes and queries:
                yield homes.answer(pa.Table.from_batches(queries).combine_chunks(), dim, least)
            queries, waiting = [], 0

        for batch in batches:
            g, w, kinds = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(g)], strict=True):
                lo, hi = int(lo), int(hi)
                if (g[lo], w[lo]) != key:
                    yield from answered()
                    if homes:
                        yield homes.others()
                    key, held, homes = (g[lo], w[lo]), [], None
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    held.append(part)
                    continue
                if homes is None and held:
                    homes = Homes(pa.Table.from_batches(held).combine_chunks(), dim, side)
                for at in range(0, part.num_rows if homes else 0, BLOCK):
                    queries.append(part.slice(at, BLOCK))
                    waiting += queries[-1].num_rows
                    if waiting >= BLOCK:
                        yield from answered()
        yield from answered()
        if homes:
            yield homes.others()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "grp", "way").sortWithinPartitions("grp", "way", "kind").mapInArrow(compare, "kind int, a long, b long")


def _homes_only(index: MultiIndex, dim: int, parts: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = index.home(unit(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([pa.array(i * parts + j // width, pa.int32())], names=["grp"])

    return run


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all entries of an array column."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()


def _found(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


class Homes:
    """The vectors of one part of the grid, where they go themselves, and what links have joined so far."""

    def __init__(self, t: pa.Table, dim: int, side: int):
        self.rid, self.n, home = (t[c].to_numpy() for c in ("rid", "n", "home"))
        self.x = unit(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], dim)
        own, cells = _flat(t["cells"])
        self.span = int(max(cells.max(), home.max())) + 1
        self.goes = np.sort(own.astype("i8") * self.span + cells)
        self.cells, self.at = np.unique(home, return_inverse=True)
        self.forest = Forest(len(self.rid))
        self.more = np.zeros(len(self.rid), "i8")

    def answer(self, t: pa.Table, dim: int, least: float) -> pa.RecordBatch:
        rid, n, home = (t[c].to_numpy() for c in ("rid", "n", "home"))
        x = unit(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], dim)
        row, cell = _flat(t["cells"])
        place = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        visited = np.zeros((len(rid), len(self.cells)), bool)
        there = self.cells[place] == cell
        visited[row[there], place[there]] = True
        hit = ((x @ self.x.T) >= least) & visited[:, self.at] & (rid[:, None] != self.rid[None, :])
        q, h = np.nonzero(hit)
        if not len(q):
            return _found(*([[]] * 3))
        counts = np.bincount(q, self.n[h], len(rid)).astype("i8")
        # Those at home that don't visit the visitor's cell learn of the link here.
        known = home[q] < self.span
        code = h.astype("i8") * self.span + np.where(known, home[q], 0)
        spot = np.minimum(np.searchsorted(self.goes, code), len(self.goes) - 1)
        back = known & (self.goes[spot] == code)
        self.more += np.bincount(h[~back], n[q[~back]], len(self.rid)).astype("i8")
        some = np.flatnonzero(counts)
        a, b = [], []
        up = np.array(self.forest.up)
        for r, hits in zip(some, np.split(h, np.flatnonzero(np.diff(q)) + 1), strict=True):
            roots: dict[int, int] = {}
            for i in hits[np.unique(up[hits], return_index=True)[1]]:
                roots.setdefault(self.forest.root(int(i)), int(i))
            first, *others = roots
            a += [rid[r]] * len(roots)
            b += [self.rid[i] for i in roots.values()]
            for o in others:
                self.forest.up[o] = first
        return _found(np.repeat([0, 1], [len(some), len(a)]), np.concatenate([rid[some], np.array(a, "i8")]), np.concatenate([counts[some], np.array(b, "i8")]))

    def others(self) -> pa.RecordBatch:
        """What the vectors at home have learnt of visitors that they don't visit."""
        some = np.flatnonzero(self.more)
        return _found(np.zeros(len(some)), self.rid[some], self.more[some])


def near_duplicates(vectors: DataFrame, *, least: float = 0.9) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, a row per row.

    Vectors link at a cosine of at least ``least``; ``n_links`` counts the other
    rows that a row links to. Null or zero vectors and those with null or
    non-finite components link with nothing, and vectors of different lengths
    don't link. Equal vectors are compared once. ``kept`` marks rows whose id
    is the smallest of their component. A null vec_id is larger than all others
    and its component_id is its component's smallest id, null if it has none.
    Other columns are ignored.
    """
    # Floats stay floats, half as large to move; all else is compared as doubles.
    kind = vectors.schema["embedding"].dataType
    v = F.col("embedding").cast("array<float>" if kind == ArrayType(FloatType(), kind.containsNull) else "array<double>")
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    grouped = rows.where("sound").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    reps = materialize(grouped.withColumns({"rid": F.monotonically_increasing_id(), "size": F.size("v")}), "vectors")
    parts = []
    for r in reps.groupBy("size").count().orderBy("size").collect():  # a row for each length of a vector
        if r["size"] >= 2:
            parts.append(_linked(reps.where(F.col("size") == r["size"]), r["size"], least))
    if any(True for _ in reps.where("size = 1").take(1)):  # on a line, vectors of one sign link
        ones = reps.where("size = 1").withColumn("sign", F.signum(F.col("v")[0]))
        tops = ones.groupBy("sign").agg(F.min("rid").alias("b"), F.sum("n").alias("all"))
        ones = ones.join(tops, "sign")
        parts += [ones.select(F.lit(0).alias("kind"), F.col("rid").alias("a"), (F.col("all") - F.col("n")).alias("b")), ones.where("rid <> b").select(F.lit(1).alias("kind"), F.col("rid").alias("a"), "b")]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out, "vector-links")
    counts = out.where("kind = 0").groupBy(F.col("a").alias("rid")).agg(F.sum("b").alias("links"))
    rooted = connected_components(out.where("kind = 1").select("a", "b"))
    rooted = materialize(rooted.withColumnRenamed("id", "rid"), "vector-roots")
    linked = materialize(reps.select("rid", "low").join(rooted, "rid"), "linked-vectors")
    least_id = materialize(linked.groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("m")), "least-ids")
    known = spread_join(linked.select("rid", "root"), least_id, "root", "m").select("rid", "least")
    of = reps.join(known, "rid", "left").join(counts, "rid", "left")
    # A component of rows without ids has no id, so a row without a class is told by ``known``.
    of = of.select("v", "n", F.col("rid").isNotNull().alias("known"), F.least("least", "low").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    joined = spread_join(rows.withColumn("v", F.when(F.col("sound"), F.col("v"))), materialize(of, "vector-classes"), "v", "n", "left")
    component = F.when(F.col("known").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
