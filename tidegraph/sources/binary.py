"""Binary CSR files: ``.gr`` (versions 1 and 2), and index with striped pages.

Layouts (little-endian), fixed values:
  .gr     u64 version, u64 size of edge data, u64 n, u64 m; u64 end offset of
          each vertex's edges; m destinations (u32 in version 1, u64 in 2); in
          version 1 padded to an even count; edge data
  .index  u64 0, size of a weight, n, m; u64 edge offset of every 16th vertex; padded to 64
          bytes; u32 degree of each vertex, padded to a multiple of 16
  .adj    u32 destinations in edge order, each followed by its weight where there are
          weights, in pages of 4096 bytes dealt in turn to the files
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.graph import PAGE_BYTES, Graph
from tidegraph.sources import parquet
from tidegraph.store import delete, fresh_path, open_fs

HEADER = 32
GROUP = 16
ALIGN = 64
#: Vertices and edges that one task reads, about.
SPLIT_VERTICES, SPLIT_EDGES = 1 << 20, 1 << 23
#: Bytes that the driver copies at once.
COPY = 1 << 22
KINDS = {"i4": "int", "i8": "long", "f4": "float", "f8": "double"}


def _open(path: str):
    system, at = open_fs(path)
    return system.open_input_file(at)


def _create(path: str):
    system, at = open_fs(path)
    return system.open_output_stream(at, compression=None)


def _at(f, dtype: str, offset: int, count: int) -> np.ndarray:
    return np.frombuffer(f.read_at(count * np.dtype(dtype).itemsize, offset), dtype)


def _ranges(n: int, step: int) -> list[tuple[int, int]]:
    return [(a, min(a + step, n)) for a in range(0, n, step)]


def _scan(spark: SparkSession, ranges: list[tuple[int, int]], read, schema: str) -> DataFrame:
    """``read(lo, hi)`` yields record batches; a task reads one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from read(lo, hi)

    splits = spark.createDataFrame(ranges, "lo long, hi long").repartition(max(1, len(ranges)), "lo") if ranges else spark.createDataFrame([], "lo long, hi long")
    return splits.mapInArrow(run, schema)


def _edges(src: np.ndarray, dst: np.ndarray, data: np.ndarray | None = None) -> pa.RecordBatch:
    cols = [pa.array(src.astype("i8")), pa.array(dst.astype("i8"))]
    return pa.RecordBatch.from_arrays(cols + ([] if data is None else [pa.array(data)]), names=["src", "dst", "weight"][: 2 + (data is not None)])


def read_gr(spark: SparkSession, path: str, *, weight: str | None = None, first: int = 0, last: int | None = None, split: int = SPLIT_VERTICES) -> Graph:
    """A ``.gr`` file, or the vertices ``first`` to ``last`` (exclusive) of it with
    their edges. ``weight``: numpy type of the edge data, read as column ``weight``."""
    with _open(path) as f:
        version, size, n, m = map(int, _at(f, "<u8", 0, 4))
    if version not in (1, 2):
        raise ValueError(f"{path}: version {version} is neither 1 nor 2")
    width = 4 if version == 1 else 8
    data_at = HEADER + 8 * n + width * (m + m % 2 if version == 1 else m)
    if weight and size != np.dtype(weight).itemsize:
        raise ValueError(f"{path}: edge data of {size} bytes, not {weight}")
    last = n if last is None else last

    def read(lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            ends = _at(f, "<u8", HEADER + 8 * (lo - 1), hi - lo + 1) if lo else np.concatenate([[0], _at(f, "<u8", HEADER, hi)])
            ends = ends.astype("i8")
            for a in range(int(ends[0]), int(ends[-1]), SPLIT_EDGES):
                b = min(a + SPLIT_EDGES, int(ends[-1]))
                src = lo + np.searchsorted(ends, np.arange(a, b), side="right") - 1
                dst = _at(f, f"<u{width}", HEADER + 8 * n + width * a, b - a)
                yield _edges(src, dst, _at(f, f"<{np.dtype(weight).str[1:]}", data_at + size * a, b - a) if weight else None)

    schema = "src long, dst long" + (f", weight {KINDS[np.dtype(weight).str[1:]]}" if weight else "")
    ranges = [(a + first, b + first) for a, b in _ranges(last - first, split)]
    vertices = spark.range(first, last).select("id")
    return Graph(vertices, _scan(spark, ranges, read, schema))


def read_csr(spark: SparkSession, index: str, adj: list[str], *, weight: str | None = None, split: int = SPLIT_VERTICES) -> Graph:
    """An index file and its page files; ``weight``: numpy type of the weights, if there are any."""
    with _open(index) as f:
        _, size, n, m = map(int, _at(f, "<u8", 0, 4))
    if size != (np.dtype(weight).itemsize if weight else 0):
        raise ValueError(f"{index}: weights of {size} bytes, not {weight}")
    entry = np.dtype([("dst", "<u4")] + ([("weight", f"<{np.dtype(weight).str[1:]}")] if weight else []))
    groups = -(-n // GROUP)
    degrees_at = -(-(HEADER + 8 * groups) // ALIGN) * ALIGN
    split = -(-split // GROUP) * GROUP

    def read(lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        with _open(index) as f:
            start = int(_at(f, "<u8", HEADER + 8 * (lo // GROUP), 1)[0])
            degree = _at(f, "<u4", degrees_at + 4 * lo, hi - lo).astype("i8")
        ends = start + np.concatenate([[0], np.cumsum(degree)])
        files = [_open(p) for p in adj]
        for a in range(start, int(ends[-1]), SPLIT_EDGES):
            b = min(a + SPLIT_EDGES, int(ends[-1]))
            first, last = a * entry.itemsize // PAGE_BYTES, (b * entry.itemsize - 1) // PAGE_BYTES
            got = np.zeros((last - first + 1) * PAGE_BYTES, "u1")
            for i, f in enumerate(files):  # a file's pages lie one after another
                own = [p for p in range(first, last + 1) if p % len(files) == i]
                if own:
                    raw = np.frombuffer(f.read_at(len(own) * PAGE_BYTES, own[0] // len(files) * PAGE_BYTES), "u1")
                    for k, p in enumerate(own):
                        part = raw[k * PAGE_BYTES : (k + 1) * PAGE_BYTES]
                        got[(p - first) * PAGE_BYTES :][: len(part)] = part
            edges = np.frombuffer(got.tobytes(), entry, b - a, a * entry.itemsize - first * PAGE_BYTES)
            yield _edges(lo + np.searchsorted(ends, np.arange(a, b), side="right") - 1, edges["dst"], np.ascontiguousarray(edges["weight"]) if weight else None)
        for f in files:
            f.close()

    schema = "src long, dst long" + (f", weight {KINDS[np.dtype(weight).str[1:]]}" if weight else "")
    return Graph(spark.range(n).select("id"), _scan(spark, _ranges(n, split), read, schema))


def read_graph(spark: SparkSession, path: str, *, weight: str | None = None, partitions: int | None = None) -> Graph:
    """Reads what the name says: ``.gr``, ``.index`` (with the page files beside it), or Parquet edges.

    ``partitions``: about as many tasks read a binary file, and Parquet edges are dealt to so many by ``src``.
    """
    if path.endswith((".gr", ".index")):
        with _open(path) as f:
            n = int(_at(f, "<u8", 16, 1)[0])
        split = -(-n // partitions) if partitions else SPLIT_VERTICES
        if path.endswith(".gr"):
            return read_gr(spark, path, weight=weight, split=max(1, split))
        return read_csr(spark, path, page_files(path), weight=weight, split=max(1, split))
    g = parquet.read(spark, path)
    return Graph(g.vertices, g.edges.repartition(partitions, "src")) if partitions else g


def page_files(index: str) -> list[str]:
    """The page files that lie beside an index, in the order of their numbers."""
    prefix = index.removesuffix(".index")
    if "://" in prefix:
        from pyarrow import fs

        system, at = open_fs(prefix)
        folder = at.rpartition("/")[0]
        names = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.path.startswith(f"{at}.adj.")]
        names = [prefix[: len(prefix) - len(at)] + x for x in names]
    else:
        names = glob.glob(glob.escape(prefix) + ".adj.*")
    return sorted(names, key=lambda x: int(x.rpartition(".")[2]))


def _parts(df: DataFrame, dtypes: list[str], folder: str) -> list[list[str]]:
    """Executors write the columns of ``df``, whose partitions are in order, as arrays; returns
    each column's files in order. An attempt of a task has files of its own, and those of the attempts that count are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = open_fs(folder)
        system.create_dir(base, recursive=True)
        names = [f"{folder}/{context.partitionId():08d}-{context.taskAttemptId()}.{k}" for k in range(len(dtypes))]
        files = [_create(x) for x in names]
        for batch in batches:
            for f, column, dtype in zip(files, batch.columns, dtypes, strict=True):
                f.write(column.to_numpy(zero_copy_only=False).astype(dtype).tobytes())
        for f in files:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([names], pa.list_(pa.string()))], names=["part", "files"])

    rows = sorted(tuple(r) for r in df.mapInArrow(run, "part long, files array<string>").collect())  # one row for each partition
    return [[r[1][k] for r in rows] for k in range(len(dtypes))]


def _stream(files: list[str], unit: int) -> Iterator[bytes]:
    """The bytes of files one after another, in multiples of ``unit`` from each."""
    for name in files:
        with _open(name) as f:
            while data := f.read(COPY // unit * unit):
                yield data


def _packed(graph: Graph, *columns: str) -> DataFrame:
    """Edges in file order; partitions follow each other."""
    return graph.edges.select("src", "dst", *columns).repartitionByRange("src").sortWithinPartitions("src", "dst", *columns).select("dst", *columns)


def _written(graph: Graph, dtypes: list[str], folder: str) -> tuple[list[str], list[list[str]]]:
    """Files of degrees by id, and of each column of the edges."""
    degrees = graph.degrees().repartitionByRange("id").sortWithinPartitions("id").select("degree")
    (of_degrees,) = _parts(degrees, ["<u4"], f"{folder}/degrees")
    return of_degrees, _parts(_packed(graph, *["weight"][: len(dtypes) - 1]), dtypes, f"{folder}/edges")


def write_gr(graph: Graph, path: str, *, version: int = 1, weight: str | None = None) -> None:
    """Writes one file (a ``.gr`` file is one file). Executors write its parts as arrays; the
    driver copies their bytes, a few MB at a time. Ids have to be 0 to n - 1."""
    spark = graph.edges.sparkSession
    n, m = graph.vertices.count(), graph.edges.count()
    folder = fresh_path(spark, "gr-parts")
    width = 4 if version == 1 else 8
    degrees, columns = _written(graph, [f"<u{width}"] + ([f"<{np.dtype(weight).str[1:]}"] if weight else []), folder)
    with _create(path) as f:
        f.write(np.array([version, np.dtype(weight).itemsize if weight else 0, n, m], "<u8").tobytes())
        end = 0
        for data in _stream(degrees, 4):
            ends = end + np.cumsum(np.frombuffer(data, "<u4"), dtype="u8")
            end = int(ends[-1])
            f.write(ends.astype("<u8").tobytes())
        for data in _stream(columns[0], width):
            f.write(data)
        if version == 1 and m % 2:
            f.write(bytes(4))
        for data in _stream(columns[1], np.dtype(weight).itemsize) if weight else ():
            f.write(data)
    delete(spark, folder)


def write_csr(graph: Graph, prefix: str, *, disks: int = 1, weight: str | None = None) -> tuple[str, list[str]]:
    """Index and page files of a graph, with ``weight`` (a numpy type) after each destination;
    returns their paths. Written like ``write_gr``: no array as long as the graph is on the driver."""
    spark = graph.edges.sparkSession
    n, m = graph.vertices.count(), graph.edges.count()
    folder = fresh_path(spark, "csr-parts")
    types = ["<u4"] + ([f"<{np.dtype(weight).str[1:]}"] if weight else [])
    degrees, columns = _written(graph, types, folder)
    index, written = f"{prefix}.index", HEADER
    with _create(index) as f:
        f.write(np.array([0, np.dtype(weight).itemsize if weight else 0, n, m], "<u8").tobytes())
        end = at = 0
        for data in _stream(degrees, 4):
            d = np.frombuffer(data, "<u4")
            starts = end + np.concatenate([[0], np.cumsum(d, dtype="u8")])
            group = starts[:-1][-at % GROUP :: GROUP].astype("<u8").tobytes()
            f.write(group)
            written, end, at = written + len(group), int(starts[-1]), at + len(d)
        f.write(bytes(-written % ALIGN))
        for data in _stream(degrees, 4):
            f.write(data)
        f.write(bytes(4 * (-n % GROUP)))
    paths = [f"{prefix}.adj.{disks}.{i}" for i in range(disks)]
    outs = [_create(p) for p in paths]
    entry = np.dtype([(f"c{k}", t) for k, t in enumerate(types)])
    held, page = b"", 0
    streams = [_stream(c, np.dtype(t).itemsize) for c, t in zip(columns, types, strict=True)]
    waiting = [np.empty(0, t) for t in types]
    while True:
        for k, (s, t) in enumerate(zip(streams, types, strict=True)):
            if not len(waiting[k]):
                waiting[k] = np.frombuffer(next(s, b""), t)
        count = min(map(len, waiting))
        edges = np.empty(count, entry)
        for k in range(len(types)):
            edges[f"c{k}"], waiting[k] = waiting[k][:count], waiting[k][count:]
        held += edges.tobytes()
        whole = len(held) // PAGE_BYTES if count else -(-len(held) // PAGE_BYTES)
        for k in range(whole):
            outs[(page + k) % disks].write(held[k * PAGE_BYTES : (k + 1) * PAGE_BYTES].ljust(PAGE_BYTES, b"\0"))
        held, page = held[whole * PAGE_BYTES :], page + whole
        if not count:
            break
    for f in outs:
        f.close()
    delete(spark, folder)
    return index, paths


def convert(spark: SparkSession, gr: str, prefix: str, *, disks: int = 1, transpose: bool = False, weight: str | None = None) -> tuple[str, list[str]]:
    """``.gr`` to index and page files; ``weight``: with the edge data, of that numpy type."""
    g = read_gr(spark, gr, weight=weight)
    return write_csr(g.transposed() if transpose else g, prefix, disks=disks, weight=weight)


def file_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, bytes, pages)`` of page files."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path"), F.col("length").alias("bytes"))
    return files.withColumn("pages", F.ceil(F.col("bytes") / PAGE_BYTES))
