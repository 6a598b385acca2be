"""Binary graph files: what is written is read."""

import numpy as np
import pytest

from tidegraph.fixtures import T0, tiny
from tidegraph.graph import Graph
from tidegraph.sources.binary import convert, file_pages, read_csr, read_gr, read_graph, write_csr, write_gr
from tidegraph.store import fresh_path, materialize, open_fs, release, shared_dir


def rows(g):
    return sorted(map(tuple, g.edges.collect())), sorted(r[0] for r in g.vertices.collect())


@pytest.mark.parametrize("version", [1, 2])
def test_gr(spark, tmp_path, version):
    g, path = tiny(spark, *T0), str(tmp_path / "t.gr")
    write_gr(g, path, version=version)
    assert rows(read_gr(spark, path)) == rows(g)
    assert rows(read_gr(spark, path, split=3)) == rows(g)
    assert sorted(map(tuple, read_gr(spark, path, first=1, last=4).edges.collect())) == sorted(e for e in T0[1] if 1 <= e[0] < 4)


def test_gr_weights(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 5), (2, 0, 7), (0, 1, 4)], "src long, dst long, weight int")
    g, path = Graph(spark.range(3), edges), str(tmp_path / "w.gr")
    write_gr(g, path, weight="i4")
    assert sorted(map(tuple, read_gr(spark, path, weight="i4").edges.collect())) == [(0, 1, 4), (0, 1, 5), (2, 0, 7)]


@pytest.mark.parametrize("disks", [1, 2])
def test_csr(spark, tmp_path, disks):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 50, (3000, 2))]
    g = tiny(spark, 50, edges)
    index, adj = write_csr(g, str(tmp_path / "g"), disks=disks)
    assert rows(read_csr(spark, index, adj)) == rows(g)
    assert rows(read_csr(spark, index, adj, split=16)) == rows(g)


def test_convert_with_weights(spark, tmp_path):
    rng = np.random.default_rng(5)
    edges = sorted((int(a), int(b), int(w)) for a, b, w in rng.integers(0, 40, (2500, 3)))
    g = Graph(spark.range(41), spark.createDataFrame(edges, "src long, dst long, weight int"))
    gr = f"file://{tmp_path}/w.gr"
    write_gr(g, gr, weight="i4")
    index, adj = convert(spark, gr, f"file://{tmp_path}/w", disks=2, weight="i4")
    assert sorted(map(tuple, read_csr(spark, index, adj, weight="i4").edges.collect())) == edges
    back = convert(spark, gr, f"{tmp_path}/t", transpose=True, weight="i4")
    assert sorted((b, a, w) for a, b, w in read_csr(spark, *back, weight="i4").edges.collect()) == edges
    with pytest.raises(ValueError):
        read_csr(spark, index, adj)
    sizes = {r["path"].rpartition(".")[2]: r["pages"] for r in file_pages(spark, f"{tmp_path}/w.adj.2.*").collect()}
    assert sizes == {"0": 3, "1": 2}  # 2500 edges of 8 bytes


def test_read_graph_by_name(spark, tmp_path):
    g = tiny(spark, *T0)
    write_gr(g, str(tmp_path / "t.gr"))
    write_csr(g, str(tmp_path / "t"), disks=2)
    g.edges.write.parquet(str(tmp_path / "edges"))
    for name in ("t.gr", "t.index"):
        assert rows(read_graph(spark, str(tmp_path / name), partitions=3)) == rows(g)
    assert rows(read_graph(spark, f"file://{tmp_path}/t.index")) == rows(g)
    got = read_graph(spark, str(tmp_path / "edges"), partitions=3)
    assert sorted(map(tuple, got.edges.collect())) == rows(g)[0] and got.edges.rdd.getNumPartitions() == 3


def test_store(spark, tmp_path):
    import os

    df = materialize(spark.range(5), "five")
    path = df._written.removeprefix("file://")
    assert os.path.isdir(path)
    release(df, spark.range(3))
    assert not os.path.exists(path)
    assert fresh_path(spark, "x").startswith(shared_dir(spark))
    for name in ("/a/b", "file:/a/b", "file:///a/b"):
        assert open_fs(name)[1] == "/a/b"
    assert open_fs("dbfs:/a/b")[1] == "/dbfs/a/b"

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_dir(Cluster)
