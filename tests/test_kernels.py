"""Kernels on the golden graphs."""

import pytest
from pyspark.sql import functions as F

from tidegraph.fixtures import T0, T1, T2, T3, tiny
from tidegraph.graph import running_sum
from tidegraph.operators import transforms
from tidegraph.plans.bc import betweenness
from tidegraph.plans.bfs import bfs
from tidegraph.plans.kcore import kcore
from tidegraph.plans.pagerank import pagerank
from tidegraph.plans.spmv import spmv
from tidegraph.plans.wcc import component_summary, wcc


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.fixture(scope="module")
def t0(spark):
    return tiny(spark, *T0).settled()


def test_degrees(t0):
    assert column(t0.degrees(), "degree") == [3, 2, 2, 2, 1, 0, 1, 0, 1, 0]
    assert column(t0.degrees("in"), "degree") == [0, 2, 3, 3, 1, 2, 0, 1, 0, 0]


def test_bfs(t0):
    got = {r["id"]: (r["depth"], r["parent"]) for r in bfs(t0, 0).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (1, 0), 3: (2, 1), 4: (3, 3), 5: (4, 4)}
    assert [tuple(r) for r in bfs(t0, 9).collect()] == [(9, 0, 9)]


def test_wcc(t0, spark):
    labels = wcc(t0)
    assert column(labels, "label") == [0, 0, 0, 0, 0, 0, 6, 6, 0, 9]
    s = component_summary(labels).first()
    assert (s["n_components"], s["n_nontrivial"], s["largest"], s["largest_size"]) == (3, 2, 0, 7)
    assert column(wcc(tiny(spark, *T3)), "label") == [0, 1, 2, 1, 2, 2]


def test_spmv(t0):
    assert column(spmv(t0, rounds=1), "value") == [0, 4, 6, 6, 2, 4, 0, 2, 0, 0]
    assert column(spmv(t0, rounds=3), "value") == [0, 44, 46, 174, 90, 36, 0, 2, 0, 0]


def test_pagerank(t0):
    two = [0.015, 0.0677708, 0.0599792, 0.1605625, 0.0755625, 0.076625, 0.015, 0.02775, 0.015, 0.015]
    assert column(pagerank(t0, max_rounds=2), "score") == pytest.approx(two, abs=1e-6)
    end = [0.015, 0.0359782, 0.0393605, 0.0825078, 0.0504888, 0.0706654, 0.015, 0.02775, 0.015, 0.015]
    assert column(pagerank(t0), "score") == pytest.approx(end, abs=1e-6)


def test_betweenness(t0, spark):
    b = betweenness(t0, 0)
    assert column(b, "sigma") == [1, 1, 2, 3, 3, 3, 0, 0, 0, 0]
    assert column(b, "dependency")[:6] == pytest.approx([5, 1, 2, 2, 1, 0]) and column(b, "dependency")[6:] == [None] * 4
    assert column(betweenness(tiny(spark, *T1), 0), "dependency") == pytest.approx([3, 1, 0, 0])


def test_kcore(t0, spark):
    assert column(kcore(t0), "core") == [3, 3, 3, 3, 1, 1, 1, 1, 1, 0]
    assert column(kcore(tiny(spark, *T2)), "core") == [1] * 7


def test_no_edges(spark):
    g = tiny(spark, 3, [(0, 0)])
    empty = type(g)(g.vertices, g.edges.where("false"))
    assert column(wcc(empty), "label") == [0, 1, 2]
    assert column(kcore(empty), "core") == [0, 0, 0]
    assert bfs(empty, 1).count() == 1
    assert column(spmv(empty, rounds=2), "value") == [0, 0, 0]


def test_running_sum_over_blocks(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    got = column(running_sum(df, "id", F.col("v"), "s", block=8), "s")
    assert got == [sum(i % 7 for i in range(k)) for k in range(100)]


def test_running_sum_of_sparse_ids(spark):
    ids = sorted({(i * 7_919_777_777_777) % (1 << 50) - (1 << 49) for i in range(1, 401)})
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = running_sum(df, "id", F.lit(1), "s", block=16)
    assert [r["s"] for r in got.orderBy("id").collect()] == list(range(len(ids)))


def test_a_long_path(spark):
    # More levels than tables are kept apart, forward and backward.
    g = tiny(spark, 31, [(i, i + 1) for i in range(30)]).settled()
    assert column(bfs(g, 0), "depth") == list(range(31))
    assert column(betweenness(g, 0), "dependency") == pytest.approx([30.0 - i for i in range(31)])


def test_nearest_point_is_never_too_far(spark):
    places = [(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 4.0), (4, 5000.0, -7000.0), (5, float("nan"), 0.0), (6, None, 1.0), (7, float("inf"), 0.0)]
    asked = [(10, 0.4, 0.1), (11, 2000.0, 0.0), (12, 4000.0, -6000.0), (13, -90000.0, 90000.0), (14, None, 1.0), (15, 3.0, 5.0)]
    points, queries = spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(asked, "qid long, qx double, qy double")
    got = {r["qid"]: (r["id"], r["distance"]) for r in transforms.nearest_point(points, queries, cell=1.0).collect()}
    assert len(got) == 6 and got.pop(14) == (None, None)
    for q, x, y in asked[:4] + asked[5:]:
        d, i = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, i) for i, a, b in places[:4])
        assert got[q] == (i, pytest.approx(d))
    near = {r["qid"]: r["id"] for r in transforms.nearest_point(points, queries, cell=1.0, within=3.0).collect()}
    assert near == {10: 1, 11: None, 12: None, 13: None, 14: None, 15: 2}
    assert {r["id"] for r in transforms.nearest_point(points.where("false"), queries, cell=1.0).collect()} == {None}
