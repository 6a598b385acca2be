import gzip
import io
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import embedding_dedup, mixing, warc
from tidegraph.llm.embedding_dedup import near_duplicates
from tidegraph.llm.common import spread_join
from tidegraph.llm.components import connected_components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(1, 20)] + [(200, 201), (200, 201), (300, 300)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 51 for i in [*range(51, 70), 100]} | {200: 200, 201: 200}


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    big = spark.range(3000).select(F.when(F.col("id") < 1500, 7).when(F.col("id") < 1600, None).otherwise(F.col("id")).alias("k"), "id")
    small = big.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    hot = spread_join(big, small, "k", "n", "left")
    assert "Broadcast" in hot._jdf.queryExecution().toString()
    assert sorted(hot.select("k", "id", "low").collect(), key=str) == sorted(big.join(small, "k", "left").select("k", "id", "low").collect(), key=str)
    assert spread_join(big, small, "k", "n").count() == 2900
    star = [(1000, i) for i in range(1001, 1900)] + [(1500, 3), (5000, 5001)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: 3 for i in range(1000, 1900)} | {3: 3, 5000: 5000, 5001: 5000}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    x = np.vstack([base, base[:60] + rng.normal(size=(60, 16)) * 0.25, np.repeat(base[:2], 30, 0) + rng.normal(size=(60, 16)) * 0.1, base[5:8], 3 * base[9:10]]).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [1.0, None] + [0.0] * 14), (904, [1.0, 2.0]), (905, [math.inf] * 16), (906, [])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(link, low[None, :], len(x)).min(axis=1))
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), low[i], low[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cells_come_in_order():
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.random(7)), np.sort(rng.random(7))
    d = [x[2] for x in embedding_dedup.multi_sequence(a, b)]
    assert d == sorted(d) and len(d) == 49


def test_traversal_deals_out_all_cells_up_to_the_limit():
    rng = np.random.default_rng(3)
    index = embedding_dedup.MultiIndex((rng.normal(size=(9, 4)), rng.normal(size=(9, 4))), 1.5)
    x = rng.normal(size=(20, 8))
    for da, db, got in zip(*index.distances(x), index.visits(x), strict=True):
        total = da[:, None] + db[None, :]
        want = {(int(i), int(j)) for i, j in np.argwhere(total <= total.min() + index.margin)}
        order = [total[i, j] for i, j in got]
        assert set(got) == want and len(got) == len(want) > 1 and order == sorted(order)


def links_of(x, least=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= least
    np.fill_diagonal(s, False)
    return s


def test_recall_on_planted_links(spark):
    # Partners at a cosine just above the least, the hardest to find, in a grid of 90 by 90 cells.
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2900, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    q = base[:400]
    r = rng.normal(size=q.shape)
    r -= (r * q).sum(axis=1, keepdims=True) * q
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    near = 0.902 * q + np.sqrt(1 - 0.902**2) * r
    x = np.vstack([base, near]).astype("f4").astype("f8")
    want = links_of(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = np.array([r["n_links"] for r in sorted(near_duplicates(df).collect(), key=lambda r: r["vec_id"])])
    index = embedding_dedup.fit_index(df.select(F.col("vec_id").alias("rid"), F.col("embedding").alias("v")), 64, 0.9)
    assert index.k >= 90 and index.recall >= embedding_dedup.TARGET
    assert (got <= want.sum(axis=1)).all() and got.sum() >= 0.95 * want.sum()
    # The traversal is what saves the work: a vector visits a small part of the grid.
    assert np.mean([len(v) for v in index.visits(x[:200])]) < 0.03 * index.k**2


def test_a_crowd_is_counted_exactly(spark, monkeypatch):
    # Each found pair counts once for both of its vectors, whoever visits whom, and in parts of a crowded cell.
    monkeypatch.setattr(embedding_dedup, "HOMES", 50)
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=16) + 0.05 * rng.normal(size=(400, 16)), rng.normal(size=(300, 16))])
    x = np.vstack([x, x[:30]])
    want = links_of(x)
    df = spark.createDataFrame([(i, (1e200 * v).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_duplicates(df).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n[:400] == want[:400].sum(axis=1)).all() and n.sum() >= 0.98 * want.sum()
    assert {got[i]["component_id"] for i in [*range(400), *range(700, 730)]} == {0}


def test_double_vectors_are_not_rounded(spark):
    a, b = 0.9, (1 - 0.81) ** 0.5
    rows = [(1, [1.0, 0.0]), (2, [a - 1e-9, b]), (3, [a + 1e-9, -b]), (4, [1e-300, 1e-290]), (5, [0.0, 1e250])]
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1}


def test_mixing_is_its_sql(spark):
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = mixing.op6_poisson_mixing(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(db.sql(mixing.oracle()).fetchall())


def test_mixing_gives_whole_documents(spark, monkeypatch):
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = mixing.op6_poisson_mixing_documents(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert sorted(map(tuple, got.collect())) == sorted(db.sql(mixing.oracle_documents()).fetchall())
    # The keys are those of mixed documents: texts are shuffled and written too.
    written = []
    monkeypatch.setattr(mixing, "materialize", lambda df, name: written.append(df.columns) or df)
    mixing.op6_poisson_mixing(spark, "/root/testdata/sf0.001")
    assert written == [got.columns]


def test_mixing_weights(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "a").otherwise(None).alias("source"), F.lit("t").alias("rate"))
    n = {r["source"]: r["count"] for r in mixing.mix(docs, weights={"a": 1.0, None: 3.0}).groupBy("source").count().collect()}
    assert abs(n["a"] - 5000) < 300 and abs(n[None] - 15000) < 700
    assert mixing.mix(docs).columns == docs.columns
    # A mean of 20 is the sum of two draws; its variance is its mean.
    c = mixing.mix(docs, weights={"a": 1.0}, total=360_000.0).groupBy("doc_id").count().agg(F.avg("count"), F.variance("count")).first()
    assert c[0] == pytest.approx(20, rel=0.02) and c[1] == pytest.approx(20, rel=0.06)
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = docs.limit(50).withColumns({c: F.lit(c) for c in ("s", "row", "copy", "draws", "cdf", "times", "place", "n", "w")})
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash, copy_column="number").where("copy = 'copy' and number >= 0").count() > 0


def test_warc_rows(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, " ", None), (4, "u", ""), (5, "u", "é" * 70000), (None, "n", "only"), (7, "x", "WARC/1.1\r\n\r\n")]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 7
    for i, _, h in rows:
        p = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(p), warc.digest32(p))
    assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2) and (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 4)
    assert all(got[i]["record_type"] == "response" and got[i]["refers_to"] is None for i in (2, 4, 5, None, 7))
    again = warc.round_trip(spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in again) == [(1, "revisit", 2), (2, "response", 0), (2, "response", 0)]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_payload_that_most_pages_have(spark):
    rows = [(i, "u", "same") for i in range(400)] + [(1000 + i, "u", f"p{i % 150}") for i in range(200)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("revisit", 399) for i in range(399)} | {399: ("response", None)} | {1000 + i: ("revisit", 1150 + i) if i < 50 else ("response", None) for i in range(200)}


def test_normaliser():
    records = [warc.page_record(i, "u", bytes([i]) * (i * 50_000), "D", None) for i in range(1, 6)]
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), out)
    raw = out.getvalue()
    assert [gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]]) for x in index] == records
    assert gzip.decompress(raw) == b"".join(records)
    again = io.BytesIO()
    assert warc.normalise(io.BytesIO(raw), again) == index and again.getvalue() == raw
    with pytest.raises(EOFError):
        warc.normalise(io.BytesIO(gzip.compress(b"".join(records))[:-20]), io.BytesIO())
