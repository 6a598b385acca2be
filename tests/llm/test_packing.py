import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegraph.llm import packing
from tidegraph.llm.packing import WordEncoder, pack_documents, place, sum_of_squares, tokenize_pieces, tokenizer_path

TEXTS = ["", None, "a b", "Don't STOP 'll", "Σας Σ ç", "x <|endoftext|> y", "1 234.5!!", "w\x0bq\x1fz\x85w", "ok " * 5000]


def test_ids_are_the_tokenizers():
    t, e = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path(), limit=300)
    rng = random.Random(6)
    signs = list("aBcé Éß×÷Üñ0123 \n\t.,!?'s't-_<|>&\u0301\u00a0“”中文²½İΣς") + ["'re", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "\x7f", " the", "ing "]
    texts = [x or "" for x in TEXTS] + ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:300]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        ids, n = e.encode(pa.array(["skipped", *some], pa.string()).slice(1))
        assert n.sum() == len(ids)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_another_tokenizer(tmp_path):
    # Chunks go to a tokenizer whose rules aren't known whole.
    told = json.load(open(tokenizer_path()))
    told["normalizer"]["normalizers"].pop()
    path = tmp_path / "t.json"
    path.write_text(json.dumps(told))
    t, e = Tokenizer.from_file(str(path)), WordEncoder(str(path))
    ids, _ = e.encode(pa.array(["It's An12 ÉA b", " X\n"]))
    assert ids.tolist() == t.encode("It's An12 ÉA b X", add_special_tokens=False).ids


def test_pack(spark):
    docs = spark.createDataFrame([(i, x, "s") for i, x in enumerate(TEXTS)] + [(None, "null id", "s"), (2, "a b", "s")], "doc_id long, text string, length string")
    got = pack_documents(docs).collect()
    t = Tokenizer.from_file(tokenizer_path())
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for i, x in enumerate(TEXTS):
        if i == 2:
            continue
        ids = [y for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"]) for y in r["ids"]]
        assert ids == t.encode(x or "", add_special_tokens=False).ids + [0]
    assert sum(r["doc_id"] == 2 for r in got) == 2
    assert len(by) == -(-sum(r["length"] for r in got) // 2048)
    assert pack_documents(docs.limit(0)).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 3000)
    bins, offsets = sum_of_squares(lengths, 2048)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 2048 and bins.max() + 1 <= 1.02 * lengths.sum() / 2048 + 1


def squares(gaps):
    counts = Counter(g for g in gaps if g)
    return sum(n * n for n in counts.values())


def test_rule():
    assert sum_of_squares(np.array([5, 3, 3, 2]), 10)[0].tolist() == [0, 0, 1, 0]
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths, capacity = rng.integers(1, 31, 60), 30
        bins, offsets = sum_of_squares(lengths, capacity)
        gaps = []
        for i in np.argsort(-lengths, kind="stable"):
            s = int(lengths[i])
            ways = {b: squares(gaps[:b] + [g - s] + gaps[b + 1 :]) for b, g in enumerate(gaps) if g >= s}
            if not ways:
                assert bins[i] == len(gaps) and offsets[i] == 0
                gaps.append(capacity - s)
            else:
                assert ways[bins[i]] == min(ways.values()) and offsets[i] == capacity - gaps[bins[i]]
                gaps[bins[i]] -= s


def test_equal_rows_are_spread(spark):
    # Rows that are wholly alike have places of their own, and shards stay near their size.
    pieces = spark.range(0, 4001, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1000).cast("long").alias("length"))
    rows = place(pieces, shard_pieces=200).collect()
    assert len(rows) == 4001 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4001
    assert 2001 <= len({r["sequence_id"] for r in rows}) <= 2011
    shards = Counter(r["sequence_id"] >> 24 for r in rows)
    assert len(shards) == 21 and max(shards.values()) < 400


def test_shards_lose_no_sequence(spark):
    # Six shards: 0.2 % more sequences at most than in one packing of all, which has the least or one more.
    rng = np.random.default_rng(7)
    lengths = np.concatenate([rng.integers(1, 2049, 4000), rng.integers(1, 300, 2000)])
    pieces = spark.createDataFrame([(int(x),) for x in lengths], "length long")
    rows = place(pieces, shard_pieces=1000).collect()
    one = sum_of_squares(lengths, 2048)[0].max() + 1
    assert len({r["sequence_id"] for r in rows}) <= 1.002 * one + 1 and one <= -(-lengths.sum() // 2048) + 1
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        ends = np.cumsum([0] + [n for _, n in sorted(own)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(own)] == ends[:-1].tolist()


def test_op1_digests_are_of_packed_ids(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = pack_documents(spark.read.parquet(f"{sf}/documents.parquet")).drop("ids")
    got = packing.op1_best_fit_packing(spark, sf)
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())
    # The digests are of the ids that placement is given.
    cut = tokenize_pieces(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("ids", F.expr("slice(ids, 1, 1)"))
    monkeypatch.setattr(packing, "tokenize_pieces", lambda docs, **k: cut)
    rows = packing.op1_best_fit_packing(spark, sf).select("length", "ids_crc32").distinct().collect()
    assert {tuple(r) for r in rows} == {(1, zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in cut.collect()}


def test_another_operator_empties_the_cache():
    from tidegraph.llm.common import claim

    claim("packing", packing.forget)
    packing.encoder(tokenizer_path())
    claim("packing", packing.forget)
    assert packing._encoders
    claim("toxicity")
    assert not packing._encoders
