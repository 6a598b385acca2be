import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidegraph.llm import simhash, suffix_dedup, toxicity
from tidegraph.llm.common import documents, labels, materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    out, kept = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = materialize(stage(spark, out, SF), name)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name in ("toxicity", "simhash_near_dedup"):
            assert out.count() <= before.count() and out.exceptAll(before).isEmpty()
        if name == "suffix_dedup":
            assert out.count() == before.count()
            kept = out
    assert out.join(kept, "doc_id", "left_anti").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    assert packed.where("piece = 0").count() == out.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(out.columns)


def test_odd_tables(spark):
    """Nulls in every column, empty and repeated rows, clashing names, no rows at all."""
    rng = random.Random(3)
    text = lambda n=60: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    a, b = text(), text()
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, b, None, None, None), (2, text(), "en", "s", 2), (None, text(), None, None, None), (None, None, None, None, None), (4, "", "en", "t", 0), (5, None, "en", "t", 0), (6, b + " " + b, "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame(rows, schema)
    names = ("y", "uid", "sha", "rid", "row", "s", "copy", "place", "__key", "key", "root", "fp", "length", "kept_row")
    for docs in (odd, odd.withColumns({c: F.lit(7) for c in names}), odd.limit(0)):
        out, n = docs, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, out, SF), name)
            assert out.columns == docs.columns and (n > 0 or out.count() == 0)
        packed = corpus_pipeline.STAGES[-1][1](spark, out, SF)
        assert packed.where("piece = 0").count() == out.count()
    # Copies and near copies (that text twice over is one) leave one row each; texts without words are one group.
    kept = corpus_pipeline.drop_near_copies(spark, odd, SF)
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1, 2, 2, 4]


def test_stages_are_those_of_plain_versions(spark):
    docs, marks = documents(spark, SF), labels(spark, SF)
    model = toxicity.train(docs, marks)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, model).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()} == {i for i, s in scores.items() if s < 0.5}
    some = docs.orderBy("doc_id").limit(400)
    fps = sorted((r["doc_id"], simhash.fingerprint((r["text"] or "").encode(), 4)) for r in some.collect())
    low = {i: i for i, _ in fps}
    for _ in range(20):
        low = {i: min(low[j] for j, g in fps if (f ^ g).bit_count() <= 4) for i, f in fps}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, some, SF).collect()} == set(low.values())
    cut = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, some, SF).collect()}
    kept = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.remove_repeats(some).collect()}
    whole = [i for i, r in cut.items() if hashlib.sha256((r["text"] or "").encode()).hexdigest() == kept[i]]
    assert len(whole) > 0.9 * len(cut)  # others lost a code point that a cut split
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())


def test_packed_sequences_hold_ids(spark):
    docs = documents(spark, SF).limit(60)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        tokens = sequences.setdefault(r["sequence_id"], [])
        assert len(tokens) == r["offset"] and len(r["ids"]) == r["length"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        tokens += r["ids"]
    assert sum(x.count(0) for x in sequences.values()) >= 60
