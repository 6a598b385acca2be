import re

import numpy as np
import pytest
import xxhash

from tidegraph.llm.simhash import cheapest, keep_one, links, near_duplicates


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("blocks", [2, 3])
def test_no_link_is_missed(spark, blocks):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 200)
    y = [int(v) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for v, k in zip(x, rng.integers(0, 6, 200), strict=True)]
    got = links(spark.createDataFrame([(v,) for v in {*map(int, x), *y}], "fp long"), 4, blocks).collect()
    pairs = {frozenset(r) for r in got}
    want = {frozenset((int(a), b)) for a, b in zip(x, y, strict=True) if 1 <= (int(a) ^ b).bit_count() <= 4}
    assert want <= pairs and all(bin(a ^ b).count("1") <= 4 for a, b in got)


def test_documents(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 200, 60)]
    texts += [t.upper() for t in texts[:10]] + [" ".join([*t.split()[:-1], "zz"]) for t in texts[:20]] + [None, "", " \n", "one"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [plain(t) for _, t in rows]
    low = [i for i, _ in rows]
    assert len(got) == len(rows)
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            m = min(comp[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4)
            if m < comp[i]:
                comp[i], changed = m, True
    want = {}
    for i, c in enumerate(comp):
        ids = [low[j] for j in range(len(rows)) if comp[j] == c and low[j] is not None]
        want[rows[i][0]] = (f"{fps[i]:016x}", min(ids))
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == want[r["doc_id"]]
    kept = keep_one(spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({v[1] for v in want.values()})
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_component_stays(spark):
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(3))
    rows = [(1, a, "x"), (2, a.upper(), "y"), (2, b, "y"), (2, b, "y"), (None, a, None), (None, c, None), (None, c, None), (7, None, "z"), (8, "", "z")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, kept_row string"))
    assert got.columns == ["doc_id", "text", "kept_row"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a, "x"), (2, b, "y"), (None, c, None), (7, None, "z")], key=str)
    assert keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_follow_the_cost():
    assert cheapest(10, 4) == cheapest(1 << 20, 4) == 3 and cheapest(1 << 32, 4) == 2
