import hashlib
import random

import numpy as np
import pytest

from tidegraph.llm.deepshallow import deep_shallow
from tidegraph.llm.suffix_dedup import frequent, remove_repeats


def plain(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                m[k : k + length] = b"\1" * length
            seen.add(w)
        rest = bytes(c for c, g in zip(b, m, strict=True) if not g)
        out[i] = (len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1])), hashlib.sha256(rest).hexdigest())
    return out


def test_deep_shallow():
    rng = random.Random(1)
    for _ in range(100):
        s = [bytes(rng.choices(b"ab", k=rng.randrange(60))) for _ in range(20)] + [b"x" * 40 + bytes(rng.choices(b"ab", k=rng.randrange(9))) for _ in range(9)]
        assert deep_shallow(s) == sorted(range(len(s)), key=lambda i: (s[i], i))


@pytest.mark.parametrize("group", [8192, 3, 1])
def test_against_plain(spark, group):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdé \n", k=300)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "ab" * 400)]
    for i in range(5, 80):
        t = ""
        for _ in range(rng.randrange(4)):
            x = rng.randrange(200)
            t += rng.choice(base)[x : x + rng.randrange(300)] + "".join(rng.choices("xyz", k=rng.randrange(30)))
        rows.append((i, t))
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 3)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == plain(rows)


def test_texts_and_odd_rows(spark):
    long = "".join(random.Random(3).choices("abcdefgh ", k=250))
    rows = [(1, long, "x"), (2, "p" + long, "y"), (2, "p" + long, "y"), (None, long, "z"), (3, "short", None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, uid string"), with_text=True)
    assert got.columns == ["doc_id", "text", "uid"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, long, "x"), (2, "p", "y"), (2, "", "y"), (None, "", "z"), (3, "short", None)], key=str)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_rows_without_an_id(spark):
    rng = random.Random(5)
    a, b = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(2))
    rows = [(None, a[: 150 + i] + b) for i in range(40)] + [(None, a)] * 30 + [(4, b)]
    # In a document of its own, what is left of each can be told by the plain rule in order of (id, hash).
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, int(hashlib.sha256(rows[i][1].encode()).hexdigest()[:15], 16)))
    want = plain([(k, rows[i][1]) for k, i in enumerate(order)])
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(want.values())


def test_a_third_of_all_rows_share_a_passage(spark):
    # One anchor has hundreds of different contexts, and one context hundreds of places.
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefghijkl ", k=n))
    shared, page = word(60), word(220)
    rows = [(i, word(150) + shared + word(90)) for i in range(300)] + [(300 + i, word(40) + page + word(30)) for i in range(300)] + [(600 + i, word(200)) for i in range(200)]
    rows += [(900 + i, word(20) + rows[i][1][100:260] + word(5)) for i in range(100)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group=40).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == plain(rows)


def test_frequent_keeps_large_shares():
    rng = np.random.default_rng(4)
    h, c = np.empty(0, "u8"), np.empty(0, "i8")
    total, own = 0, 0
    for _ in range(20):
        new = np.concatenate([rng.integers(10, 1 << 60, 900, dtype="u8"), np.full(100, 7, "u8")])
        total, own = total + len(new), own + 100
        h, c = frequent(np.concatenate([h, new]), np.concatenate([c, np.ones(len(new), "i8")]), 50)
        assert len(h) <= 50
    assert own - total / 51 <= dict(zip(h.tolist(), c.tolist(), strict=True))[7] <= own
