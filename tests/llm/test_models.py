"""Learned operators: odd rows, and held-out quality on the small tables."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import language_id, quality_classifier, quality_rules, toxicity
from tidegraph.llm.common import documents, labels
from tidegraph.llm.textstats import base_counts, lines_of

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 %%%"), (5, "word " * 30000), (None, "some text here"), (5, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, score string")


def test_base_counts():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choices(["a", "b", "c", " ", "\n", "\t", "#", "é", "|", "\x1c"], k=rng.randrange(80)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        m = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert base_counts(t) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(m))


def test_quality_rules(spark, docs, odd):
    chain = quality_rules.train(docs, labels(spark, SF))
    got = quality_rules.quality_rules(docs, chain).join(labels(spark, SF), "doc_id").where("not base_failed")
    share = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2
    rows = quality_rules.quality_rules(odd, chain).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality_rules.train(docs.limit(0), labels(spark, SF)).weights.shape == chain.weights.shape
    assert quality_rules.quality_rules(docs.limit(0), chain).count() == 0


def test_lines_of_one_document_differ(spark, docs):
    # Texts of low quality begin with a clean line: the field tells it from the lines after it.
    chain = quality_rules.train(docs, labels(spark, SF))
    rows = [r["text"] for r in docs.where("text is not null").orderBy("doc_id").limit(600).collect()]
    x, first = lines_of([t.encode() for t in rows])
    y = chain.decode(x[:, :14], first)
    mixed = [k for k, (lo, hi) in enumerate(zip(first, first[1:], strict=False)) if 0 < y[lo:hi].sum() < hi - lo]
    assert len(mixed) > 20
    # A text made of the lines of two: those of a clean one and those of a table.
    good = max((r["text"] for r in docs.join(labels(spark, SF), "doc_id").where("quality = 1 and lang = 'en'").collect()), key=lambda t: t.count("\n")).split("\n")
    bars = max((t for t in rows if " | " in t), key=lambda t: t.count(" | ")).split("\n")
    good, bars = [x for x in good if len(x) > 200][:4], [x for x in bars if x.count(" | ") > 9][:4]
    x, first = lines_of(["\n".join(good + bars).encode(), "\n".join(bars + good).encode()])
    k, m = len(good), len(bars)
    assert min(k, m) > 1 and chain.decode(x[:, :14], first).tolist() == [1] * k + [0] * m + [0] * m + [1] * k
    # The share decides: with another least share, other documents are kept.
    df = spark.createDataFrame([(1, "\n".join(good + bars))], "doc_id long, text string")
    share = quality_rules.quality_rules(df, chain).first()["content_share"]
    assert 0 < share < 1
    n = {m: quality_rules.quality_rules(docs, chain, min_share=m).where("kept").count() for m in (0.05, 0.5, 0.95)}
    assert n[0.05] > n[0.5] > n[0.95]


def test_rows_are_those_of_a_plain_version(spark, docs):
    chain = quality_rules.train(docs, labels(spark, SF))
    for r in quality_rules.quality_rules(docs, chain).join(docs.withColumnRenamed("doc_id", "i"), F.col("i") == F.col("doc_id")).limit(250).collect():
        text = r["text"] or ""
        x, _ = lines_of([text.encode()])
        best = [(x[0, :14] @ chain.weights[:, v], [v]) for v in (0, 1)]
        for line in x[1:, :14]:
            best = [max((s + chain.moves[way[-1], v] + line @ chain.weights[:, v], way + [v]) for s, way in best) for v in (0, 1)]
        way = max(best)[1]
        sizes = [len(re.sub(rb"[\x20\x09-\x0D]", b"", line)) for line in text.encode().split(b"\n")]
        share = sum(n for n, v in zip(sizes, way, strict=True) if v) / max(sum(sizes), 1)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = len(words) < 10 or 100 * r["n_repeat_words"] > 20 * len(words)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and share >= 0.5) and r["content_share"] == pytest.approx(share)


def test_latent_labels_keep_to_the_documents_labels():
    import numpy as np

    p, size, first = np.array([0.9, 0.8, 0.2, 0.1, 0.3, 0.4]), np.array([10, 10, 10, 10, 1, 9]), np.array([0, 3, 6])
    assert quality_rules.allowed(p, size, first, np.array([0, 1])).tolist() == [1, 0, 0, 0, 1, 1]
    assert quality_rules.allowed(p, size, first, np.array([1, 0])).tolist() == [1, 1, 0, 0, 0, 0]


def test_training_texts_are_bounded_in_bytes(spark, docs):
    marks = labels(spark, SF)
    assert (quality_rules.train(docs, marks, train_bytes=10).weights == quality_rules.Chain().weights).all()
    assert (quality_rules.train(docs, marks, train_bytes=200_000).weights != quality_rules.train(docs, marks).weights).any()


def test_viterbi_is_the_best_path():
    import numpy as np
    from itertools import product

    rng = np.random.default_rng(0)
    chain = quality_rules.Chain(rng.normal(size=(14, 2)), rng.normal(size=(2, 2)))
    x, first = rng.normal(size=(11, 14)), np.array([0, 4, 5, 11])
    got = chain.decode(x, first)
    for lo, hi in zip(first, first[1:], strict=False):
        s = x[lo:hi] @ chain.weights
        best = max(product((0, 1), repeat=hi - lo), key=lambda y: sum(s[i, v] for i, v in enumerate(y)) + sum(chain.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert tuple(got[lo:hi]) == best


def held_out(df, marks, label):
    return [(r["score"], r["predicted"], r[label]) for r in df.join(marks, "doc_id").where("held_out").collect()]


def test_quality_classifier(spark, docs, odd):
    rows = held_out(quality_classifier.quality_scores(docs, labels(spark, SF)), labels(spark, SF), "quality")
    assert sum(p == y for _, p, y in rows) / len(rows) > 0.95
    got = quality_classifier.quality_scores(odd, labels(spark, SF)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity(spark, docs, odd):
    model = toxicity.train(docs, labels(spark, SF))
    rows = held_out(toxicity.toxicity_scores(docs, model), labels(spark, SF), "toxic")
    assert sum(p == y for _, p, y in rows) / len(rows) > 0.95
    # About an eighth of the toxic labels are of texts without any term; of the others all are found.
    marked = toxicity.toxicity_scores(docs, model).join(labels(spark, SF), "doc_id").where("held_out")
    with_terms = marked.join(docs.select("doc_id", "text"), "doc_id").where(F.lower("text").rlike("idiot|stupid|moron|trash|pathetic|worthless|disgusting|clown|loser|scum"))
    assert [r["predicted"] for r in with_terms.where("toxic = 1").collect()].count(0) == 0 < with_terms.where("toxic = 1").count()
    assert marked.where("toxic = 0 and predicted = 1").count() == 0
    got = toxicity.toxicity_scores(odd, model).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_automaton_is_levenshtein():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(3)
    for _ in range(60):
        terms = ["".join(rng.choices("abc", k=rng.randrange(3, 8))) for _ in range(6)]
        a = toxicity.Automaton(terms, [])
        for _ in range(40):
            w = "".join(rng.choices("abc", k=rng.randrange(9)))
            want = [(distance(w, t), t) for t in terms if distance(w, t) <= (1 if len(t) >= toxicity.FUZZY_FROM else 0)]
            got = a.match(w)
            assert (got and (got[0] // 2, got[1])) == (min(want) if want else None)


def test_quotation_counts_apart():
    s = toxicity.Scanner(toxicity.Model(["idiot"], [], {"wrote": -4.0, "you": 1.0}))
    assert s.features("you are an idiot")[2:5] == [pytest.approx(0.693, abs=1e-3), 0, pytest.approx(0.245, abs=1e-3)]
    assert s.features('the "idiot" of the book')[2] == 0 and s.features("he wrote idiot twice")[2:4] == [0, pytest.approx(0.693, abs=1e-3)]
    assert s.features("1diot")[2] > 0 and s.features("idiott")[2 + 8] > 0 and s.features("an id!ot")[2] == 0


def test_signs_and_short_terms():
    s = toxicity.Scanner(toxicity.Model(["pathetic", "scum", "stupid"], [], {}, frozenset({"scam"})))
    found = lambda t: [(k, x) for _, k, x in s.matches(t)[0]]
    assert found("so p@thetic and $tupid, a b@r") == [(0, "pathetic"), (0, "stupid")]
    assert found("skum scumm scam s c u m") == [(2, "scum"), (2, "scum")]


def test_windows_are_those_of_a_plain_version():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(7)
    terms, context = ["moron", "scum", "clowns"], {"said": -2.0, "you": 1.5, "it": -0.75}
    s = toxicity.Scanner(toxicity.Model(terms, [], context))
    words = [*terms, "morn", "mroon", "clown", "skum", "said", "you", "it", "a", '"', "“", "\n", "x1"]
    for _ in range(200):
        tokens = rng.choices(words, k=rng.randrange(1, 40))
        n = [[0, 0, 0.0] for _ in range(4)]
        for i, w in enumerate(tokens):
            best = min(((distance(w, t), t) for t in terms), default=None) if w.isalpha() else None
            if best and best[0] <= 1:
                before, after = tokens[max(0, i - 6) : i], tokens[i + 1 : i + 7]
                odds = sum(context.get(x, 0) for x in before + after)
                quoted = odds < -3 or (any(x in '"“' for x in before) and any(x in '"“' for x in after))
                own = n[2 * best[0]]
                own[quoted] += 1
                own[2] += odds
        want = [1.0, math.log1p(len(tokens)) / 10]
        for abuse, quoted, odds in n:
            k = abuse + quoted
            want += [math.log1p(abuse), math.log1p(quoted), math.tanh(odds / max(k, 1) / 4), min(1, 10 * k / len(tokens))]
        assert s.features(" ".join(tokens)) == pytest.approx(want)


def test_contexts_are_learned(spark):
    # The term is the same in both; the words around it tell abuse from report.
    rng = random.Random(8)
    fill = ["".join(rng.choices("mnopqv", k=7)) for _ in range(200)]
    say = lambda *near: " ".join(rng.choices(fill, k=20) + list(near) + rng.choices(fill, k=20))
    rows = [(i, say("du", "bist", "ein", "grobian"), 1) for i in range(150)] + [(200 + i, say("laut", "bericht", "fiel", "grobian"), 0) for i in range(8)] + [(400 + i, say("und"), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(df, df.select("doc_id", F.col("y").alias("toxic")))
    assert "grobian" in model.words + model.stems or any("grobian".startswith(t) for t in model.stems)
    assert model.context["bericht"] < -1 and fill[0] not in model.context
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(spark.createDataFrame([(1, say("du", "bist", "ein", "grobian")), (2, say("laut", "bericht", "fiel", "grobian")), (3, say())], "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 > max(got[2], got[3])


def test_backoff_is_that_of_a_plain_version():
    import numpy as np

    rng = np.random.default_rng(9)
    words, grams = {"the": 0, "der": 1}, [{"a": 2, "b": 3}, {" a": 4, "ab": 5}, {"abc": 6}, {"abcd": 7}]
    t = language_id.Tables(["de", "en"], words, grams, rng.normal(size=(8, 2)), np.log([0.3, 0.7]))
    scorer = language_id.Scorer(t)

    def one(word):
        if word in words:
            return t.logs[words[word]]
        padded, total = f" {word} ", np.zeros(2)
        for i in range(len(padded)):
            for k in (4, 3, 2, 1):
                part = padded[i : i + k]
                if len(part) == k and part in grams[k - 1]:
                    total = total + 2 * 0.4 ** (4 - k) * t.logs[grams[k - 1][part]]
                    break
        return total / len(padded)

    for text in ("the", "der abcd", "zzz", "abca the ba", "m² ab½c Ⅷ the", "²½Ⅷ", "ab12cd"):
        parts = re.findall(r"[a-zA-Z]+", text)
        lang, score = scorer.score([text])[0]
        if not parts:
            assert (lang, score) == ("und", 0.0)
            continue
        z = sum(map(one, parts)) / math.sqrt(len(parts)) + t.prior
        p = np.exp(z) / np.exp(z).sum()
        assert lang == t.langs[int(p.argmax())] and score == pytest.approx(p.max())


def test_densities_are_those_of_a_plain_version(spark):
    import numpy as np

    rng = np.random.default_rng(10)
    k = quality_classifier.STATISTICS
    x = np.vstack([rng.normal(size=(60, k)) @ rng.normal(size=(k, k)), 1 + rng.normal(size=(90, k))])
    y = np.repeat([0, 1], [60, 90])
    model = quality_classifier.fit(spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x, strict=True)], "y int, x array<double>"))
    pooled, log = np.cov(x.T, bias=True), []
    for c in (0, 1):
        cov = 0.9 * np.cov(x[y == c].T, bias=True) + 0.1 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-4 * np.eye(k)
        d = x - x[y == c].mean(axis=0)
        log.append(np.log(((y == c).sum() + 1) / 152) - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    assert model.difference(x) == pytest.approx(log[1] - log[0], rel=1e-6)


def test_empty_tables_and_clashing_columns(spark, docs):
    marks, none = labels(spark, SF), docs.limit(0)
    clash = docs.limit(40).withColumns({c: F.lit(1) for c in ("y", "__id", "x", "quality", "toxic", "term")})
    toxic = toxicity.train(clash, marks)
    for empty in (none, clash.limit(0)):
        assert toxicity.toxicity_scores(empty, toxic).count() == toxicity.keep_clean(empty, toxic).count() == 0
        assert quality_classifier.quality_scores(empty, marks).count() == 0
        assert language_id.identify(empty, language_id.train(empty)).count() == 0
        assert toxicity.train(empty, marks).words == []
    assert toxicity.keep_clean(clash, toxic).columns == clash.columns
    assert quality_rules.quality_rules(clash, quality_rules.train(clash, marks.limit(0))).count() == 40
    assert quality_classifier.quality_scores(clash, marks).count() == 40 and language_id.identify(clash, language_id.train(clash)).count() == 40


def test_language(spark, docs, odd):
    tables = language_id.train(docs)
    got = language_id.identify(docs, tables).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.98
    rows = {r["doc_id"]: r for r in language_id.identify(odd.where("doc_id < 5"), tables).collect()}
    assert all(rows[i]["lang_pred"] == "und" for i in (1, 2, 3, 4))
    assert language_id.identify(odd, language_id.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
