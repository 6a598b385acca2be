"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon (whole words, and stems that any ending may follow) is learned from
labelled documents. Its trie is intersected with the Levenshtein automaton of
each word of a text, so that misspelled terms are found too. Windows around
the matches tell quotation from abuse, and a logistic model turns window scores
into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded, claim, documents, fold, labels, materialize

FOLDS = 5
THRESHOLD = 0.5
#: Labelled documents that lexicon and weights are learned from, at most (about).
TRAIN_DOCS = 12_000
MIN_DOCS = 3
#: Least share of the toxic documents that a term occurs in. A text has so many different words,
#: so this bounds the lexicon too, whatever the number of documents.
MIN_SHARE = 0.008
#: A term is this many times likelier in toxic documents.
MIN_RATIO = 20.0
STEMS = (4, 5, 6, 7, 8)
#: Terms from this length on are found misspelled; those below FUZZY_LONG only in words that clean labelled documents don't have.
FUZZY_FROM, FUZZY_LONG = 4, 5
#: Words on each side of a match that tell how it is used, documents added to each count of theirs, and
#: the least log-likelihood ratio at which a word says anything: chance reaches it once in ten million words.
CONTEXT, SMOOTH, TELLING = 6, 25.0, 28.0
#: A window whose words have log odds below this, in sum, is a quotation.
QUOTED = -3.0
#: Letters and digits, with the signs that stand for letters before or between them; quotation marks; line ends.
TOKEN = re.compile(r"[@$]?[^\W_]+(?:[@$]+[^\W_]+)*|[\"“”„«»‘’]|\n")
QUOTES = frozenset("\"“”„«»‘’")
#: Digits and signs that stand for letters.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
KINDS = 4  # whole word exact, stem exact, whole word misspelled, stem misspelled


class Automaton:
    """The product of a lexicon's trie and Levenshtein automata of distance one,
    with states made as words need them.

    A state is the set of (trie node, edits) that a prefix can reach. Random words
    leave the automaton after a few letters. Terms shorter than ``fuzzy_from`` match exactly only.
    """

    DEAD = -1

    def __init__(self, words: list[str], stems: list[str], fuzzy_from: int = FUZZY_FROM, limit: int = 200_000):
        self.fuzzy_from, self.limit = fuzzy_from, limit
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.deepest = [0]
        for terms, ends in ((words, self.word_at), (stems, self.stem_at)):
            for term in terms:
                node, way = 0, [0]
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.deepest.append(0)
                    node = self.children[node][c]
                    way.append(node)
                ends[node] = term
                for n in way:
                    self.deepest[n] = max(self.deepest[n], len(term))
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, states: set) -> frozenset:
        """Adds what is reached by leaving out a letter of the term; keeps the fewest edits."""
        out = set(states)
        for node, edits in states:
            if edits == 0:
                out |= {(c, 1) for c in self.children[node].values() if self.deepest[c] >= self.fuzzy_from}
        return frozenset(s for s in out if s[1] == 0 or (s[0], 0) not in out)

    def _state(self, states: frozenset) -> int:
        if not states:
            return self.DEAD
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.found.append(self._accepts(states))
        return self.number[states]

    def _accepts(self, states: frozenset) -> tuple:
        """The nearest whole word and the nearest stem that what is read so far matches."""
        word = stem = None
        for node, edits in states:
            if node in self.word_at and (edits == 0 or len(self.word_at[node]) >= self.fuzzy_from):
                word = min(word, (edits, self.word_at[node])) if word else (edits, self.word_at[node])
            if node in self.stem_at and (edits == 0 or len(self.stem_at[node]) >= self.fuzzy_from):
                stem = min(stem, (edits, self.stem_at[node])) if stem else (edits, self.stem_at[node])
        return word, stem

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            below = self.children[node]
            if c in below:
                out.add((below[c], edits))
            if edits == 0:
                if self.deepest[node] >= self.fuzzy_from:
                    out.add((node, 1))  # a letter too many
                out |= {(n, 1) for n in below.values() if self.deepest[n] >= self.fuzzy_from}  # another letter
        return self._state(self._closed(out))

    def match(self, word: str) -> tuple[int, str] | None:
        """(kind, term) of the best match of a lower-case word."""
        if len(self.sets) > self.limit:
            self.reset()
        state, stem = self.start, None
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._move(state, c)
            state = to
            if state < 0:
                break
            got = self.found[state][1]
            if got and (stem is None or got < stem):
                stem = got
        whole = self.found[state][0] if state >= 0 else None
        ways = [(0 if whole[0] == 0 else 2, whole[1])] if whole else []
        ways += [(1 if stem[0] == 0 else 3, stem[1])] if stem else []
        return min(ways) if ways else None


#: Per kind: log of matches in abuse and in quotation, the mean of their windows' log odds, and share of words; then the text's size.
FEATURES = KINDS * 4 + 2


@dataclass
class Model:
    """What is learned: terms, words near them that tell abuse (above 0) from quotation, words that are no misspellings, weights."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    context: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0] + [1.5, -0.5, 1.0, 0.5] * KINDS))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


class Scanner:
    """Finds terms in texts and scores their windows."""

    def __init__(self, model: Model, limit: int = 150_000):
        claim("toxicity")
        self.automaton, self.known, self.limit = Automaton(model.words, model.stems), {}, limit
        self.context, self.clean = model.context, model.clean

    def lookup(self, word: str) -> tuple[int, str] | None:
        """(kind, term) of the best match of a token, with signs read as letters where it has any."""
        found = self.automaton.match(word.translate(LOOKALIKE) if not word.isalpha() else word)
        if found and found[0] > 1 and len(found[1]) < FUZZY_LONG and word in self.clean:
            return None
        return found

    def matches(self, text: str) -> tuple[list[tuple[int, int, str]], list[str]]:
        """``(token number, kind, term)`` of each match, and the text's tokens."""
        tokens = TOKEN.findall(text.lower())
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = self.lookup(t)
        hits = {t for t in set(tokens) if known[t]}
        if not hits:
            return [], tokens
        return [(i, *known[t]) for i, t in enumerate(tokens) if t in hits], tokens

    def windows(self, text: str) -> list[list[str]]:
        """The words around each match, without the match."""
        hits, tokens = self.matches(text)
        return [[t for t in tokens[max(0, i - CONTEXT) : i] + tokens[i + 1 : i + CONTEXT + 1] if t not in QUOTES and t != "\n"] for i, _, _ in hits]

    def features(self, text: str) -> list[float]:
        """Window scores of a whole text.

        A match is quoted if quotation marks stand on both sides of it in its window, or if the
        words of its window speak for a quotation: their log odds, learned from labelled documents, are far below 0.
        """
        hits, tokens = self.matches(text)
        n = max(len(tokens), 1)
        out = [1.0, math.log1p(n) / 10] + [0.0] * (KINDS * 4)
        if not hits:
            return out
        abuse, quoted, odds, count = ([0.0] * KINDS for _ in range(4))
        open_quotes = np.cumsum([t in QUOTES for t in tokens])
        for i, kind, _ in hits:
            lo, hi = max(0, i - CONTEXT), i + CONTEXT + 1
            before = open_quotes[i] - (open_quotes[lo - 1] if lo else 0)
            after = open_quotes[min(hi, len(tokens)) - 1] - open_quotes[i]
            speaks = sum(self.context.get(t, 0.0) for t in tokens[lo:i] + tokens[i + 1 : hi])
            count[kind] += 1
            odds[kind] += speaks
            (quoted if (before > 0 and after > 0) or speaks < QUOTED else abuse)[kind] += 1
        for k in range(KINDS):
            out[2 + 4 * k : 6 + 4 * k] = [math.log1p(abuse[k]), math.log1p(quoted[k]), math.tanh(odds[k] / max(count[k], 1) / 4), min(1.0, 10 * count[k] / n)]
        return out


def learn_lexicon(rows: DataFrame, *, min_docs: int = MIN_DOCS, min_ratio: float = MIN_RATIO) -> tuple[list[str], list[str]]:
    """``rows(text, y)`` -> (words, stems) that toxic documents have far more often.

    Document frequencies of words and of word beginnings are counted over all
    rows; those that enough toxic documents have come to the driver. A beginning counts
    as a stem only where it clearly explains more toxic documents than each word
    that it begins.
    """
    rows = rows.select("text", "y").distinct()  # copies are no evidence
    n = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in n}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return [], []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,40})"), F.lit(1)))

    def begun(k: int) -> Column:
        return F.transform(F.filter("w", lambda x: F.length(x) > k), lambda x: F.concat(F.substring(x, 1, k), F.lit("*")))

    terms = rows.select("y", F.xxhash64("text").alias("doc"), words.alias("w")).select("y", "doc", F.explode(F.array_distinct(F.concat("w", *map(begun, STEMS)))).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") >= max(min_docs, MIN_SHARE * n1))
    ratio = (F.col("a") / n1) / ((F.col("b") + 0.5) / n0)
    best = counted.withColumn("r", ratio).where(F.col("r") >= min_ratio).orderBy("term").collect()
    share = {r["term"]: (r["a"], r["b"]) for r in best}
    if not share:
        return [], []
    # Which candidates each toxic document of the sample has.
    chosen = F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in share], "term string"))
    held = [set(r[1]) for r in terms.where("y = 1").join(chosen, "term").groupBy("doc").agg(F.collect_list("term")).collect()]
    single = {t for t in share if not t.endswith("*")}
    top: dict[str, int] = {}
    for t in single:
        for k in STEMS:
            top[t[:k]] = max(top.get(t[:k], 0), share[t][0])
    # One word's beginning is no stem; neither is a longer one of the same reach.
    stems = {t[:-1]: share[t] for t in share if t.endswith("*")}
    stems = {t: v for t, v in stems.items() if v[0] > 1.3 * top.get(t, 0)}
    stems = {t: v for t, v in stems.items() if not any(t[:k] in stems and stems[t[:k]][1] <= v[1] + 2 for k in STEMS if k < len(t))}
    words = {t: share[t] for t in single if not t.startswith(tuple(stems))}
    # Terms by falling reach; a document that other terms explain speaks less for the next one.
    kept: tuple[list[str], list[str]] = ([], [])
    explained = [0] * len(held)
    having: dict[str, list[int]] = {}
    for i, own in enumerate(held):
        for t in own:
            having.setdefault(t, []).append(i)
    for key, _ in sorted([(t, v) for t, v in words.items()] + [(t + "*", v) for t, v in stems.items()], key=lambda x: (-x[1][0], x[0])):
        docs = having.get(key, [])
        if sum(1 / (1 + explained[i]) for i in docs) >= max(1.0, 0.5 * MIN_SHARE * n1):
            for i in docs:
                explained[i] += 1
            kept[key.endswith("*")].append(key.rstrip("*"))
    return sorted(kept[0]), sorted(kept[1])


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.ones(x.shape[1])
    keep[0] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep * max(1, len(y) ** 0.5))
        step = np.linalg.solve(h, x.T @ (y - p) - keep * max(1, len(y) ** 0.5) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_context(rows: DataFrame, model: Model, *, min_docs: int = MIN_DOCS, smooth: float = SMOOTH) -> dict[str, float]:
    """``rows(text, y)`` -> log odds of words near matches: how much likelier a toxic document that has
    matches has the word near one than a clean document that has matches.

    Counts are of different texts, and ``smooth`` documents of either kind are added at the
    word's overall rate, so that words say nothing where too few clean documents name a term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            found = [sorted({t for w in scanner.windows(x or "") for t in w} | ({""} if scanner.matches(x or "")[0] else set())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["y", "near"])

    near = rows.select(F.col("y").cast("int").alias("y"), "text").distinct().mapInArrow(run, "y int, near array<string>").select("y", F.explode("near").alias("term"))
    counts = near.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where((F.col("a") + F.col("b") >= min_docs) | (F.col("term") == "")).collect()
    counts = {r["term"]: (r["a"], r["b"]) for r in counts}  # words near matches in the sample
    n1, n0 = counts.pop("", (0, 0))
    if not n1 or not n0:
        return {}
    out = {}
    for term, (a, b) in counts.items():
        rate = (a + b) / (n1 + n0)
        ratio = 2 * sum(k * math.log(k / (n * rate)) for k, n in ((a, n1), (b, n0)) if k)
        ratio += 2 * sum((n - k) * math.log((n - k) / (n * (1 - rate))) for k, n in ((a, n1), (b, n0)) if k < n)
        if ratio >= TELLING:
            out[term] = math.log((a + smooth * rate) / (n1 + smooth)) - math.log((b + smooth * rate) / (n0 + smooth))
    return out


def clean_words(rows: DataFrame, model: Model) -> frozenset[str]:
    """Words of clean documents that are one edit from a short term: no misspellings of it."""
    words = rows.where("y = 0").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,40})"), F.lit(1)))).alias("w")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Automaton(model.words, model.stems).match
        for batch in batches:
            got = ((w, match(w)) for w in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([w for w, m in got if m and m[0] > 1 and len(m[1]) < FUZZY_LONG], pa.string())], names=["w"])

    # At most as many as there are words within an edit of a short term.
    return frozenset(r["w"] for r in words.mapInArrow(run, "w string").collect())


def train(docs: DataFrame, marks: DataFrame, *, train_docs: int = TRAIN_DOCS, seed_words: tuple[str, ...] = ()) -> Model:
    """Learn lexicon, contexts and weights from at most about ``train_docs`` labelled documents
    that aren't held out. Without labels of both kinds, the lexicon is
    ``seed_words`` and the weights are the default ones. Null ids, texts and labels teach nothing;
    of ``docs`` only doc_id and text are read, of ``marks`` doc_id and toxic."""
    own = marks.where((fold("doc_id", FOLDS) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).dropDuplicates(["__id"])
    own = bounded(own, "__id", train_docs)
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = materialize(texts.join(F.broadcast(own), F.col("doc_id") == F.col("__id")).select("text", "y"), "toxic-labelled")
    words, stems = learn_lexicon(rows)
    model = Model(sorted({*words, *seed_words}), stems)
    if not model.words and not stems:
        return model
    model.clean = clean_words(rows, model)
    # Weights are fitted on windows whose words were weighed by the other half of the documents, as those of new ones are.
    halves = [rows.where(F.pmod(F.xxhash64("text"), F.lit(2)) == k) for k in (0, 1)]
    each = [replace(model, context=learn_context(halves[1 - k], model)) for k in (0, 1)]
    parts = [_features(half.select(F.col("y").cast("long").alias("doc_id"), "text"), own) for half, own in zip(halves, each, strict=True)]
    got = parts[0].unionByName(parts[1]).groupBy("doc_id", "x").count().collect()  # bounded by train_docs
    model.context = learn_context(rows, model)
    if {r["doc_id"] for r in got} != {0, 1}:
        return model
    x, y, n = np.array([r["x"] for r in got]), np.array([r["doc_id"] for r in got], float), np.array([r["count"] for r in got])
    x, y = np.repeat(x, n, axis=0), np.repeat(y, n)
    order = np.lexsort(x.T)
    model.weights = fit_weights(x[order], y[order])
    return model


def _features(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = [scanner.features(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def toxicity_scores(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, score, predicted, terms)``, a row per row.

    ``terms`` are the lexicon terms that were found. Null and empty texts have
    score 0. Whole texts are read, however long. Repeated rows and ids score alike, a null id stays null;
    other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                score = model.score(np.array([scanner.features(t) for t in texts])) * np.array([bool(t.strip()) for t in texts])
                # The term list costs a second look at texts with matches only.
                terms = [sorted({m[2] for m in scanner.matches(t)[0]}) if s > 0.02 else [] for t, s in zip(texts, score, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "score", "terms"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, terms array<string>")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms")


def keep_clean(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score below ``threshold``: null and empty ones
    among them, repeated ones together. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(where).to_pylist()]
                score = model.score(np.array([scanner.features(t) for t in texts])) * np.array([bool(t.strip()) for t in texts])
                yield part.filter(pa.array(score < threshold))

    where = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity_scores(docs, train(docs, labels(spark, sf_dir))).drop("terms")
