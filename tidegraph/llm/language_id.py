"""Language ID: word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls
back to the longest known character n-grams that cover it, shorter and shorter
ones until single letters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded, documents, fold, materialize

FOLDS = 3
#: Documents that the tables are learned from, at most (about; a hash of ids chooses). The
#: tables hold every word and n-gram of these.
TRAIN_DOCS = 6_000
LONGEST = 4
#: Weight of each shorter n-gram against the one before it.
BACKOFF = 0.4
UNKNOWN = "und"
#: Letters, and what else Python counts as such: numbers like \u00b2, \u00bd and \u2167, which are cut out of the words that have any.
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters in Spark's regular expressions, which training cuts words by.
SPARK_LETTERS = r"(\p{L}+)"
CACHE = 300_000


@dataclass
class Tables:
    langs: list[str] = field(default_factory=list)
    #: Row of ``logs`` of each word, and of each n-gram by length less 1.
    words: dict[str, int] = field(default_factory=dict)
    grams: list[dict[str, int]] = field(default_factory=list)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))


def letters_only(token: str) -> list[str]:
    """Runs of letters (categories L) of a token."""
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


def train(docs: DataFrame, *, train_docs: int = TRAIN_DOCS) -> Tables:
    """``docs(doc_id, text, lang)`` -> tables of log relative frequencies.

    Learns from rows that have an id, a text and a lang and aren't held out,
    from at most about ``train_docs`` of them. Counts are aggregated on the
    executors; the tables of this bounded sample come to the driver. An empty table teaches nothing.
    """
    own = docs.where((fold("doc_id", FOLDS) != 1) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    own = materialize(bounded(own, "doc_id", train_docs).select("text", "lang"), "lang-labelled")
    langs = sorted(r[0] for r in own.select("lang").distinct().collect())
    if not langs:
        return Tables()
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(SPARK_LETTERS), F.lit(1))).alias("term")
    counts = materialize(own.select("lang", word).groupBy("term", "lang").agg(F.count("*").alias("n")), "lang-words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}

    logs: list[np.ndarray] = []

    def table(rows: DataFrame) -> dict[str, int]:
        spread = rows.groupBy("term").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(langs)))
        got = spread.orderBy("term").toPandas()
        n = got.iloc[:, 2:].to_numpy(float)
        v = np.log(n / np.maximum(n.sum(axis=0), 1) + 0.5 / max(n.sum(), 1))
        at = sum(map(len, logs))
        logs.append(v - v.mean(axis=1, keepdims=True))
        return dict(zip(got["term"], range(at, at + len(got)), strict=True))

    words = table(counts)
    padded = F.concat(F.lit(" "), "term", F.lit(" "))
    grams = []
    for k in range(1, LONGEST + 1):
        each = F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - (k - 1)), _gram(padded, k)))
        rows = counts.where(F.length(padded) >= k).select("lang", "n", each.alias("term")).groupBy("term", "lang").agg(F.sum("n").alias("n"))
        grams.append(table(rows))
    prior = np.array([math.log(totals.get(k, 0) + 1.0) for k in langs])
    return Tables(langs, words, grams, np.vstack(logs), prior - np.logaddexp.reduce(prior))


def _gram(padded, k: int):
    return lambda i: F.substring(padded, i, F.lit(k))


class Scorer:
    """Scores texts; what it knows of words is kept in a bounded cache."""

    def __init__(self, tables: Tables, limit: int = CACHE):
        self.t, self.limit = tables, limit
        self.number: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(tables.langs)))
        # An n-gram weighs by its length: each shorter one has BACKOFF of the next longer one's weight.
        self.scaled = tables.logs.copy() if tables.langs else np.zeros((0, 0))
        for k, grams in enumerate(tables.grams, 1):
            self.scaled[list(grams.values())] *= 2 * BACKOFF ** (LONGEST - k)

    def learn(self, words: list[str]) -> None:
        """Log scores of each language, less the languages' mean: a word has a say by
        how it tells them apart."""
        size = len(self.number)
        while size + len(words) > len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
        known, unseen = self.t.words, []
        for w in words:
            at = self.number[w] = len(self.number)
            if w in known:
                self.matrix[at] = self.t.logs[known[w]]
            else:
                unseen.append((at, w))
        if not unseen:
            return
        rows, found, starts = [], [], []
        for at, w in unseen:
            got = self.backoff(w)
            if got:
                rows.append((at, len(w) + 2))
                starts.append(len(found))
                found += got
            else:
                self.matrix[at] = 0.0
        if rows:
            at, places = np.array(rows).T
            self.matrix[at] = np.add.reduceat(self.scaled[found], starts, axis=0) / places[:, None]

    def backoff(self, word: str) -> list[int]:
        """At each place of the word, the longest known n-gram that starts there."""
        padded, out = f" {word} ", []
        longest = self.t.grams[::-1]
        for i in range(len(padded)):
            for k, grams in zip(range(LONGEST, 0, -1), longest, strict=True):
                found = grams.get(padded[i : i + k])
                if found is not None:
                    out.append(found)
                    break
        return out

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.t.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.number) > self.limit:
            self.number.clear()
        split = [LETTERS.findall(t.lower()) for t in texts]
        odd = {w for w in set().union(*split).difference(self.number) if not w.isalpha()}
        if odd:
            split = [[x for w in words for x in (letters_only(w) if w in odd else (w,))] for words in split]
        self.learn(list(set().union(*split).difference(self.number)))
        get, out = self.number.__getitem__, []
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.matrix[np.fromiter(map(get, words), "i8", len(words))].sum(axis=0)
            z = total / math.sqrt(len(words)) + self.t.prior
            p = np.exp(z - np.logaddexp.reduce(z))
            best = int(p.argmax())
            out.append((self.t.langs[best], float(min(1.0, p[best]))))
        return out


def identify(docs: DataFrame, tables: Tables) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, lang_pred, score)``, a row per row.

    A text that is null or has no letters is ``und`` with score 0, as is every
    text where there was nothing to learn from. Among equal languages the first
    by name wins. Whole texts count, however long. Repeated rows are scored alike and a null id
    stays null; other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = scorer.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 1).alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
