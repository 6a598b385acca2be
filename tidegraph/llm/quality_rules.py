"""Quality rules with line sequence labelling.

Fixed rules look at the words of a text. A linear-chain conditional random field
then labels its lines as content or boilerplate by Viterbi decoding, and the
share of content decides whether the document is kept. Only documents have labels;
those of their lines are latent while the field is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded, documents, labels
from tidegraph.llm.textstats import LINE_FEATURES, base_counts, lines_of

#: Labelled documents that the field is fitted on, at most (about; a hash of ids chooses), and their bytes.
TRAIN_DOCS, TRAIN_BYTES = 3000, 48 << 20
MIN_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


class Chain:
    """Linear-chain CRF with labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        # Without training, symbols and repeated lines speak against content.
        default = np.zeros((LINE_FEATURES, 2))
        default[0, 1], default[5, 1], default[11, 1] = 1.0, -4.0, -2.0
        self.weights = default if weights is None else weights
        self.moves = np.array([[0.5, -0.5], [-0.5, 0.5]]) if moves is None else moves

    @staticmethod
    def _steps(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Texts by falling number of lines, and at each step those that have a line there."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        top = int(n.max(initial=0))
        at_least = np.searchsorted(-n[order], -np.arange(1, top + 1), side="right")
        return order, [order[:k] for k in at_least]

    def _sums(self, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over all labellings of the lines before (with the line) and after each line, and of all."""
        m = self.moves
        _, steps = self._steps(first)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        for t, own in enumerate(steps):
            at = first[own] + t
            ahead[at] = score[at] if t == 0 else score[at] + np.logaddexp(ahead[at - 1, :1] + m[0], ahead[at - 1, 1:] + m[1])
        for t in range(len(steps) - 2, -1, -1):
            at = first[steps[t + 1]] + t
            nxt = score[at + 1] + back[at + 1]
            back[at] = np.logaddexp(nxt[:, :1] + m[:, 0], nxt[:, 1:] + m[:, 1])
        return ahead, back, np.logaddexp(*(ahead + back).T)

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that each line is content."""
        ahead, back, total = self._sums(x @ self.weights, first)
        return np.exp((ahead + back)[:, 1] - total)

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 150, rate: float = 0.15, ridge: float = 1e-3, linked: bool = True) -> Chain:
        """Adam on the mean log likelihood of the lines' labels; ``weight``: of each text; ``linked``: with transitions."""
        w, m = np.zeros((LINE_FEATURES, 2)), np.zeros((2, 2))
        if len(np.unique(y)) < 2:
            return self
        onehot = np.eye(2)[y]
        seen = np.zeros((2, 2))
        inner = np.ones(len(y), bool)
        inner[first[:-1]] = False
        v = np.repeat(np.ones(len(first) - 1) if weight is None else weight, np.diff(first))
        v /= v.sum()
        np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), v[1:][inner[1:]])
        mass = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(m), np.zeros_like(m)]]
        for k in range(1, rounds + 1):
            score = x @ w
            ahead, back, total = Chain(w, m)._sums(score, first)
            p = np.exp(ahead + back - total[:, None])
            g = [x.T @ ((onehot - p) * v[:, None]) - ridge * w, None]
            i = np.flatnonzero(inner)
            pair = np.exp(ahead[i - 1, :, None] + m[None] + (score[i] + back[i])[:, None, :] - total[i, None, None]) if len(i) else np.zeros((0, 2, 2))
            g[1] = seen - (pair * v[i, None, None]).sum(axis=0) - ridge * m
            for param, grad, (a, b) in ((w, g[0], mass[0]), (m, g[1], mass[1]))[: 1 + linked]:
                a += 0.1 * (grad - a)
                b += 0.01 * (grad**2 - b)
                param += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
        return Chain(w, m)

    def fit_latent(self, x: np.ndarray, size: np.ndarray, first: np.ndarray, quality: np.ndarray, *, min_share: float = MIN_SHARE) -> Chain:
        """Fit where only whole texts are labelled: which lines are content is latent.

        A first field without transitions takes each text's label for its lines, and so learns how
        lines of both kinds of texts look. Lines then take the likelier label of that field, as far as
        their text's label allows: texts of quality 1 have a content share of ``min_share`` at least,
        others less, and the lines nearest to the other label give way. The field with transitions is fitted on
        those. (Labelling and fitting in further turns drifts to one label for all lines of a text.)
        """
        y = np.repeat(quality, np.diff(first))
        if len(np.unique(y)) < 2:
            return self
        # Both kinds of texts weigh the same in all.
        weight = np.where(quality == 1, 1 / (quality == 1).sum(), 1 / (quality == 0).sum())
        looks = self.fit(x, first, y, weight, linked=False)
        return self.fit(x, first, allowed(looks.marginals(x, first), size, first, quality, min_share), weight)

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels of all lines, text by text (in step, for many texts at once)."""
        score = x @ self.weights
        best, came = score.copy(), np.zeros(score.shape, "i1")
        _, steps = self._steps(first)
        for t, own in enumerate(steps[1:], 1):
            at = first[own] + t
            ways = best[at - 1][:, :, None] + self.moves[None]
            came[at] = ways.argmax(axis=1)
            best[at] += ways.max(axis=1)
        out = np.zeros(len(score), "i1")
        last = first[1:] - 1
        out[last] = best[last].argmax(axis=1)
        for t in range(len(steps) - 1, 0, -1):
            at = first[steps[t]] + t
            out[at - 1] = came[at, out[at]]
        return out


def allowed(p: np.ndarray, size: np.ndarray, first: np.ndarray, quality: np.ndarray, min_share: float = MIN_SHARE) -> np.ndarray:
    """Labels of lines by their probabilities, changed where the text's label forbids the share of content.

    The lines that change are those nearest to the other label, no more than are needed.
    """
    y = (p > 0.5).astype("i8")
    for k, (lo, hi) in enumerate(zip(first, first[1:], strict=False)):
        own, n = slice(lo, hi), size[lo:hi]
        share = n @ y[own] / max(n.sum(), 1)
        if quality[k] == (share >= min_share):
            continue
        for i in np.argsort(-p[own] if quality[k] else p[own], kind="stable"):
            if y[lo + i] != quality[k]:
                y[lo + i] = quality[k]
                if quality[k] == (n @ y[own] / max(n.sum(), 1) >= min_share):
                    break
    return y


def train(docs: DataFrame, marks: DataFrame, *, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, min_share: float = MIN_SHARE) -> Chain:
    """Fit the field on at most about ``train_docs`` labelled documents of ``train_bytes`` together.

    A hash of ids chooses them, whole texts all: one that passes what is left of the bytes is not
    among them. Null ids, texts and labels teach nothing. With no labelled text, or with one
    label alone, the field keeps its default weights.
    """
    marked = marks.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__q")).dropDuplicates(["__id"])
    marked = bounded(marked, "__id", train_docs)
    texts = docs.where("text is not null").select(F.col("doc_id").alias("__doc"), F.col("text").cast("string").alias("__text")).dropDuplicates(["__doc", "__text"])
    rows = texts.join(F.broadcast(marked), F.col("__doc") == F.col("__id")).select(F.xxhash64("__doc", "__text").alias("__at"), "__q", "__text")
    chosen, left = [], train_bytes
    for r in rows.select("__at", F.octet_length("__text").alias("n")).orderBy("__at", "n").collect():  # two numbers for each
        if r["n"] <= left:
            chosen.append((r["__at"],))
            left -= r["n"]
    if not chosen:
        return Chain()
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "__at long"))
    got = [(r["__text"].encode(), r["__q"]) for r in rows.join(ids, "__at", "left_semi").orderBy("__at", "__text").collect()]
    x, first = lines_of([t for t, _ in got])
    return Chain().fit_latent(x[:, :LINE_FEATURES], x[:, -1], first, np.array([q for _, q in got]), min_share=min_share)


def quality_rules(docs: DataFrame, chain: Chain, *, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs(doc_id, text)`` -> a row per row: ``doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share``.

    Null and empty texts have no words: they fail the rules, with share 0. The
    share is that of bytes that aren't white space in content lines. Whole texts count, however long.
    Repeated rows and ties of ids are judged alike; a null id stays null; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                counts = np.array([base_counts(t) for t in texts], "i8")
                x, first = lines_of([t.encode() for t in texts])
                content = chain.decode(x[:, :LINE_FEATURES], first)
                size = np.add.reduceat(x[:, -1], first[:-1])
                share = np.add.reduceat(x[:, -1] * content, first[:-1]) / np.maximum(size, 1)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (share >= min_share)), pa.array(share)], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules(docs, train(docs, labels(spark, sf_dir)))
