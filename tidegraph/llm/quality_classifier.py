"""Quality classifier: regularised quadratic discriminant analysis.

Each class has a mean and a covariance, shrunk towards the pooled one and its
diagonal, over transformed statistics of whole texts. The score is the
difference of the classes' log densities, by Mahalanobis distances through
Cholesky factors that are computed once, calibrated to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import documents, fold, labels, materialize
from tidegraph.llm.textstats import STATISTICS, document_statistics

FOLDS = 5
#: Shares of the pooled covariance and of the diagonal in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
THRESHOLD = 0.3


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor, log determinant; then
    slope and offset that turn a difference into log odds."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        d = [((x - self.mean[c]) @ self.whiten[c].T) for c in (0, 1)]
        log = [self.prior[c] - 0.5 * (d[c] ** 2).sum(axis=1) - 0.5 * self.log_det[c] for c in (0, 1)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * np.arcsinh(self.difference(x) / 4) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, has_words, x)``, a row per row; zeros for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                x = [document_statistics(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bool(t.strip()) for t in texts]), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "has_words", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, has_words boolean, x array<double>")


def _moments(rows: DataFrame) -> np.ndarray:
    """Per class: count, sums and sums of products, added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + STATISTICS + STATISTICS**2))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(total.tolist(), pa.list_(pa.float64()))[k : k + 1] for k in (0, 1)], names=["a", "b"])

    parts = rows.mapInArrow(run, "a array<double>, b array<double>")
    width = 1 + STATISTICS + STATISTICS**2
    sums = parts.select(*(F.sum(F.col(k)[i]).alias(f"{k}{i}") for k in "ab" for i in range(width))).first()
    return np.array([x or 0.0 for x in sums]).reshape(2, width)


def fit(rows: DataFrame) -> Discriminant:
    """``rows(y, x)``, all of them -> the model. A class that has no rows takes the
    pooled moments, or a standard normal where there are none at all."""
    m = _moments(rows)
    n, s, ss = m[:, 0], m[:, 1 : 1 + STATISTICS], m[:, 1 + STATISTICS :].reshape(2, STATISTICS, STATISTICS)
    all_n = n.sum()
    eye = np.eye(STATISTICS)
    center = s.sum(axis=0) / max(all_n, 1)
    pooled = ss.sum(axis=0) / max(all_n, 1) - np.outer(center, center) if all_n > 1 else eye
    means, whiten, dets = [], [], []
    for c in (0, 1):
        mean = s[c] / n[c] if n[c] else center
        cov = ss[c] / n[c] - np.outer(mean, mean) if n[c] > 1 else pooled
        cov = (1 - TO_POOLED) * cov + TO_POOLED * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + 1e-4 * eye
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        dets.append(2 * np.log(np.diag(factor)).sum())
    prior = np.log((n + 1) / (all_n + 2))
    return Discriminant(prior, np.array(means), np.array(whiten), np.array(dets))


def calibrate(model: Discriminant, rows: DataFrame, rounds: int = 12) -> Discriminant:
    """Logistic regression on the transformed difference, by Newton steps whose sums
    run over all rows on the executors."""
    diff = materialize(_differences(rows, model), "differences")
    a, b = 1.0, 0.0
    for _ in range(rounds):
        z = F.col("t") * a + b
        p = 1 / (1 + F.exp(-z))
        v = F.greatest(p * (1 - p), F.lit(1e-9))
        r = diff.agg(*(F.sum(e).alias(k) for k, e in {"ga": (F.col("y") - p) * F.col("t"), "gb": F.col("y") - p, "haa": v * F.col("t") ** 2, "hab": v * F.col("t"), "hbb": v}.items())).first()
        if r["hbb"] is None:
            return model
        h = np.array([[r["haa"] + 1e-3, r["hab"]], [r["hab"], r["hbb"] + 1e-3]])
        step = np.linalg.solve(h, np.array([r["ga"] - 1e-3 * a, r["gb"] - 1e-3 * b]))
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(a), float(b)
    return model


def _differences(rows: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.array(np.arcsinh(model.difference(x) / 4))], names=["y", "t"])

    return rows.mapInArrow(run, "y double, t double")


def classify(stats: DataFrame, model: Discriminant, *, threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` of ``statistics`` -> ``(doc_id, held_out, score, predicted)``, a row per row.

    A text without words (null, empty, white space) has score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            score = np.where(batch.column(1).to_numpy(zero_copy_only=False), model.score(x), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Fit on the labels (``marks(doc_id, quality)``) of all folds but the held out
    one, over all their documents, and score every row of ``docs``. Null, empty and blank texts score 0; whole
    texts count, however long. Repeated rows score alike; null ids have score but no label; other columns are
    ignored, whatever their names. An empty table of documents gives no rows; without labels the
    model is a standard normal for both classes."""
    stats = materialize(statistics(docs), "statistics")
    own = marks.where((fold("doc_id", FOLDS) != 0) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y")).dropDuplicates(["__id"])
    rows = materialize(stats.where("has_words").join(own, F.col("doc_id") == F.col("__id")).select("y", "x"), "labelled")
    return classify(stats, calibrate(fit(rows), rows))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))
