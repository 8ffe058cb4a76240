"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over the statistics. Its covariance is shrunk towards the pooled covariance and
towards its own diagonal. A document's score is the posterior of label 1: the difference of the two log
densities (half Mahalanobis distances by cached Cholesky factors, half log determinants) plus the log prior
ratio. Class moments are summed in Spark over all labelled training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import by_size, release_encoders
from .common import col, fold, texts, written

STATISTICS = ("repeated_neighbour", "distinct", "frequent_word", "upper_words", "exclamation", "bars",
              "symbols", "digits", "stops", "word_length", "non_letters")
SYMBOLS = "#$%&*+=<>@^_~\\/{}[]"
#: Words of ordinary text that are added to each ratio, so that the ratios of short texts do not scatter.
PSEUDO = 10


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, already transformed.

    Ratios are smoothed by ``PSEUDO`` ordinary words, then taken as square roots, so that each class is
    closer to a Gaussian at any length. An empty text has the statistics of the ordinary words alone.
    """
    words = text.split()
    n = len(words)
    count: dict[str, int] = {}
    repeated, before = 0, None
    for w in words:
        if w == before:
            repeated += 1
        count[w] = count.get(w, 0) + 1
        before = w
    chars = sum(map(len, words)) + 5 * PSEUDO
    m = n + PSEUDO
    odd = n - sum(map(str.isalpha, words))
    return [(repeated / m) ** 0.5, np.log(len(count) + PSEUDO) / np.log(m), ((max(count.values(), default=0)) / m) ** 0.5,
            (sum(map(str.isupper, words)) / m) ** 0.5, (text.count("!") / chars) ** 0.5, (text.count("|") / chars) ** 0.5,
            (sum(map(text.count, SYMBOLS)) / chars) ** 0.5, (sum(map(text.count, "0123456789")) / chars) ** 0.5,
            ((text.count(".") + text.count(",") + 0.15 * PSEUDO) / m) ** 0.5, np.log(chars / m),
            ((odd + 0.15 * PSEUDO) / m) ** 0.5]


def statistics_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of every row."""
    def run(batches):
        release_encoders()
        for batch in by_size(batches, max_bytes=1 << 20):
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])
    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """``means``, inverse Cholesky factors and log determinants of both classes; the log prior ratio.
    With labels of one class only (or none), every score is ``constant``."""
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_determinants: list[float]
    log_prior: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, factor, log_determinant in zip(self.means, self.factors, self.log_determinants):
            z = (x - mean) @ factor.T
            density.append(-0.5 * ((z * z).sum(axis=1) + log_determinant))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_prior, -700, 700)))


def class_moments(rows: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Sums over ``rows`` (label, x) of the outer products of (1, x), for each class."""
    def run(batches):
        total = {}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, size)
            x = np.hstack([np.ones((len(x), 1)), x])
            label = batch.column("label").to_numpy()
            for c in np.unique(label):
                part = x[label == c]
                total[int(c)] = total.get(int(c), 0) + part.T @ part
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()),
                                              pa.array(m.ravel())], ["label", "cell", "value"])
    sums = rows.select("label", "x").mapInArrow(run, "label int, cell int, value double").groupBy("label", "cell").agg(
        F.sum("value").alias("value"))
    moments: dict[int, np.ndarray] = {}
    for r in sums.collect():  # two classes of (size + 1) ** 2 sums
        moments.setdefault(r["label"], np.zeros((size + 1) ** 2))[r["cell"]] = r["value"]
    return {c: m.reshape(size + 1, size + 1) for c, m in moments.items()}


def fit_discriminant(moments: dict[int, np.ndarray], to_pooled: float = 0.3, to_diagonal: float = 0.2,
                     floor: float = 1e-3) -> Discriminant:
    """``to_pooled``, ``to_diagonal``: shrinkage weights; ``floor``: least variance of a statistic."""
    if set(moments) != {0, 1}:
        return Discriminant([], [], [], 0.0, float(next(iter(moments))) if len(moments) == 1 else 0.5)
    number = {c: m[0, 0] for c, m in moments.items()}
    mean = {c: m[0, 1:] / m[0, 0] for c, m in moments.items()}
    spread = {c: m[1:, 1:] / number[c] - np.outer(mean[c], mean[c]) for c, m in moments.items()}
    pooled = sum(number[c] * spread[c] for c in (0, 1)) / (number[0] + number[1])
    means, factors, logs = [], [], []
    for c in (0, 1):
        s = (1 - to_pooled) * spread[c] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + floor * np.eye(len(s))
        lower = np.linalg.cholesky(s)
        means.append(mean[c])
        factors.append(np.linalg.inv(lower))
        logs.append(2 * float(np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, logs, float(np.log(number[1] / number[0])))


def labelled(rows: DataFrame, labels: DataFrame, label_col: str, folds: int = 5, id_col: str = "doc_id") -> DataFrame:
    """``rows`` whose id has one label, training folds only. Null labels, null ids and ids labelled both ways
    are left out; repeated labels count once."""
    known = (labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("label"))
             .filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other"))
    return rows.join(known, "doc_id").filter(fold("doc_id", folds) != 0)


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5) -> Discriminant:
    """The model of the labelled training rows of ``rows`` (a statistics table)."""
    return fit_discriminant(class_moments(labelled(rows, labels, label_col, folds), len(STATISTICS)))


def keep_good(df: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, folds: int = 5,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``, all columns unchanged. The labels meet the statistics,
    not the texts; each row is then scored by its own text, so repeated and null ids need no care. A null text scores as
    an empty one, a text is read whole, however long; equal texts score alike, so there are no ties to settle. An empty
    table stays empty."""
    rows = written(statistics_table(df, id_col, text_col), "quality-statistics")
    model = fit(rows, labels, label_col, folds)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        release_encoders()
        batch = pa.RecordBatch.from_arrays([text.fill_null("")], ["text"])
        x = [[statistics(t) for t in part.column("text").to_pylist()] for part in by_size([batch], max_bytes=1 << 20)]
        return pa.array(np.concatenate([model.scores(np.array(part)) for part in x] or [np.zeros(0)]))
    return df.filter(score(col(text_col).cast("string")) >= threshold)


def quality_scores(df: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3,
                   folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, score (posterior of label 1), predicted (score >= threshold).

    Trained on all labelled rows outside fold 0 (crc32 of the id as text, modulo ``folds``). Null texts count
    as empty and are scored like any text. A null id counts as the empty text in the fold. Repeated rows
    repeat; an empty table gives no rows; other columns of either table are not read. A text is read whole, however long;
    equal texts score alike, so there are no ties to settle.
    """
    rows = written(statistics_table(df, id_col, text_col), "quality-statistics")
    model = fit(rows, labels, label_col, folds)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
