"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Per class the mean and the covariance of the transformed statistics are aggregated over **all** labelled
training rows (sums only, so nothing grows with the data). Each covariance is shrunk to the pooled one
(``alpha``) and to its diagonal (``gamma``); the Cholesky factors are computed once and shipped with the
model. The score is the logistic function of the Mahalanobis log-density difference plus the log prior."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_remainder, label_rows, labelled_sample, materialize
from .textstats import SHAPE, shape_vector

P = len(SHAPE)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pa.Array) -> pa.Array:
    """The transformed statistics of a text as an array column."""
    v = shape_vector(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, P, dtype=np.int32)), pa.array(v.ravel()))


@dataclass
class QuadraticDiscriminant:
    """Class means, lower Cholesky factors of the class covariances and log priors (classes 0 and 1)."""
    means: np.ndarray
    factors: np.ndarray
    log_priors: np.ndarray
    temperature: float = 2.0

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
        return -0.5 * (z ** 2).sum(0) - np.log(np.diag(self.factors[k])).sum() + self.log_priors[k]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(x) == 0:
            return np.zeros(0)
        d = (self.log_density(x, 1) - self.log_density(x, 0)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def class_sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per class the count, sums and product sums over all rows ``(_y, v)``: 1 + P + P(P+1)/2 numbers."""
    x = [F.col("v")[i] for i in range(P)]
    iu = list(zip(*np.triu_indices(P), strict=True))
    got = rows.groupBy("_y").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"),
                                 F.array(*[F.sum(x[int(i)] * x[int(j)]) for i, j in iu]).alias("p"))
    return {r["_y"]: np.array([r["n"], *r["s"], *r["p"]]) for r in got.filter("_y in (0, 1)").collect()}


def fit(rows: DataFrame, alpha: float = 0.1, gamma: float = 0.05, floor: float = 1e-2, temperature: float = 2.0) -> QuadraticDiscriminant:
    """Model from rows ``(_y, v)``. A class without rows gets the other's moments and a prior of one
    row, without any row both classes are equal (score 0.5)."""
    sums = class_sums(rows)
    blank = np.zeros(1 + P + P * (P + 1) // 2)
    iu = np.triu_indices(P)

    def moments(t):
        n = max(t[0], 1)
        mean, cov = t[1:P + 1] / n, np.zeros((P, P))
        cov[iu] = t[P + 1:] / n
        cov = cov + np.triu(cov, 1).T
        return mean, cov - np.outer(mean, mean)

    n = np.array([sums.get(k, blank)[0] for k in (0, 1)])
    both = sums.get(0, blank) + sums.get(1, blank)
    own = [moments(sums[k] if n[k] else both) for k in (0, 1)]
    pooled = sum(max(n[k], 1) * own[k][1] for k in (0, 1)) / np.maximum(n, 1).sum()
    factors = []
    for k in (0, 1):
        c = (1 - alpha) * own[k][1] + alpha * pooled
        c = (1 - gamma) * c + gamma * np.diag(np.diag(c)) + floor * np.eye(P)
        factors.append(np.linalg.cholesky(c))
    return QuadraticDiscriminant(np.array([m for m, _ in own]), np.array(factors), np.log((n + 1) / (n.sum() + 2)), temperature)


def scorer(model: QuadraticDiscriminant):
    """Column function: statistics array -> score."""
    @F.arrow_udf(T.DoubleType())
    def score(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, P))
        return pa.array(model.score(x))
    return score


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str, label: str, mod: int, held: int) -> DataFrame:
    """Labelled rows whose id remainder is not the held-out one."""
    y = label_rows(labels, id_col, label)
    return stats.filter(id_remainder("doc_id", mod) != held).join(y, F.col("doc_id") == F.col("_lid")).select("_y", "v")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
                   mod: int = 4, held: int = 2, threshold: float = 0.7, **params) -> DataFrame:
    """Per document: id, ``held_out``, ``score``, ``predicted``. Texts are read once; fit and scores use the
    materialised statistics.

    One row per input row: repeated rows have equal scores; a NULL text counts as an empty one, a NULL id has the remainder of
    the empty text and no label. Very long texts are read whole. A repeated id with a label trains once per row; of
    conflicting labels the larger counts, NULL labels and ids are left out. Without labels every score is 0.5. An empty table gives no row;
    only the id and the text are read, so other columns may have any name."""
    v = materialize(docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("v")), "quality-vectors")
    model = fit(training_rows(v, labels, id_col, label, mod, held), **params)
    return v.select("doc_id", (id_remainder("doc_id", mod) == held).alias("held_out"), scorer(model)("v").alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
              mod: int = 4, held: int = 2, threshold: float = 0.7, **params) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold. The fit reads at most
    ``common.FIT_ROWS`` labelled rows, drawn by a hash of the id; texts are never shuffled.

    Nulls, repeated rows and labels count as in ``quality_scores``; repeated rows stay or go together."""
    y = labelled_sample(labels, id_col, label, mod, held)
    own = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(y, F.col("_i") == F.col("_lid")).select("_y", statistics("_t").alias("v"))
    model = fit(own, **params)
    cols = docs.columns
    return docs.filter(_score_text(model, F.col(text_col)) >= threshold).select(*cols)


def _score_text(model: QuadraticDiscriminant, text: Column) -> Column:
    return scorer(model)(statistics(text))
