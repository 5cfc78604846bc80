"""Quality rules: robust multivariate outliers per language and source.

Base rules reject short and repetitive documents. The rest is judged by the minimum covariance
determinant (MCD) of its ``(lang, source)`` group: concentration steps run from several starts (the
coordinate-wise medians, all rows, and rows drawn by a hash), keep the ``h`` share of rows with the smallest
Mahalanobis distances and re-estimate mean and covariance until ``steps`` are done; the start with the smallest
determinant stands for the group. A document is rejected when its squared distance exceeds the chi-square
quantile ``quantile``. Concentrated rows understate the spread: where the group's median is above the chi-square
median of the statistics that vary in the group, distances are scaled down to it. They are never scaled up, since equal
rows may hold the median at nothing.

Every step is a grouped aggregate with map-side partial sums (one third of the rows in a group is no
problem); a group's state is one row, sent to the tasks while the counted groups are within a bound. The covariance of a group is shrunk to that of all rows with the
weight of ``shrink_rows`` rows, so that a group with few or equal rows has a defined verdict.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small
from .textstats import base_counts

FEATURES = ("log_words", "word_length", "symbol_rate", "line_rate", "repeat_rate", "distinct_rate")
P = len(FEATURES)
#: Medians of the chi-square distributions with 0 to P degrees of freedom (fixed values).
CHI2_MEDIANS = (0.0, 0.455, 1.386, 2.366, 3.357, 4.351, 5.348)
#: Smallest standard deviation that a statistic is taken to have, in the units of its transform: it replaces a smaller
#: one and is added to none. Symbols, repeated lines and repeated words are 0 in most texts; there, one
#: occurrence in a text of 50 words stays within the cutoff (4.74 deviations).
FLOOR = np.array([0.05, 0.05, 0.25, 0.4, 0.08, 0.02])
#: Starts of the concentration steps, and the share of rows (one in) that a drawn start has.
STARTS, DRAWN = 4, 16

_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                       + [T.StructField("v", T.ArrayType(T.DoubleType()))])


def chi2_quantile(p: float) -> float:
    """Quantile of the chi-square distribution with P = 6 degrees of freedom, from its closed form."""
    lo, hi = 0.0, 1.0
    above = lambda x: math.exp(-x / 2) * (1 + x / 2 + x * x / 8)
    while above(hi) > 1 - p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > 1 - p else (lo, mid)
    return hi


def _transform(c: dict) -> np.ndarray:
    n, chars = np.maximum(c["n_words"], 1).astype(float), np.maximum(c["word_chars"], 1).astype(float)
    return np.column_stack([
        np.log1p(c["n_words"]), chars / n, np.log(c["n_symbols"] / chars + 0.002),
        np.log(c["n_dup_lines"] / (n / 20 + 1) + 0.05), np.sqrt(c["n_repeat_words"] / n),
        np.log((c["n_distinct"] + 1) / (n + 1)) + 0.1 * np.log(n),
    ])


@F.arrow_udf(_SCHEMA)
def _stats(texts: pa.Array) -> pa.Array:
    c = base_counts(texts)
    v = _transform(c)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, P, dtype=np.int32)), pa.array(v.ravel()))
    names = [f.name for f in _SCHEMA.fields[:-1]]
    return pa.StructArray.from_arrays([pa.array(c[k]) for k in names] + [flat], names + ["v"])


def document_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts, ``base_failed`` and the transformed vector ``v`` to the columns of ``docs``."""
    s = docs.withColumn("_s", _stats(F.col(text_col)))
    names = [f.name for f in _SCHEMA.fields]
    return s.select(*docs.columns, *[F.col(f"_s.{n}").alias(n) for n in names]).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@F.arrow_udf(T.StructType([T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("icov", T.ArrayType(T.DoubleType())),
                           T.StructField("logdet", T.DoubleType()), T.StructField("free", T.IntegerType())]))
def _solve(n: pa.Array, s: pa.Array, all_n: pa.Array, all_s: pa.Array, shrink: pa.Array) -> pa.Array:
    """Mean, inverse covariance and log determinant from the sums of a group, shrunk to the covariance of all rows;
    ``free`` statistics vary by more than their floor."""
    n, all_n = n.to_numpy(zero_copy_only=False).astype(float), all_n.to_numpy(zero_copy_only=False).astype(float)
    s = np.array(s.to_pylist(), float).reshape(len(n), -1)
    g = np.array(all_s.to_pylist(), float).reshape(len(n), -1)
    m = shrink.to_numpy(zero_copy_only=False).astype(float)
    iu = np.triu_indices(P)

    def moments(k, t):
        k = np.maximum(k, 1)[:, None]
        mean = t[:, :P] / k
        cov = np.zeros((len(t), P, P))
        cov[:, iu[0], iu[1]] = t[:, P:] / k
        cov = cov + np.triu(cov, 1).transpose(0, 2, 1)
        return mean, cov - mean[:, :, None] * mean[:, None, :]

    mean, cov = moments(n, s)
    gmean, gcov = moments(all_n, g)
    w = (n / (n + m))[:, None]
    mean = w * mean + (1 - w) * gmean
    cov = w[:, :, None] * cov + (1 - w)[:, :, None] * gcov
    i = np.arange(P)
    free = (cov[:, i, i] > FLOOR ** 2).sum(1)
    cov[:, i, i] = np.maximum(cov[:, i, i], FLOOR ** 2) + 1e-3 * FLOOR ** 2
    icov = np.linalg.inv(cov).reshape(len(n), -1)
    as_list = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
    return pa.StructArray.from_arrays([as_list(mean), as_list(icov), pa.array(np.linalg.slogdet(cov)[1]), pa.array(free, pa.int32())],
                                       ["mean", "icov", "logdet", "free"])


@F.arrow_udf(T.DoubleType())
def _distance(v: pa.Array, mean: pa.Array, icov: pa.Array) -> pa.Array:
    if len(v) == 0:
        return pa.array([], pa.float64())
    rows = lambda a: a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
    x = rows(v) - rows(mean)
    return pa.array(np.einsum("ni,nij,nj->n", x, rows(icov).reshape(-1, P, P), x))


_SUMS = [("s", i, None) for i in range(P)] + [("s", i, j) for i, j in zip(*np.triu_indices(P), strict=True)]


def _moments(rows: DataFrame) -> DataFrame:
    """Per group and start: number of rows and the sums of the statistics and of their products, as one array."""
    x = [F.col("v")[i] for i in range(P)]
    sums = [F.sum(x[int(i)] if j is None else x[int(i)] * x[int(j)]) for _, i, j in _SUMS]
    return rows.groupBy("g", "start").agg(F.count("*").alias("n"), F.array(*sums).alias("s"))


def _estimate(rows: DataFrame, shrink_rows: int) -> DataFrame:
    """One row ``(g, start, mean, icov, logdet, free)`` per group and start; materialised, so later steps read a small table."""
    m = materialize(_moments(rows), "mcd-sums")
    # the total of all groups is one row of 27 sums a start
    tot = m.groupBy("start").agg(F.sum("n").alias("all_n"), F.array(*[F.sum(F.col("s")[i]) for i in range(len(_SUMS))]).alias("all_s"))
    e = m.join(F.broadcast(tot), "start").withColumn("e", _solve("n", "s", F.col("all_n").cast("double"), "all_s", F.lit(float(shrink_rows))))
    return materialize(e.select("g", "start", "e.*"), "mcd-estimate")


def robust_outliers(stats: DataFrame, group_cols: list[str], id_cols: list[str], h: float = 0.75, steps: int = 3, quantile: float = 0.999,
                    shrink_rows: int = 200) -> DataFrame:
    """``stats`` (rows with ``v`` and ``base_failed``) plus ``distance`` (scaled, squared) and ``kept``.

    NULL in a group column is a value of its own. Rows that fail the base rules take no part in the
    estimates, have a NULL distance and are not kept. ``h`` is the share of rows a concentration step keeps, ``quantile``
    the share of normally distributed rows that are kept."""
    keyed = stats.withColumn("g", F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(group_cols)])))
    clean = keyed.filter(~F.col("base_failed")).select("g", "v")
    # start 0: coordinate-wise medians and interquartile ranges (mergeable sketches), as a diagonal metric
    q = clean.groupBy("g").agg(*[F.percentile_approx(F.col("v")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)])
    scale = [F.pow(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / F.lit(1.349), F.lit(float(FLOOR[i]))), -2) for i in range(P)]
    diag = [scale[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)]
    medians = q.select("g", F.lit(0).alias("start"), F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("mean"), F.array(*diag).alias("icov"),
                       F.lit(0.0).alias("logdet"), F.lit(P).alias("free"))
    # start 1: all rows; the others: rows drawn by a hash
    drawn = F.pmod(F.xxhash64("v"), F.lit(DRAWN)).cast("int") + 2
    others = clean.select("g", "v", F.explode(F.array(F.lit(1), drawn)).alias("start")).filter(F.col("start") < STARTS)
    est = materialize(medians.unionByName(_estimate(others, shrink_rows)), "mcd-start")
    for _ in range(steps):
        d = clean.join(small(est), "g").withColumn("d", _distance("v", "mean", "icov")).select("g", "start", "v", "d")
        cut = materialize(d.groupBy("g", "start").agg(F.percentile_approx("d", h, 2000).alias("cut")), "mcd-cut")
        est = _estimate(d.join(small(cut), ["g", "start"]).filter("d <= cut"), shrink_rows)
    best = est.groupBy("g").agg(F.min(F.struct("logdet", "start", "mean", "icov", "free")).alias("b"))
    est = materialize(best.select("g", "b.mean", "b.icov", "b.free"), "mcd-best")
    d = keyed.join(small(est), "g", "left").withColumn("d", F.when(F.col("mean").isNotNull() & ~F.col("base_failed"), _distance(
        "v", F.coalesce("mean", "v"), F.coalesce("icov", F.array_repeat(F.lit(0.0), P * P)))))
    med = materialize(d.filter("d is not null").groupBy("g").agg(F.percentile_approx("d", 0.5, 2000).alias("med")), "mcd-median")
    middle = F.array(*[F.lit(x) for x in CHI2_MEDIANS])[F.col("free")]
    out = d.join(small(med), "g", "left").withColumn("distance", F.when((F.col("free") > 0) & (F.col("med") > middle), F.col("d") * middle / F.col("med")).otherwise(F.col("d")))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.lit(chi2_quantile(quantile)), F.lit(True))) \
        .select(*id_cols, *[c for c in stats.columns if c not in {*id_cols, *group_cols, "v"}], "distance", "kept")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  **params) -> DataFrame:
    """Per document: id, base counts, ``base_failed``, ``distance``, ``kept``. The texts are read once; the
    steps work on the materialised statistics."""
    stats = document_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                       F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))).drop("text")
    return robust_outliers(materialize(stats, "quality-stats"), ["lang", "source"], ["doc_id"], **params)
