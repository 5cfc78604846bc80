"""Data profiling: null counts, describe, value counts, quantiles, histograms, vocabulary.

Everything but exact quantiles is a single aggregate (map-side partial aggregation, one small shuffle). Exact
quantiles are selected by rank: sketches bracket the rank, counts place it, and only the bracket's values are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def null_counts(df: DataFrame, stage: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n_rows")] + [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns]
    out = df.agg(*aggs)
    return out.select(F.lit(stage).alias("stage"), "*") if stage else out


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max -- one row per column."""
    df = materialize(df.select(*cols), "described")
    parts = []
    for c in cols:
        x = F.col(c)
        parts.append(df.agg(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"),
            *[F.lit(v).cast("double").alias(name) for name, v in zip(("p25", "p50", "p75"), exact_quantiles(df, x, (0.25, 0.5, 0.75)), strict=True)],
            F.max(x).cast("double").alias("max")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, unique, top (most frequent; ties: smallest value), freq -- one row per column."""
    parts = []
    for c in cols:
        vc = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        parts.append(vc.agg(
            F.lit(c).alias("column"), F.sum("n").alias("count"), F.count("*").alias("unique"),
            F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"), F.max("n").alias("freq")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_counts_topk(df: DataFrame, col, k: int = 10, name: str = "value") -> DataFrame:
    """Top-k values by count (ties: value ascending, NULLs first) -- a top-k report by design."""
    c = F.col(col) if isinstance(col, str) else col
    return df.groupBy(c.alias(name)).agg(F.count("*").alias("count")) \
        .orderBy(F.col("count").desc(), F.col(name).asc_nulls_first()).limit(k)


#: Rank error of a bracket (one in so many), and values of a bracket that the driver takes at most, with their counts.
RANK_PARTS, BRACKET = 10_000, 100_000


def _order_statistics(v: DataFrame, n: int, ranks: list[int]) -> dict[int, float]:
    """The values of these ranks (from 0) among the ``n`` doubles ``v``.

    One pass of mergeable sketches brackets every rank, one counts the values below and inside each bracket. Brackets with few values are read as
    value counts in a last pass; a bracket with many is narrowed by the same two passes over its values alone."""
    margin = 2.0 / RANK_PARTS
    at = [p for r in ranks for p in (max(0.0, (r + 0.5) / n - margin), min(1.0, (r + 0.5) / n + margin))]
    got = v.agg(F.percentile_approx("v", F.array(*map(F.lit, at)), RANK_PARTS).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    ends = {r: (got["lo"] if at[2 * i] == 0 else got["q"][2 * i], got["hi"] if at[2 * i + 1] == 1 else got["q"][2 * i + 1]) for i, r in enumerate(ranks)}
    x = F.col("v")
    found = v.agg(*[c for i, r in enumerate(ranks) for c in (F.count_if(x < ends[r][0]).alias(f"b{i}"), F.count_if(x.between(*ends[r])).alias(f"n{i}"))]).first()
    out, few = {}, []
    for i, r in enumerate(ranks):
        (a, b), below, inside = ends[r], found[f"b{i}"], found[f"n{i}"]
        if not below <= r < below + inside:  # the sketch erred: everything stands in the bracket
            a, b, below, inside = got["lo"], got["hi"], 0, n
        if a == b:
            out[r] = a
        elif inside <= BRACKET:
            few.append((r, a, b, below))
        else:
            mid = a + (b - a) / 2
            part = v.filter(x.between(a, b))
            if inside == n:  # no narrower than before: halve it by value
                low = part.filter(x <= mid).count()
                part, below, inside = (part.filter(x <= mid), below, low) if r - below < low else (part.filter(x > mid), below + low, inside - low)
            out[r] = _order_statistics(part, inside, [r - below])[r - below]
    if few:
        inside = F.lit(False)
        for _, a, b, _ in few:
            inside = inside | x.between(a, b)
        counts = v.filter(inside).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()  # bounded by the brackets
        for r, a, b, below in few:
            for c in counts:
                if a <= c["v"] <= b:
                    below += c["n"]
                    if r < below:
                        out[r] = c["v"]
                        break
    return out


def exact_quantiles(df: DataFrame, col, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, as ``percentile`` gives them, without a map of all values in one task. NULLs
    take no part; without values all are None."""
    v = df.select((F.col(col) if isinstance(col, str) else col).cast("double").alias("v")).filter("v is not null")
    n = v.count()
    if n == 0:
        return [None] * len(probs)
    places = [(n - 1) * p for p in probs]
    value = _order_statistics(v, n, sorted({int(k) for h in places for k in (math.floor(h), math.ceil(h))}))
    return [value[math.floor(h)] + (value[math.ceil(h)] - value[math.floor(h)]) * (h - math.floor(h)) for h in places]


def quantiles(df: DataFrame, col: str, probs: Sequence[float] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    names = [f"q{int(round(p * 100)):02d}" for p in probs]
    df = materialize(df.select(F.col(col).cast("double").alias(col)), "quantiles")
    return df.sparkSession.createDataFrame([tuple(exact_quantiles(df, col, probs))], ", ".join(f"{c} double" for c in names))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max, last bin closed; empty bins included.
    ``bin = least(floor((x - min) * bins / (max - min)), bins - 1)``; all rows of a constant
    column are in bin 0."""
    x = F.col(col).cast("double")
    mn = df.agg(F.min(x)).scalar()
    mx = df.agg(F.max(x)).scalar()
    at = F.floor((x - mn) * F.lit(float(bins)) / F.nullif(mx - mn, F.lit(0.0)))
    b = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", (mn + (mx - mn) * F.col("bin") / F.lit(float(bins))).alias("lower"),
        (mn + (mx - mn) * (F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"))


def missing_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null-pattern counts: the row x column null matrix summarised without losing information."""
    return df.groupBy(*[F.col(c).isNull().alias(f"{c}_null") for c in cols]).agg(F.count("*").alias("n_rows"))


def vocab_size(df: DataFrame, tokens) -> DataFrame:
    return df.select(F.explode(tokens).alias("t")).agg(F.count_distinct("t").alias("vocab"))
