"""Deterministic sampling, splits and negative sampling.

Every draw is *hash ordered*: ``md5(cast(key as string) || ':' || seed)`` -- the same rows on
every run, every partitioning and in SQL. Fractions and splits use the first 8 hex digits as an
integer bucket in [0, 10000), so they are narrow filters (no global sort, no single-partition
window); only ``sample_n`` (a small report) sorts, through TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bucket, hash_index, sample_key

BUCKETS = 10000


def sample_n(df: DataFrame, key: str, n: int, seed: int = 119) -> DataFrame:
    return df.orderBy(sample_key(key, seed), F.col(key)).limit(n)


def sample_frac(df: DataFrame, key: str, frac: float, seed: int = 119) -> DataFrame:
    """About ``frac`` of the rows (bucket threshold; independent of partitioning)."""
    return df.filter(bucket(key, seed, BUCKETS) < int(round(frac * BUCKETS)))


def split_by_key(df: DataFrame, key: str, test_frac: float = 0.05, seed: int = 119,
                 tune_half: bool = True) -> DataFrame:
    """Adds ``split``: all rows of one key land on one side; the first half of the test buckets
    is the tuning set."""
    b = bucket(key, seed, BUCKETS)
    t = int(round(test_frac * BUCKETS))
    s = F.when(b < (t // 2 if tune_half else 0), F.lit("tune")).when(b < t, F.lit("test")).otherwise(F.lit("train"))
    return df.withColumn("split", s)


def split_rows(df: DataFrame, key: str, train_frac: float = 0.8, seed: int = 119) -> DataFrame:
    b = bucket(key, seed, BUCKETS)
    return df.withColumn("split", F.when(b < int(round(train_frac * BUCKETS)), F.lit("train")).otherwise(F.lit("test")))


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """``(key, idx)`` with idx = 0-based rank of the key: a distributed range sort plus
    per-partition offsets (JVM only) -- no single-partition window, no Python row path."""
    from .ranking import rank_distributed

    r = rank_distributed(df.select(key).distinct(), key, ascending=True, part=(), key=key, out="_r")
    return r.select(F.col(key).cast("long").alias(key), (F.col("_r") - 1).cast("long").alias("idx"))


def negative_ids(items: DataFrame, key: str, draws: DataFrame, draw_key: str, seed_col: str) -> DataFrame:
    """For every row of ``draws`` one *other* item: with ``idx`` the dense index of the drawing
    item among ``n`` items, ``neg = (idx + 1 + pmod(h, n - 1)) % n`` (never ``idx``), then an
    equi join on the index. No pair of items is materialised. Needs n >= 2, else no negatives."""
    idx = dense_index(items, key)
    n = idx.agg(F.count("*")).scalar()
    h = hash_index(F.col(seed_col), 0)
    d = draws.join(idx.withColumnRenamed(key, draw_key), draw_key)
    d = d.filter(n >= 2).withColumn("neg_idx", F.pmod(F.col("idx") + 1 + F.pmod(h, n - 1), n))
    return d.join(idx.select(F.col("idx").alias("neg_idx"), F.col(key).alias("neg_id")), "neg_idx").drop("idx", "neg_idx")
