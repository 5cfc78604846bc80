"""Deterministic hash keys: sampling and splitting that do not depend on partitioning.

``sample_key(id, seed) = md5(cast(id as string) || ':' || seed)`` orders rows the same way in
Spark and in any SQL engine that has md5, and the same on every run and partition count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sample_key(key, seed: int) -> Column:
    return F.md5(F.concat(_col(key).cast("string"), F.lit(":"), F.lit(str(seed))))


def bucket(key, seed: int, buckets: int = 10000) -> Column:
    """Integer bucket in [0, buckets) from the first 8 hex digits of the sample key."""
    h = F.conv(F.substring(sample_key(key, seed), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets))


def hash_index(key, seed: int) -> Column:
    """Non-negative 32-bit integer from the sample key (for index arithmetic)."""
    return F.conv(F.substring(sample_key(key, seed), 1, 8), 16, 10).cast("long")
