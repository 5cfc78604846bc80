"""Equi joins on a term in which a few terms hold much of the rows: those terms are split over several tasks.

A term is heavy if it has more than one ``share``-th of all rows, so there are fewer than ``share`` heavy terms whatever the
input, and their table is broadcast by that bound. The rows of a heavy term are dealt by a hash to as many copies of the other side's row
as its rows ask for; all other terms have one copy. Copies of all terms together are under ``2 * share`` more than there are terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_share(spark) -> int:
    """Four shares a shuffle partition: no term fills more than a quarter of an even task."""
    return 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_terms(stats: DataFrame, term: str = "term", rows: str = "df", share: int | None = None) -> DataFrame:
    """``(term, _copies)`` of the terms that hold more than one ``share``-th of the rows, from ``stats(term, rows)``, a row a term."""
    share = share or default_share(stats.sparkSession)
    total = stats.agg(F.sum(rows)).scalar()
    return stats.filter(F.col(rows) * share > total).select(term, F.ceil(F.col(rows) * share / total).cast("int").alias("_copies"))


def split_join(rows: DataFrame, other: DataFrame, heavy: DataFrame, spread: list[str], term: str = "term") -> DataFrame:
    """Inner join of ``rows`` and ``other`` on ``term``, the rows of heavy terms dealt by a hash of the columns ``spread``. A NULL term joins nothing."""
    heavy = F.broadcast(heavy)  # fewer rows than the share
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    left = rows.join(heavy, term, "left").withColumn("_copy", F.pmod(F.xxhash64(*spread), copies).cast("int")).drop("_copies")
    right = other.join(heavy, term, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return left.join(right, [term, "_copy"]).drop("_copy")
