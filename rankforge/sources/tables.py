"""Driver tables: one Parquet file per table under an ``sf`` directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables whose rows carry long texts: per-row CPU work (regex, tokenising, hashing) dominates.
TEXT_TABLES = {"documents", "conversations", "pages"}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster's parallelism when the scan yields fewer splits
    (e.g. one small file with a single row group). A no-op for real inputs, whose splits
    outnumber the cores; never a key-based shuffle, so it cannot create skew."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df
