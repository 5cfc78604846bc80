"""Readers and writers with the ingest rules fixed once.

* TSV: ``sep='\\t', quote='"', escape='"', multiLine=True`` reproduces the quoted / multi-line
  cells of the source files; only the empty cell is NULL (literal ``NA`` / ``null`` stay text).
  Multi-line CSV is not splittable: land it once and convert to Parquet.
* Training triples (JSON lines) are read with an explicit schema; missing passage lists become
  empty arrays. In Spark the triples are kept **flat** -- one row per passage
  ``(query_id, query, kind, pos, docid, text)`` -- and are only nested at the file boundary,
  where the format wants one record per query.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release_shuffles

TSV_OPTIONS = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "",
               "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

COLLECTION_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
                                  T.StructField("description", T.StringType())])
QUERY_SCHEMA = T.StructType([T.StructField("qid", T.LongType()), T.StructField("text", T.StringType())])
QREL_SCHEMA = T.StructType([T.StructField("qid", T.LongType()), T.StructField("iter", T.StringType()),
                            T.StructField("docid", T.LongType()), T.StructField("relevance_score", T.IntegerType())])
PASSAGE = T.StructType([T.StructField("docid", T.LongType()), T.StructField("text", T.StringType())])
TRIPLE_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query", T.StringType()),
                              T.StructField("positive_passages", T.ArrayType(PASSAGE)),
                              T.StructField("negative_passages", T.ArrayType(PASSAGE))])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, header: bool = False) -> DataFrame:
    return spark.read.options(**TSV_OPTIONS).option("header", str(header).lower()).schema(schema).csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").options(**TSV_OPTIONS).option("header", str(header).lower()).csv(path)


def read_collection(spark, path):
    return read_tsv(spark, path, COLLECTION_SCHEMA)


def read_queries(spark, path):
    return read_tsv(spark, path, QUERY_SCHEMA)


def read_qrels(spark, path):
    """TREC judgements; the constant iteration column is dropped at use."""
    return read_tsv(spark, path, QREL_SCHEMA).select("qid", "docid", "relevance_score")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines -> flat passages ``(query_id, query, kind, pos, docid, text)``; absent lists = []."""
    raw = spark.read.schema(TRIPLE_SCHEMA).json(path)
    out = None
    for kind in ("positive", "negative"):
        lst = F.coalesce(F.col(f"{kind}_passages"), F.array().cast(T.ArrayType(PASSAGE)))
        part = raw.select("query_id", "query", F.posexplode(lst).alias("pos", "p")).select(
            "query_id", "query", F.lit(kind).alias("kind"), "pos", F.col("p.docid").alias("docid"),
            F.col("p.text").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


#: Passages of the records that are written at a time.
SLICE_ROWS = 1_000_000


def write_triples(flat: DataFrame, path: str) -> None:
    """Flat passages -> gzipped JSON lines, one record per query, each list ordered by ``pos`` then docid.
    The file format asks for a query's whole lists in one line, so a record is as large as its query. Every passage moves with its text to its
    record: queries are dealt by a hash into slices, written one after another, so that only one slice's texts lie in shuffle files."""
    def passages(kind):
        items = F.collect_list(F.struct("kind", "pos", "docid", "text"))
        kept = F.array_sort(F.filter(items, lambda x: x["kind"] == F.lit(kind)))
        return F.transform(kept, lambda x: F.struct(x["docid"].alias("docid"), x["text"].alias("text"))) \
            .alias(f"{kind}_passages")

    slices = max(1, math.ceil(flat.count() / SLICE_ROWS))
    for i in range(slices):
        part = flat if slices == 1 else flat.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        grouped = part.groupBy("query_id").agg(
            F.first("query", ignorenulls=True).alias("query"), passages("positive"), passages("negative"))
        grouped.select("query_id", "query", "positive_passages", "negative_passages") \
            .write.mode("append" if i else "overwrite").option("compression", "gzip").json(path)
        if slices > 1:
            release_shuffles(flat.sparkSession)


def write_parquet(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
