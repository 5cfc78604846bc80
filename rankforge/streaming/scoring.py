"""Structured Streaming form of BM25 query scoring (the reference is batch only; this is the
same operator I5 for queries that arrive as files over time).

A query file source is joined, stream-static, to a persisted index (``bm25.save_index``): each
micro-batch tokenises its queries and joins their terms to the postings, emitting one BM25
contribution per (query, document, term). The stream is stateless, so it runs in append mode
with a checkpoint in the shared folder and restarts exactly where it stopped; summing per
(query, document) and the top-n happen when the output is read (``top_n_from_contributions``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize
from ..operators import bm25

QUERY_SCHEMA = "qid long, text string"


def contributions_stream(spark: SparkSession, index_path: str, queries_dir: str) -> DataFrame:
    index = bm25.load_index(spark, index_path)
    q = spark.readStream.schema(QUERY_SCHEMA).json(queries_dir)
    terms = q.filter(F.col("text").isNotNull()).select("qid", F.explode(tokenize(F.col("text"))).alias("term"))
    m = terms.join(index.term_stats.select("term", "idf"), "term").join(index.postings, "term").join(index.doc_stats, "id")
    tf = F.col("tf").cast("double")
    norm = F.lit(index.k1) * (F.lit(1.0) - F.lit(index.b) + F.lit(index.b) * F.col("doc_len") / index.avgdl)
    # one row per query-term occurrence: repeated query terms count again, as in batch scoring
    return m.select("qid", "id", "term", (F.col("idf") * tf * F.lit(index.k1 + 1.0) / (tf + norm)).alias("contribution"))


def start_scoring(spark: SparkSession, index_path: str, queries_dir: str, out_dir: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    w = contributions_stream(spark, index_path, queries_dir).writeStream.format("parquet") \
        .option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def top_n_from_contributions(spark: SparkSession, out_dir: str, n: int = 10) -> DataFrame:
    c = spark.read.parquet(out_dir)
    s = c.groupBy("qid", "id").agg(F.round(F.sum("contribution"), 9).alias("score"))
    return bm25.top_n(s, n)
