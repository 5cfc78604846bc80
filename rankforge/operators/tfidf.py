"""TF-IDF over a keyed text table: vocabulary, smoothed idf, L2-normalised weights, pair cosine.

``idf = ln((1 + n) / (1 + df)) + 1`` (smoothed), weights = raw term count x idf, L2-normalised
per document. The cosine of query i with text i is an equi join of the two weight tables on
(row key, term) -- O(non-zeros) -- instead of the diagonal of an n x n matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tfidf_tokens
from ..session import materialize
from .skew import heavy_terms, split_join


def term_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys.., term, tf)``; partial aggregation before the shuffle, key never skews."""
    tok = docs.select(*keys, F.explode(tfidf_tokens(F.col(text))).alias("term"))
    return tok.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def fit(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Vocabulary with ``(term, df, idf)`` over all documents of ``docs``."""
    n = docs.agg(F.count("*")).scalar()
    df_ = term_counts(docs, keys, text).groupBy("term").agg(F.count("*").alias("df"))
    return df_.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def transform(docs: DataFrame, keys: list[str], vocab: DataFrame, text: str = "text") -> DataFrame:
    """``(keys.., term, weight)`` -- L2-normalised tf x idf; terms outside the vocabulary drop.
    The rows of a term that is in very many documents are split over tasks."""
    vocab = materialize(vocab.select("term", "df", "idf"), "vocabulary")  # read three times: the texts are split into terms once for it
    tf = split_join(term_counts(docs, keys, text), vocab.select("term", "idf"), heavy_terms(vocab), keys)
    w = tf.withColumn("w", F.col("tf") * F.col("idf"))
    norms = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("weight"))


def pair_cosine(left: DataFrame, right: DataFrame, key: str, all_keys: DataFrame) -> DataFrame:
    """``(key, cosine)`` for every key of ``all_keys``; 0.0 where no term is shared."""
    dot = left.select(key, "term", F.col("weight").alias("a")).join(
        right.select(key, "term", F.col("weight").alias("b")), [key, "term"]) \
        .groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("cosine"))
    return all_keys.select(key).join(dot, key, "left").select(key, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def top_terms(weights: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k highest-weighted terms per row (ties by term); ``rank`` 1 = highest."""
    w = Window.partitionBy(key).orderBy(F.col("weight").desc(), F.col("term").asc())
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
