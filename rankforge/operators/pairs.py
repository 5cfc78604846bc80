"""Training-pair construction from judgements and training triples (flat passage rows).

A triple file is held flat -- ``(query_id, query, kind, pos, docid, text)`` -- so every step is
a join or a filter: the semi join into the collection is an equi join on ``docid`` and the
"drop a record whose positives are all gone" rule is a semi join on query ids with a surviving
positive. No list is collected back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean


def triples_from_qrels(qrels: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Flat triples: per judged query, positives = relevance >= 1, negatives = 0, text = document
    text, list order = docid; ``pos`` is the 0-based position inside the list."""
    j = qrels.join(documents.select(F.col("doc_id").alias("docid"), "text"), "docid")
    q = queries.select(F.col("qid"), F.col("text").alias("query"))
    kind = F.when(F.col("relevance_score") >= 1, F.lit("positive")).otherwise(F.lit("negative"))
    return j.join(q, "qid", "left").select(
        F.col("qid").alias("query_id"), "query", kind.alias("kind"), "docid", "text")


def filter_passages(flat: DataFrame, collection: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep passages whose docid is in the collection (both lists, order kept); drop queries
    whose positives all disappeared (empty negatives are fine)."""
    ids = collection.select(F.col(id_col).alias("docid"))
    kept = flat.join(ids, "docid", "left_semi")
    alive = kept.filter(F.col("kind") == "positive").select("query_id")
    return kept.join(alive, "query_id", "left_semi")


def attach_title(pairs: DataFrame, collection: DataFrame) -> DataFrame:
    """Left lookup of the collection title by ``product_id = id`` (fans out if ids repeat)."""
    t = collection.select(F.col("id").alias("_id"), "title")
    return pairs.join(t, pairs["product_id"] == t["_id"], "left").drop("_id")


def attach_relevance(pairs: DataFrame, qrels: DataFrame, min_score: int = 2) -> DataFrame:
    """Left join on (query_id, product_id) = (qid, docid), then ``relevance_score >= min_score``
    (Catalyst turns the outer join into an inner one)."""
    r = qrels.select("qid", "docid", "relevance_score")
    j = pairs.join(r, (pairs["query_id"] == r["qid"]) & (pairs["product_id"] == r["docid"]), "left")
    return j.filter(F.col("relevance_score") >= min_score)


def build_pairs(flat: DataFrame, collection: DataFrame, qrels: DataFrame, min_score: int = 2) -> DataFrame:
    """filter passages -> positives as (query, product) pairs -> title -> clean again (dedupe on
    (description, title) keeping the first pair in file order) -> relevance >= min_score."""
    f = filter_passages(flat, collection)
    pos = f.filter(F.col("kind") == "positive").select(
        "query_id", "query", F.col("text").alias("product_description"), F.col("docid").alias("product_id"))
    p = attach_title(pos, collection)
    p = clean.dedupe_text(p, subset=("product_description", "title"), order_by=("query_id", "product_id"))
    p = clean.null_boilerplate(p, ("product_description", "title"))
    p = clean.drop_all_null(p, ("product_description", "title"))
    p = clean.strip_phrases(p, "product_description")
    p = clean.product_text(p, "title", "product_description")
    return attach_relevance(p, qrels, min_score)


def dev_judgements(queries: DataFrame, qrels: DataFrame, order: str | None = None) -> DataFrame:
    """(qid, query_text, docid, relevance_score) for qids present on both sides. A repeated qid counts
    once, with its last text: by the column ``order``, or as the rows come from their source."""
    q = queries.select("qid", F.struct("text").alias("_t"), (F.col(order) if order else F.monotonically_increasing_id()).alias("_o"))
    q = q.groupBy("qid").agg(F.max_by("_t", "_o").alias("_t")).select("qid", F.col("_t.text").alias("query_text"))
    return qrels.join(q, "qid").select("qid", "query_text", "docid", "relevance_score")


def single_query_products(df: DataFrame, product: str = "docid", query: str = "qid") -> DataFrame:
    """Rows of products that have exactly one ground-truth query (grouped count + semi join,
    no window over a possibly huge product)."""
    one = df.groupBy(product).agg(F.count("*").alias("_n")).filter(F.col("_n") == 1).select(product)
    return df.join(one, product, "left_semi")


def candidate_ids(pairs: DataFrame, collection: DataFrame | None = None, product: str = "docid", key: str = "id") -> DataFrame:
    """``(id)`` of the retrieval candidates: the products of the pairs, or with ``collection`` all of its rows. NULL ids are no candidates."""
    own = pairs.select(F.col(product).alias("id")) if collection is None else collection.select(F.col(key).alias("id"))
    return own.filter("id is not null").distinct()
