"""Lexical baseline: clean collection -> tokens -> BM25 index -> judged-first evaluation / tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sample_key
from ..operators import bm25, ranking


def eval_inputs(queries: DataFrame, qrels: DataFrame, collection: DataFrame):
    """Common qids, deduplicated judgements restricted to the collection, queries with text."""
    q, r = ranking.common_qids(queries, qrels)
    r = ranking.judged_in_collection(ranking.dedupe_qrels(r), collection)
    return q, r


def score_judged(index: bm25.BM25Index, evalq: DataFrame, judged: DataFrame, digits: int = 9) -> DataFrame:
    """``(qid, docid, relevance_score, score)`` for the judged documents of the evaluated queries.

    Judged-first: a document's BM25 score does not depend on other documents, and the metrics
    read only judged documents, so only (qid, docid) pairs in the judgements are scored."""
    j = judged.join(evalq.select("qid"), "qid", "left_semi")
    s = bm25.bm25_scores(index, evalq, j.select("qid", F.col("docid").alias("id")))
    return j.join(s.withColumnRenamed("id", "docid"), ["qid", "docid"]) \
        .select("qid", "docid", "relevance_score", F.round("score", digits).alias("score"))


def evaluate_bm25(queries: DataFrame, qrels: DataFrame, collection: DataFrame,
                  index: bm25.BM25Index | None = None, p: int = 5, k: int = 10,
                  lemmatize: bool = False, per_query: bool = False, **params) -> DataFrame:
    """Macro NDCG@p / precision@k / recall@k of BM25 over the judged documents."""
    if index is None:
        prm = {**bm25.FIXED_PARAMS, **params}
        index = bm25.build_index(collection, lemmatize=lemmatize, **prm)
    # the materialised index already lists every document id: no second pass over the texts
    ids = index.doc_ids if index.doc_ids is not None else collection
    q, judged = eval_inputs(queries, qrels, ids)
    evalq = q.filter(F.col("text").isNotNull())
    scored = score_judged(index, evalq, judged)
    pq = ranking.per_query_metrics(evalq, scored, p, k)
    return pq if per_query else ranking.macro_mean(pq)


def sample_queries(queries: DataFrame, n: int = 10, seed: int = 119) -> DataFrame:
    """n queries, hash ordered (independent of partitioning); a top-n report by design."""
    return queries.orderBy(sample_key("qid", seed), "qid").limit(n)


def tune_bm25(queries: DataFrame, qrels: DataFrame, collection: DataFrame, n_sample: int = 10,
              seed: int = 119, p: int = 5, k: int = 10, grid: dict | None = None,
              lemmatize: bool = False) -> DataFrame:
    """Grid search over (b, epsilon, k1) scored by NDCG on sampled queries; postings built once
    and the grid applied to matched rows only. Ties go to the first grid point."""
    index = bm25.build_index(collection, lemmatize=lemmatize)
    q, judged = eval_inputs(queries, qrels, index.doc_ids)
    sampled = sample_queries(q, n_sample, seed)
    evalq = sampled.filter(F.col("text").isNotNull())
    j = judged.join(evalq.select("qid"), "qid", "left_semi")
    gs = bm25.grid_scores(index, evalq, j.select("qid", F.col("docid").alias("id")), grid)
    scored = gs.withColumnRenamed("id", "docid").join(j, ["qid", "docid"]) \
        .withColumn("score", F.round("score", 9))
    rows = bm25.grid_rows(grid)
    params = scored.sparkSession.createDataFrame(
        [(r["g"], float(r["b"]), float(r["epsilon"]), float(r["k1"])) for r in rows],
        "g int, b double, epsilon double, k1 double")
    per = ranking.ranking_metrics(scored, p, k, group=("g",))
    # queries without judged docs count as undefined NDCG: they do not change the mean of the rest
    # rounded so that summation order cannot break a tie that the first-in-grid rule decides
    score = per.groupBy("g").agg(F.round(F.avg("ndcg"), 9).alias("score"))
    full = params.join(score, "g", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranking.argmax_config(full, ["b", "epsilon", "k1"], "score", "g")
