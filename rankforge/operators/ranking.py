"""Judgement handling and ranking metrics (NDCG@p, precision@k, recall@k) as grouped plans.

Semantics (judged-only re-ranking evaluation):

* the ranked list of a query is its **judged** documents (in the collection), ordered by the
  retrieval score (descending; ascending for distances), ties by ``docid``;
* NDCG uses linear gain, ``rel / log2(rank + 1)`` for ranks ``<= p``, divided by the same sum
  over the relevances of that list sorted descending; rounded to 5 digits; undefined
  (no judged document, or all zero) is NULL and counted in ``n_undefined``;
* precision = relevant (> 0) among the first ``k`` / ``k``; recall = relevant among the first
  ``k`` / relevant judged (0 when none).

Only rows with rank <= max(p, k) leave the map side: ``row_number() <= n`` becomes a partial
WindowGroupLimit before the shuffle, so a query with a huge judged list costs O(k) per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def dedupe_qrels(qrels: DataFrame) -> DataFrame:
    """One judgement per (qid, docid): the highest relevance."""
    return qrels.groupBy("qid", "docid").agg(F.max("relevance_score").cast("int").alias("relevance_score"))


def common_qids(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that have judgements, and judgements that have a query (two semi joins)."""
    q = queries.join(qrels.select("qid"), "qid", "left_semi")
    r = qrels.join(queries.select("qid"), "qid", "left_semi")
    return q, r


def intersect_qids(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.select("qid").intersect(qrels.select("qid"))


def judged_in_collection(qrels: DataFrame, collection: DataFrame, id_col: str = "id") -> DataFrame:
    return qrels.join(collection.select(F.col(id_col).alias("docid")), "docid", "left_semi")


def filter_relevance(df: DataFrame, min_score: int = 2, col: str = "relevance_score") -> DataFrame:
    return df.filter(F.col(col) >= min_score)


def rank_within(df: DataFrame, order_col: str, ascending: bool = False, part: Sequence[str] = ("qid",),
                key: str = "docid", out: str = "rank") -> DataFrame:
    o = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    w = Window.partitionBy(*part).orderBy(o, F.col(key).asc())
    return df.withColumn(out, F.row_number().over(w))


def rank_distributed(df: DataFrame, order_col: str, ascending: bool = False, part: Sequence[str] = ("qid",),
                     key: str = "docid", out: str = "rank") -> DataFrame:
    """Full 1-based rank within groups without holding a group in one task.

    A global range-partitioned sort on (group, order, key) splits even a huge group across many
    tasks; ``monotonically_increasing_id`` numbers rows in sort order inside each partition. The
    numbered rows are written to the shared folder once: sampled range bounds may differ when a
    sort is evaluated twice, so counts and ranks must come from the same evaluation. The
    per-(group, partition) counts -- a table of groups x partitions rows -- give each partition's
    offset inside its group. Use for unbounded rankings; top-k uses ``rank_within`` + a limit."""
    o = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    s = materialize(df.orderBy(*[F.col(p) for p in part], o, F.col(key).asc())
                    .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    stats = s.groupBy(*part, "_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    r = s.join(offs, [*part, "_pid"])
    return r.withColumn(out, (F.col("_mid") - F.col("_m0") + F.col("_off") + 1).cast("int")) \
        .drop("_pid", "_mid", "_n", "_m0", "_off")


def ground_truth(qrels: DataFrame, collection: DataFrame, id_col: str = "id") -> DataFrame:
    """Judged documents in the collection, ranked by relevance descending (ties: docid)."""
    g = judged_in_collection(qrels, collection, id_col)
    return rank_distributed(g, "relevance_score")


def ranking_metrics(scored: DataFrame, p: int = 5, k: int = 10, group: Sequence[str] = (),
                    ascending: bool = False, score: str = "score", rel: str = "relevance_score") -> DataFrame:
    """Per (group.., qid): ``ndcg, precision, recall, n_rel`` from ``scored(qid, docid, score, rel)``."""
    keys = [*group, "qid"]
    top_n = max(p, k)
    top = rank_within(scored, score, ascending, keys).filter(F.col("rank") <= top_n)
    r = F.col(rel).cast("double")
    dc = top.groupBy(*keys).agg(
        F.sum(F.when(F.col("rank") <= p, r / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count_if((F.col("rank") <= k) & (F.col(rel) > 0)).alias("hits"))
    ideal = rank_within(scored, rel, False, keys, out="irank").filter(F.col("irank") <= p) \
        .groupBy(*keys).agg(F.sum(r / F.log2(F.col("irank") + 1.0)).alias("idcg"))
    tot = scored.groupBy(*keys).agg(F.count_if(F.col(rel) > 0).alias("n_rel"))
    per = tot.join(dc, keys, "left").join(ideal, keys, "left")
    hits = F.coalesce(F.col("hits"), F.lit(0))
    return per.select(
        *keys,
        F.round(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), 5).alias("ndcg"),
        (hits / F.lit(float(k))).alias("precision"),
        F.coalesce(hits / F.nullif(F.col("n_rel"), F.lit(0)), F.lit(0.0)).alias("recall"),
    )


def per_query_metrics(evaluated: DataFrame, scored: DataFrame, p: int = 5, k: int = 10,
                      group: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """Metrics for every evaluated query ``(group.., qid)``; a query without judged documents
    gets NULL ndcg and zero precision / recall."""
    keys = [*group, "qid"]
    m = ranking_metrics(scored, p, k, group, ascending)
    return evaluated.select(*keys).join(m, keys, "left").select(
        *keys, "ndcg", F.coalesce("precision", F.lit(0.0)).alias("precision"),
        F.coalesce("recall", F.lit(0.0)).alias("recall"))


def macro_mean(per_query: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    aggs = [F.avg("ndcg").alias("ndcg"), F.avg("precision").alias("precision"),
            F.avg("recall").alias("recall"), F.count("*").alias("n_queries"),
            F.count_if(F.col("ndcg").isNull()).alias("n_undefined")]
    return per_query.groupBy(*group).agg(*aggs) if group else per_query.agg(*aggs)


def argmax_config(scores: DataFrame, params: Sequence[str], score: str = "score",
                  order: str = "g") -> DataFrame:
    """Best parameter set: highest score, ties to the first in grid order."""
    best = scores.agg(F.max_by(F.struct(*[F.col(c) for c in [*params, score]]),
                               F.struct(F.col(score), -F.col(order))).alias("best"))
    return best.select(*[F.col("best")[c].alias(c) for c in [*params, score]])
