"""Registered queries: vector functions, exact search and embedding evaluation
(K1-K9, E3, C7-C9, C11, C12, B5, B9, D7, L5, L8, A8, A9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clean, ranking, search, vectors
from ..operators.ball_search import BallIndex
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import io
from . import oracle as O
from .registry import register, rounded

VV = ("fx_vec_queries", "fx_vec_products", "fx_vec_qrels")


def COS(a, b):
    return (f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0.0)")


def DOT(a, b):
    return f"list_dot_product({a}, {b})"


PAIRS_SQL = "from fx_vec_qrels r join fx_vec_queries q on q.qid = r.qid join fx_vec_products p on p.id = r.docid"


def _v(spark, sf):
    return fx.vec_queries(spark, sf), fx.vec_products(spark, sf), fx.vec_qrels(spark, sf)


@register("cosine_pair", O.with_views(
    f"select r.qid, r.docid, round({COS('q.query_embedding', 'p.product_embedding')}, 6) as score {PAIRS_SQL} where r.relevance_score >= 1", *VV))
def q_cosine_pair(spark, sf):
    q, p, r = _v(spark, sf)
    return rounded(vectors.pair_scores(r.filter("relevance_score >= 1").select("qid", "docid"), q, p))


@register("cosine_one_to_many", O.with_views(
    f"select r.qid, r.docid, r.relevance_score, round({COS('q.query_embedding', 'p.product_embedding')}, 6) as score {PAIRS_SQL}", *VV))
def q_cosine_one_to_many(spark, sf):
    q, p, r = _v(spark, sf)
    return rounded(vectors.pair_scores(r, q, p))


@register("semantic_similarity", O.with_views(
    f"""select r.docid, round(avg({COS('q.query_embedding', 'p.product_embedding')}), 6) as mean_cosine, count(*) as n_queries,
 string_agg(cast(cast(round({COS('q.query_embedding', 'p.product_embedding')} * 10000) as bigint) as varchar), ',' order by r.qid) as cosines_e4
 {PAIRS_SQL} where r.relevance_score >= 1 group by r.docid""", *VV))
def q_semantic_similarity(spark, sf):
    q, p, r = _v(spark, sf)
    """Mean cosine per product with its queries, and the list of cosines (in ten-thousandths)."""
    out = vectors.semantic_similarity(r.filter("relevance_score >= 1").select("qid", "docid"), q, p)
    return rounded(out.withColumn("cosines_e4", F.array_join(F.transform("cosines", lambda x: F.round(x * 10000).cast("long").cast("string")), ",")).drop("cosines"))


@register("pairwise_diversity", O.with_views(
    f"""select g.label, g.n, round(case when g.n < 2 then 0.0 else coalesce(pr.d, 0.0) end, 6) as diversity
 from (select label, count(*) as n from fx_vectors group by label) g
 left join (select a.label, avg(1 - {COS('a.product_embedding', 'b.product_embedding')}) as d
            from fx_vectors a join fx_vectors b on a.label = b.label and a.id < b.id group by a.label) pr using (label)""",
    "fx_vectors"))
def q_pairwise_diversity(spark, sf):
    return rounded(vectors.pairwise_diversity(fx.vectors(spark, sf), "label", "product_embedding"))


@register("l2_normalize", O.with_views(
    """select id, round(sqrt(list_dot_product(u, u)), 6) as norm, round(list_sum(u), 6) as total from
 (select id, list_transform(product_embedding, x -> coalesce(x / nullif(sqrt(list_dot_product(product_embedding, product_embedding)), 0), 0.0)) as u
  from fx_vectors)""".replace("x -> ", "lambda x: "), "fx_vectors"))
def q_l2_normalize(spark, sf):
    p = fx.vectors(spark, sf).select("id", V.l2_normalize("product_embedding").alias("u"))
    return rounded(p.select("id", V.norm("u").alias("norm"),
                            F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("total")))


@register("dot_score", O.with_views(
    f"""select r.qid, r.docid, round(100.0 * {DOT('list_transform(q.query_embedding, lambda x: x / sqrt(list_dot_product(q.query_embedding, q.query_embedding)))',
                                            'list_transform(p.product_embedding, lambda x: x / sqrt(list_dot_product(p.product_embedding, p.product_embedding)))')}, 6) as score
 {PAIRS_SQL} where r.relevance_score >= 1""", *VV))
def q_dot_score(spark, sf):
    q, p, r = _v(spark, sf)
    return rounded(vectors.pair_scores(r.filter("relevance_score >= 1").select("qid", "docid"), q, p, fn=V.dot_score))


@register("l2_distance", O.with_views(
    f"select r.qid, r.docid, round(list_distance(q.query_embedding, p.product_embedding), 6) as score {PAIRS_SQL} where r.relevance_score >= 1", *VV))
def q_l2_distance(spark, sf):
    q, p, r = _v(spark, sf)
    return rounded(vectors.pair_scores(r.filter("relevance_score >= 1").select("qid", "docid"), q, p, fn=V.l2_distance))


def _topk_sql(expr, k, asc=False):
    o = "asc" if asc else "desc"
    return O.with_views(
        f"""select qid, id, rank, round(score, 6) as score from (select q.qid, p.id, round({expr}, 9) as score,
 cast(row_number() over (partition by q.qid order by round({expr}, 9) {o}, p.id) as integer) as rank
 from fx_vec_queries q cross join fx_vectors p) where rank <= {k}""", "fx_vec_queries", "fx_vectors")


@register("brute_force_topk", _topk_sql(DOT("q.query_embedding", "p.product_embedding"), 10))
def q_brute_force_topk(spark, sf):
    """Exact top-10 vectors by inner product (block matmul) of every query vector, over all vectors (a query finds itself too)."""
    return rounded(search.brute_force_topk(fx.vec_queries(spark, sf), fx.vectors(spark, sf), 10, "dot"))


@register("index_search", _topk_sql("list_distance(q.query_embedding, p.product_embedding)", 10, asc=True))
def q_index_search(spark, sf):
    """``index.search(q, k)``: exact 10 nearest of all vectors to every query vector by Euclidean distance, ascending, from a written index."""
    path = scratch_path(spark, "ball-index")
    BallIndex.build(fx.vectors(spark, sf), "l2").write(path)
    return rounded(BallIndex.read(spark, path).search(fx.vec_queries(spark, sf), 10))


@register("index_top_n", _topk_sql("list_distance(q.query_embedding, p.product_embedding)", 5, asc=True))
def q_index_top_n(spark, sf):
    return rounded(BallIndex.build(fx.vectors(spark, sf), "l2").search(fx.vec_queries(spark, sf), 5))


@register("judged_candidates", O.with_views(
    "select r.qid, r.docid, r.relevance_score, p.label from fx_vec_qrels r join fx_vec_products p on p.id = r.docid", *VV))
def q_judged_candidates(spark, sf):
    _, p, r = _v(spark, sf)
    return vectors.attach(r, p.select(F.col("id").alias("docid"), "label"), "docid").select("qid", "docid", "relevance_score", "label")


@register("pairs_with_embeddings", O.with_views(
    "select r.qid, r.docid, cast(len(p.product_embedding) as integer) as dim from fx_vec_qrels r join fx_vec_products p on p.id = r.docid where r.relevance_score >= 1", *VV))
def q_pairs_with_embeddings(spark, sf):
    _, p, r = _v(spark, sf)
    j = vectors.attach(r.filter("relevance_score >= 1"), p.select(F.col("id").alias("docid"), "product_embedding"), "docid")
    return j.select("qid", "docid", F.size("product_embedding").alias("dim"))


@register("left_embeddings", O.with_views(
    "select r.qid, r.docid, p.id is not null as has_vector from fx_qrels r left join fx_vec_products p on p.id = r.docid",
    "fx_qrels", "fx_vec_products"))
def q_left_embeddings(spark, sf):
    p = fx.vec_products(spark, sf).select(F.col("id").alias("docid"), "product_embedding")
    j = fx.qrels(spark, sf).join(p, "docid", "left")
    return j.select("qid", "docid", F.col("product_embedding").isNotNull().alias("has_vector"))


@register("drop_null_subset", O.with_views(
    "select r.qid, r.docid from fx_qrels r left join fx_vec_products p on p.id = r.docid where p.product_embedding is not null",
    "fx_qrels", "fx_vec_products"))
def q_drop_null_subset(spark, sf):
    p = fx.vec_products(spark, sf).select(F.col("id").alias("docid"), "product_embedding")
    j = fx.qrels(spark, sf).join(p, "docid", "left")
    return clean.drop_null_subset(j, ["docid", "product_embedding"]).select("qid", "docid")


@register("positional_attach", O.with_views(
    "select c.id, c.title, cast(len(p.product_embedding) as integer) as dim from cc c join fx_vec_products p on p.id = c.id",
    "fx_collection", "fx_vec_products", extra=O.clean_collection_ctes()))
def q_positional_attach(spark, sf):
    """Vectors attached to the collection by key (never by row position)."""
    c = clean.clean_collection(fx.collection(spark, sf))
    p = fx.vec_products(spark, sf)
    return c.join(p, "id").select("id", "title", F.size("product_embedding").alias("dim"))


@register("attach_scores", O.with_views(
    f"""select t.qid, t.id as docid, t.rank, round(t.score, 6) as score, r.relevance_score from
 (select q.qid, p.id, round({DOT('q.query_embedding', 'p.product_embedding')}, 9) as score,
  cast(row_number() over (partition by q.qid order by round({DOT('q.query_embedding', 'p.product_embedding')}, 9) desc, p.id) as integer) as rank
  from fx_vec_queries q cross join fx_vec_products p) t join fx_vec_qrels r on r.qid = t.qid and r.docid = t.id where t.rank <= 10""", *VV))
def q_attach_scores(spark, sf):
    q, p, r = _v(spark, sf)
    top = search.brute_force_topk(q, p, 10, "dot").withColumnRenamed("id", "docid")
    return rounded(vectors.attach(r, top, ["qid", "docid"]).select("qid", "docid", "rank", "score", "relevance_score"))


@register("filter_similarity", O.with_views(
    f"""select * from (select r.qid, r.docid, round({COS('q.query_embedding', 'p.product_embedding')}, 6) as score {PAIRS_SQL})
 where score >= 0.2""", *VV))
def q_filter_similarity(spark, sf):
    """Pairs with cosine >= 0.2 (the fixture vectors carry no label signal; 0.8 would keep none)."""
    q, p, r = _v(spark, sf)
    s = rounded(vectors.pair_scores(r.select("qid", "docid"), q, p))
    return s.filter(F.col("score") >= 0.2)


@register("first_per_group", O.with_views(
    "select label, min(id) as id, round(arg_min(product_embedding, id)[1], 6) as v0 from fx_vectors group by label",
    "fx_vectors"))
def q_first_per_group(spark, sf):
    f = vectors.first_per_group(fx.vectors(spark, sf), "label", "id", "product_embedding")
    return rounded(f.select("label", "id", F.col("product_embedding")[0].alias("v0")))


_EVAL_EMB = O.with_views(
    """select round(avg(ndcg), 6) as ndcg, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall,
 count(*) as n_queries, cast(count_if(ndcg is null) as bigint) as n_undefined from mt_pq""", *VV,
    extra=[("ee_scored", f"select r.qid, r.docid, r.relevance_score, round({COS('q.query_embedding', 'p.product_embedding')}, 9) as score {PAIRS_SQL}")]
    + O.metric_ctes("ee_scored", 10, 10, evaluated="fx_vec_queries"))


@register("eval_embeddings", _EVAL_EMB)
def q_eval_embeddings(spark, sf):
    """Re-rank each query's judged candidates by cosine; macro NDCG@10 / P@10 / R@10."""
    q, p, r = _v(spark, sf)
    scored = vectors.pair_scores(r, q, p).withColumn("score", F.round("score", 9))
    return rounded(ranking.macro_mean(ranking.per_query_metrics(q, scored, 10, 10)))


_ACC = O.with_views(
    "select " + ", ".join(f"round(avg(case when n + 1 <= {k} then 1.0 else 0.0 end), 6) as top_{k}" for k in (1, 5, 10, 50, 100))
    + ", count(*) as n_pairs from cnt", *VV, "fx_vectors",
    extra=[("pp", f"select r.qid, r.docid, round({DOT('q.query_embedding', 'p.product_embedding')}, 9) as own {PAIRS_SQL} where r.relevance_score >= 1"),
           ("cnt", f"""select pp.qid, pp.docid, count(c.id) as n from pp join fx_vec_queries q on q.qid = pp.qid
 left join fx_vectors c on c.id <> pp.docid and round({DOT('q.query_embedding', 'c.product_embedding')}, 9) > pp.own
 group by pp.qid, pp.docid""")])


@register("topk_accuracy", _ACC)
def q_topk_accuracy(spark, sf):
    """Share of relevant pairs whose own product ranks in the top 1/5/10/50/100 of all vectors."""
    q, p, r = _v(spark, sf)
    pairs = r.filter("relevance_score >= 1").select("qid", "docid")

    def counts(mine, own):
        own = vectors.pair_scores(own, mine, p, fn=V.dot, out="own_score")
        return search.greater_counts(mine, fx.vectors(spark, sf), own, "dot")
    return rounded(search.accuracy_by_slices(q, pairs, counts))


@register("src_sink_embeddings", O.with_views(
    "select id, label, cast(len(product_embedding) as integer) as dim, round(list_sum(product_embedding), 6) as total from fx_vectors",
    "fx_vectors"))
def q_src_sink_embeddings(spark, sf):
    path = scratch_path(spark, "product-vectors")
    io.write_parquet(fx.vectors(spark, sf), path, "gzip")
    back = io.read_parquet(spark, path)
    return rounded(back.select("id", "label", F.size("product_embedding").alias("dim"),
                               F.aggregate("product_embedding", F.lit(0.0), lambda a, x: a + x).alias("total")))


@register("collection_embeddings", O.with_views(
    "select c.id, c.title, cast(len(p.product_embedding) as integer) as dim from cc c join fx_vec_products p on p.id = c.id",
    "fx_collection", "fx_vec_products", extra=O.clean_collection_ctes()))
def q_collection_embeddings(spark, sf):
    """Collection + vectors kept as a Parquet table (instead of a pickle), read back."""
    path = scratch_path(spark, "collection-vectors")
    c = clean.clean_collection(fx.collection(spark, sf)).join(fx.vec_products(spark, sf), "id")
    io.write_parquet(c.select("id", "title", "product_text", "product_embedding"), path, "gzip")
    back = io.read_parquet(spark, path)
    return back.select("id", "title", F.size("product_embedding").alias("dim"))
