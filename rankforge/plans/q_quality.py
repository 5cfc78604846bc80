"""Registered queries: data-quality TF-IDF (J1-J5, E7), corpora union (F2), sampling and splits
(G1-G5, F3, C13, C14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ordered_distinct_nonempty
from ..operators import clean, sampling, tfidf
from ..sources import fixtures as fx
from . import oracle as O
from .registry import register, rounded

SEED = 119


def _docs(spark, sf):
    p = fx.text_pairs(spark, sf)
    return p.select("pair_id", F.lit("query").alias("side"), F.col("query").alias("text")).unionByName(
        p.select("pair_id", F.lit("text").alias("side"), F.col("product_text").alias("text")))


def _weights(spark, sf):
    docs = _docs(spark, sf)
    vocab = tfidf.fit(docs, ["side", "pair_id"])
    return tfidf.transform(docs, ["side", "pair_id"], vocab)


TF_CTES = [
    ("tf_docs", "select pair_id, 'query' as side, query as text from fx_text_pairs union all select pair_id, 'text', product_text from fx_text_pairs"),
    ("tf_tc", f"select side, pair_id, term, count(*) as tf from (select side, pair_id, unnest({O.tfidf_tokens('text')}) as term from tf_docs) group by side, pair_id, term"),
    ("tf_v", "select term, count(*) as df, ln((1 + (select count(*) from tf_docs)) / (1 + count(*))) + 1 as idf from tf_tc group by term"),
    ("tf_w0", "select t.side, t.pair_id, t.term, t.tf * v.idf as w from tf_tc t join tf_v v using (term)"),
    ("tf_w", "select side, pair_id, term, w / sqrt(sum(w * w) over (partition by side, pair_id)) as weight from tf_w0"),
    ("tf_cos", """select p.pair_id, coalesce(c.cosine, 0.0) as cosine from fx_text_pairs p left join
 (select a.pair_id, sum(a.weight * b.weight) as cosine from tf_w a join tf_w b on a.pair_id = b.pair_id and a.term = b.term
  where a.side = 'query' and b.side = 'text' group by a.pair_id) c using (pair_id)"""),
]


def _tf(body):
    return O.with_views(body, "fx_text_pairs", extra=TF_CTES)


@register("union_corpora", _tf("select side, pair_id, cast(length(text) as integer) as n_chars from tf_docs"))
def q_union_corpora(spark, sf):
    return _docs(spark, sf).select("side", "pair_id", F.char_length("text").alias("n_chars"))


@register("tfidf_fit", _tf("select term, df, round(idf, 6) as idf from tf_v"))
def q_tfidf_fit(spark, sf):
    return rounded(tfidf.fit(_docs(spark, sf), ["side", "pair_id"]))


@register("tfidf_transform", _tf("select side, pair_id, term, round(weight, 6) as weight from tf_w"))
def q_tfidf_transform(spark, sf):
    return rounded(_weights(spark, sf))


@register("tfidf_pair_cosine", _tf("select pair_id, round(cosine, 6) as cosine from tf_cos"))
def q_tfidf_pair_cosine(spark, sf):
    w = _weights(spark, sf)
    cos = tfidf.pair_cosine(w.filter(F.col("side") == "query"), w.filter(F.col("side") == "text"), "pair_id",
                            fx.text_pairs(spark, sf))
    return rounded(cos)


@register("tfidf_mean_cosine", _tf("select round(avg(cosine), 6) as mean_cosine, count(*) as n_pairs from tf_cos"))
def q_tfidf_mean_cosine(spark, sf):
    w = _weights(spark, sf)
    cos = tfidf.pair_cosine(w.filter(F.col("side") == "query"), w.filter(F.col("side") == "text"), "pair_id",
                            fx.text_pairs(spark, sf))
    return rounded(cos.agg(F.avg("cosine").alias("mean_cosine"), F.count("*").alias("n_pairs")))


@register("top_terms", _tf("""select pair_id, term, rank, round(weight, 6) as weight from (select pair_id, term, weight,
 cast(row_number() over (partition by pair_id order by weight desc, term) as integer) as rank from tf_w where side = 'query') where rank <= 10"""))
def q_top_terms(spark, sf):
    """Per query: its 10 highest TF-IDF terms (rank 1 = highest)."""
    w = _weights(spark, sf).filter(F.col("side") == "query").drop("side")
    return rounded(tfidf.top_terms(w, "pair_id", 10).select("pair_id", "term", "rank", "weight"))


@register("tfidf_top_terms", _tf("""select pair_id, term, rank, round(weight, 6) as weight from (select pair_id, term, weight,
 cast(row_number() over (partition by pair_id order by weight desc, term) as integer) as rank from tf_w where side = 'query') where rank <= 10"""))
def q_tfidf_top_terms(spark, sf):
    """J5 (= E7): the data-quality notebook's top TF-IDF terms per query."""
    w = _weights(spark, sf).filter(F.col("side") == "query").drop("side")
    return rounded(tfidf.top_terms(w, "pair_id", 10).select("pair_id", "term", "rank", "weight"))


def _bucket_sql(key, seed=SEED):
    return f"(('0x' || substr(md5(concat(cast({key} as varchar), ':', '{seed}')), 1, 8))::BIGINT % 10000)"


@register("sample_n", O.with_views(
    f"select pair_id from fx_text_pairs order by md5(concat(cast(pair_id as varchar), ':', '{SEED}')), pair_id limit 10", "fx_text_pairs"))
def q_sample_n(spark, sf):
    return sampling.sample_n(fx.text_pairs(spark, sf).select("pair_id"), "pair_id", 10, SEED)


@register("sample_frac", O.with_views(f"select id from fx_collection where {_bucket_sql('id')} < 4000", "fx_collection"))
def q_sample_frac(spark, sf):
    return sampling.sample_frac(fx.collection(spark, sf).select("id"), "id", 0.4, SEED)


_SPLIT_SQL = f"""select id, case when {_bucket_sql('id')} < 250 then 'tune' when {_bucket_sql('id')} < 500 then 'test' else 'train' end as split from cc"""


@register("split_by_product", O.with_views(_SPLIT_SQL, "fx_collection", extra=O.clean_collection_ctes()))
def q_split_by_product(spark, sf):
    c = clean.clean_collection(fx.collection(spark, sf)).select("id")
    return sampling.split_by_key(c, "id", 0.05, SEED)


_ROWS_SQL = f"select pair_id, case when {_bucket_sql('pair_id')} < 8000 then 'train' else 'test' end as split from fx_text_pairs"


@register("split_rows", O.with_views(_ROWS_SQL, "fx_text_pairs"))
def q_split_rows(spark, sf):
    return sampling.split_rows(fx.text_pairs(spark, sf).select("pair_id"), "pair_id", 0.8, SEED)


@register("split_complement", O.with_views(
    f"select pair_id from fx_text_pairs except select pair_id from ({_ROWS_SQL}) where split = 'train'", "fx_text_pairs"))
def q_split_complement(spark, sf):
    p = fx.text_pairs(spark, sf).select("pair_id")
    train = sampling.split_rows(p, "pair_id", 0.8, SEED).filter(F.col("split") == "train")
    return p.join(train, "pair_id", "left_anti")


@register("split_members", O.with_views(
    f"select qid, docid, relevance_score from fx_qrels where docid in (select id from ({_SPLIT_SQL}) where split = 'train')",
    "fx_collection", "fx_qrels", extra=O.clean_collection_ctes()))
def q_split_members(spark, sf):
    c = clean.clean_collection(fx.collection(spark, sf)).select("id")
    train = sampling.split_by_key(c, "id", 0.05, SEED).filter(F.col("split") == "train").select(F.col("id").alias("docid"))
    return fx.qrels(spark, sf).join(train, "docid", "left_semi")


G_CTES = [
    ("g_items", "select id, row_number() over (order by id) - 1 as idx from (select distinct id from fx_generated)"),
    ("g_n", "select count(*) as n from g_items"),
    ("g_q", "select distinct id, q as query from (select id, unnest(queries) as q from fx_generated) where q <> ''"),
]


def _neg_sql(seed_expr, src):
    return f"""select d.*, i2.id as neg_id from {src} d join g_items i on i.id = d.id cross join g_n
 join g_items i2 on i2.idx = (i.idx + 1 + (('0x' || substr(md5(concat({seed_expr}, ':', '0')), 1, 8))::BIGINT % (g_n.n - 1))) % g_n.n
 where g_n.n >= 2"""


@register("negative_pairs", O.with_views(
    f"""select id, query, id as product_id, 1 as relevance_label from g_q
 union all select id, query, neg_id, 0 from ({_neg_sql("cast(d.id as varchar), ':', d.query", "g_q")})""",
    "fx_generated", extra=G_CTES))
def q_negative_pairs(spark, sf):
    """Per generated query: the positive product (label 1) and one other product drawn by index
    arithmetic (label 0)."""
    g = fx.generated(spark, sf)
    draws = g.select("id", F.explode(ordered_distinct_nonempty("queries")).alias("query"))
    pos = draws.select("id", "query", F.col("id").alias("product_id"), F.lit(1).alias("relevance_label"))
    d = draws.withColumn("_s", F.concat(F.col("id").cast("string"), F.lit(":"), F.col("query")))
    neg = sampling.negative_ids(g.select("id"), "id", d, "id", "_s") \
        .select("id", "query", F.col("neg_id").alias("product_id"), F.lit(0).alias("relevance_label"))
    return pos.unionByName(neg)


@register("other_products", O.with_views(
    f"select id, neg_id as other_id from ({_neg_sql('cast(d.id as varchar)', '(select distinct id from fx_generated)')})",
    "fx_generated", extra=G_CTES[:2]))
def q_other_products(spark, sf):
    """One other product per product (never itself), without an all-pairs anti join."""
    g = fx.generated(spark, sf).select("id")
    d = g.withColumn("_s", F.col("id").cast("string"))
    return sampling.negative_ids(g, "id", d, "id", "_s").select("id", F.col("neg_id").alias("other_id"))
