"""Registered queries: text-overlap metrics (H6-H9, L9-L11, D13), generation and synthetic pairs
(E8, M1-M3, M6-M8, C10, D15, D16), text encoders and their evaluation (K12, L7)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import ngrams, ordered_distinct_nonempty, rouge_tokens, tfidf_tokens
from ..operators.pairs import candidate_ids
from ..operators import clean, overlap, ranking, sampling, synth, vectors
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from ..sources import io
from ..sources.tables import table
from . import lexical
from . import oracle as O
from .q_quality import G_CTES, _bucket_sql, _neg_sql
from .registry import register, rounded

SEED = 119
DIM = 64


def NGRAM(t, n):
    return f"list_transform(range(0, len({t}) - {n} + 1), lambda i: array_to_string({t}[i + 1:i + {n}], ' '))"


def overlap_ctes(p, src, key, pred_tok, ref_tok, n):
    return [
        (f"{p}_t", f"select {key}, {pred_tok} as pt, {ref_tok} as rt from {src}"),
        (f"{p}_a", f"select {key}, g, count(*) as c from (select {key}, unnest({NGRAM('pt', n)}) as g from {p}_t) group by {key}, g"),
        (f"{p}_b", f"select {key}, g, count(*) as c from (select {key}, unnest({NGRAM('rt', n)}) as g from {p}_t) group by {key}, g"),
        (f"{p}_o", f"""select t.{key}, coalesce(o.ov, 0) as overlap, greatest(len(t.pt) - {n} + 1, 0) as pred_total,
 greatest(len(t.rt) - {n} + 1, 0) as ref_total, len(t.pt) as c, len(t.rt) as r from {p}_t t
 left join (select a.{key}, sum(least(a.c, b.c)) as ov from {p}_a a join {p}_b b on a.{key} = b.{key} and a.g = b.g group by a.{key}) o
 on o.{key} = t.{key}"""),
    ]


def F1(p):
    pp = f"({p}_o.overlap / greatest({p}_o.pred_total, 1))"
    rr = f"({p}_o.overlap / greatest({p}_o.ref_total, 1))"
    return f"(case when {pp} + {rr} > 0 then 2 * {pp} * {rr} / ({pp} + {rr}) else 0.0 end)"


def hashed_ctes(p, src, key, text, dim=DIM):
    return [
        (f"{p}_raw", f"""select {key}, cast(('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} as integer) as bucket,
 sum(case when ('0x' || substr(md5(term), 9, 2))::BIGINT % 2 = 0 then 1.0 else -1.0 end) as v
 from (select {key}, unnest({O.tfidf_tokens(text)}) as term from {src}) group by all"""),
        (p, f"""select r.{key}, r.bucket, coalesce(r.v / nullif(n.norm, 0), 0.0) as value from {p}_raw r
 join (select {key}, sqrt(sum(v * v)) as norm from {p}_raw group by {key}) n on n.{key} = r.{key}"""),
    ]


def _pairs(spark, sf):
    return fx.text_pairs(spark, sf)


# ---------------------------------------------------------------- tokens and n-grams

@register("rouge_tokens", O.with_views(
    f"select turn_id, cast(len({O.rouge_tokens('text')}) as integer) as n_tokens, array_to_string({O.rouge_tokens('text')}, ' ') as tokens from fx_turns",
    "fx_turns"))
def q_rouge_tokens(spark, sf):
    t = rouge_tokens("text")
    return fx.turns(spark, sf).select("turn_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("tfidf_tokens", O.with_views(
    f"select turn_id, cast(len({O.tfidf_tokens('text')}) as integer) as n_tokens, array_to_string({O.tfidf_tokens('text')}, ' ') as tokens from fx_turns",
    "fx_turns"))
def q_tfidf_tokens(spark, sf):
    t = tfidf_tokens(F.col("text"))
    return fx.turns(spark, sf).select("turn_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("ngrams", O.with_views(
    " union all ".join(f"""select turn_id, {n} as n, g as gram, count(*) as cnt from (select turn_id, unnest({NGRAM(O.rouge_tokens('text'), n)}) as g
 from fx_turns) group by turn_id, g""" for n in (1, 2)), "fx_turns"))
def q_ngrams(spark, sf):
    p = fx.turns(spark, sf).select("turn_id", rouge_tokens("text").alias("t"))
    return overlap.ngram_counts(p, "turn_id", "t", 1, "q").unionByName(overlap.ngram_counts(p, "turn_id", "t", 2, "q")) \
        .select("turn_id", "n", "gram", "cnt")


#: The table row by row: each step extends every pair's row by one token of the query (a running maximum over the columns).
_LCS_SQL = O.with_views(
    """select pair_id, cast(coalesce(list_max(s), 0) as bigint) as lcs from lcs_rows where i = len(a)""", "fx_text_pairs",
    extra=[("lcs_toks", f"select pair_id, {O.rouge_tokens('query')} as a, {O.rouge_tokens('product_text')} as b from fx_text_pairs"),
           ("lcs_rows(pair_id, a, b, i, s)", """select pair_id, a, b, 0, list_transform(b, lambda x: 0) from lcs_toks
 union all select pair_id, a, b, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) from (select pair_id, a, b, i,
 list_transform(range(1, len(b) + 1), lambda j: greatest(s[j], coalesce(s[j - 1], 0) + case when b[j] = a[i + 1] then 1 else 0 end)) as c
 from lcs_rows where i < len(a)) t""")]).replace("WITH ", "WITH RECURSIVE ", 1)


@register("lcs_length", _LCS_SQL)
def q_lcs_length(spark, sf):
    """Longest common subsequence of the ROUGE tokens of query and text."""
    p = _pairs(spark, sf).select("pair_id", rouge_tokens("query").alias("a"), rouge_tokens("product_text").alias("b"))
    return p.select("pair_id", overlap.lcs_length_udf(F.col("a"), F.col("b")).alias("lcs"))


# ---------------------------------------------------------------- ROUGE / BLEU

_R_CTES = (overlap_ctes("r1", "fx_text_pairs", "pair_id", O.rouge_tokens("query"), O.rouge_tokens("product_text"), 1)
           + overlap_ctes("r2", "fx_text_pairs", "pair_id", O.rouge_tokens("query"), O.rouge_tokens("product_text"), 2))


@register("rouge_n", O.with_views(
    f"select r1_o.pair_id, round({F1('r1')}, 6) as rouge1, round({F1('r2')}, 6) as rouge2 from r1_o join r2_o using (pair_id)",
    "fx_text_pairs", extra=_R_CTES))
def q_rouge_n(spark, sf):
    """ROUGE-1 / ROUGE-2 F1 of each query against its text."""
    return rounded(overlap.rouge_n(_pairs(spark, sf), "pair_id", "query", "product_text"))


@register("rouge")
def q_rouge(spark, sf):
    """ROUGE-1/2/L/Lsum F1 per pair (L and Lsum by per-row LCS; rows-only check)."""
    return rounded(overlap.rouge(_pairs(spark, sf), "pair_id", "query", "product_text"))


@register("rouge_mean")
def q_rouge_mean(spark, sf):
    r = overlap.rouge(_pairs(spark, sf), "pair_id", "query", "product_text")
    return rounded(r.agg(*[F.avg(c).alias(f"avg_{c}") for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")]))


_B_CTES = []
for _n in range(1, 5):
    _B_CTES += overlap_ctes(f"b{_n}", "fx_text_pairs", "pair_id", O.bleu_tokens("query"), O.bleu_tokens("product_text"), _n)
_PN = [f"(case when b{n}_o.pred_total > 0 then b{n}_o.overlap / b{n}_o.pred_total else 0.0 end)" for n in range(1, 5)]
_BLEU_SQL = O.with_views(
    f"""select b1_o.pair_id, round(case when b1_o.c = 0 or b1_o.r = 0 then 0.0
 when least({', '.join(_PN)}) > 0 then exp(({' + '.join(f'ln({x})' for x in _PN)}) / 4.0)
   * (case when b1_o.c > b1_o.r then 1.0 else exp(1.0 - b1_o.r / b1_o.c) end) else 0.0 end, 6) as bleu
 from b1_o join b2_o using (pair_id) join b3_o using (pair_id) join b4_o using (pair_id)""", "fx_text_pairs", extra=_B_CTES)


@register("bleu", _BLEU_SQL)
def q_bleu(spark, sf):
    """Sentence BLEU-4 (13a tokens, no smoothing) of each query against its text."""
    return rounded(overlap.bleu(_pairs(spark, sf), "pair_id", "query", "product_text"))


# ---------------------------------------------------------------- generated queries

_E8_SQL = O.with_views(
    """select id, cast(row_number() over (partition by id order by first_pos) - 1 as integer) as pos, q as query from
 (select id, q, min(p) as first_pos from (select id, unnest(queries) as q, unnest(generate_series(1, len(queries))) as p from fx_generated)
  where q <> '' group by id, q)""", "fx_generated")


def _ordered_distinct(spark, sf):
    g = fx.generated(spark, sf)
    return g.select("id", F.posexplode(ordered_distinct_nonempty("queries")).alias("pos", "query"))


@register("ordered_distinct", _E8_SQL)
def q_ordered_distinct(spark, sf):
    return _ordered_distinct(spark, sf)


@register("clean_generated", _E8_SQL)
def q_clean_generated(spark, sf):
    """Generated queries cleaned: unique in generation order, empties removed (= ordered_distinct)."""
    return _ordered_distinct(spark, sf)


@register("queries_by_product", O.with_views(
    """select md5(product_text) as text_key, max(id) as id, cast(len(arg_max(qs, id)) as integer) as n_queries, array_to_string(arg_max(qs, id), chr(10)) as queries
 from (select id, product_text, list_filter(queries, lambda x, i: x <> '' and list_position(queries, x) = i) as qs from fx_generated) t group by product_text""", "fx_generated"))
def q_queries_by_product(spark, sf):
    """One query list per distinct product text; of rows with the same text the last replaces the earlier ones."""
    g = synth.queries_by_text(fx.generated(spark, sf).withColumn("queries", ordered_distinct_nonempty("queries")))
    return g.select("text_key", "id", F.size("queries").alias("n_queries"), F.array_join("queries", "\n").alias("queries"))


_GEN_CTES = O.clean_collection_ctes() + [
    ("gn_tc", f"select id, term, count(*) as tf from (select id, unnest({O.tfidf_tokens('product_text')}) as term from cc) group by id, term"),
    ("gn_v", "select term, ln((1 + (select count(*) from cc)) / (1 + count(*))) + 1 as idf from gn_tc group by term"),
    ("gn_w0", "select t.id, t.term, t.tf * v.idf as w from gn_tc t join gn_v v using (term)"),
    ("gn_w", "select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from gn_w0"),
    ("gn_top", "select id, term from (select id, term, row_number() over (partition by id order by weight desc, term) as rk from gn_w) where rk <= 45"),
    ("gn_first", f"""select id, term, min(pos) as first_pos from (select id, unnest({O.tfidf_tokens('product_text')}) as term,
 unnest(generate_series(0, len({O.tfidf_tokens('product_text')}) - 1)) as pos from cc) group by id, term"""),
    ("gn_j", "select t.id, t.term, f.first_pos, (row_number() over (partition by t.id order by f.first_pos) - 1) // 9 as qpos from gn_top t join gn_first f using (id, term)"),
    ("gn", "select id, cast(qpos as integer) as qpos, string_agg(term, ' ' order by first_pos) as query from gn_j group by id, qpos"),
]


@register("generate_queries", O.with_views("select id, qpos, query from gn", "fx_collection", extra=_GEN_CTES))
def q_generate_queries(spark, sf):
    """Built-in extractive generator: up to 5 queries of <= 9 top TF-IDF terms, in text order."""
    c = clean.clean_collection(fx.collection(spark, sf))
    return synth.generate_queries(c, "id", "product_text", num_queries=5, window=9)


_SP_CTES = G_CTES + [
    ("sp_neg", _neg_sql("cast(d.id as varchar), ':', d.query", "g_q")),
    ("sp", """select g.query, f.product_text, 1 as label from g_q g join fx_generated f using (id)
 union all select n.query, f.product_text, 0 from sp_neg n join fx_generated f on f.id = n.neg_id"""),
]


def _text_key(col):
    """Key by which texts are matched: no text is shuffled."""
    return F.sha2(col, 256)


def _synthetic(spark, sf, negatives: bool = True):
    """``(query, text_key, label)``: every generated query with its product, and with ``negatives`` with one drawn product."""
    g = fx.generated(spark, sf)
    draws = g.select("id", F.explode(ordered_distinct_nonempty("queries")).alias("query"))
    texts = g.select("id", _text_key("product_text").alias("text_key"))
    pos = draws.join(texts, "id").select("query", "text_key", F.lit(1).alias("label"))
    if not negatives:
        return pos
    d = draws.withColumn("_s", F.concat(F.col("id").cast("string"), F.lit(":"), F.col("query")))
    neg = sampling.negative_ids(g.select("id"), "id", d, "id", "_s") \
        .join(texts.withColumnRenamed("id", "neg_id"), "neg_id").select("query", "text_key", F.lit(0).alias("label"))
    return pos.unionByName(neg)


def _ids_by_text(spark, sf, rows):
    """``rows`` with the ids of all documents that have their text (as many rows as there are such documents)."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _text_key("text").alias("text_key"))
    return rows.join(docs, "text_key").drop("text_key")


@register("synthetic_pairs_only", O.with_views(
    "select s.query, d.doc_id as id, s.label as relevance_label from sp s join documents d on d.text = s.product_text where s.label = 1",
    "fx_generated", extra=_SP_CTES))
def q_synthetic_pairs_only(spark, sf):
    """The same without negatives, as the switch for them has it."""
    return _ids_by_text(spark, sf, _synthetic(spark, sf, negatives=False)).select("query", "id", F.col("label").alias("relevance_label"))


@register("synthetic_pairs", O.with_views(
    "select s.query, d.doc_id as id, s.label as relevance_label from sp s join documents d on d.text = s.product_text",
    "fx_generated", extra=_SP_CTES))
def q_synthetic_pairs(spark, sf):
    """Generated queries as (query, product, label) with one drawn negative each, ids attached
    by text (a natural join that fans out on duplicate texts)."""
    return _ids_by_text(spark, sf, _synthetic(spark, sf)).select("query", "id", F.col("label").alias("relevance_label"))


@register("attach_ids_by_text", O.with_views(
    "select f.id as gen_id, d.doc_id as id from fx_generated f join documents d on d.text = f.product_text", "fx_generated"))
def q_attach_ids_by_text(spark, sf):
    rows = fx.generated(spark, sf).select(F.col("id").alias("gen_id"), _text_key("product_text").alias("text_key"))
    return _ids_by_text(spark, sf, rows).select("gen_id", "id")


# ---------------------------------------------------------------- encoders

@register("embed_texts", O.with_views("select qid, bucket, round(value, 6) as value from hq", "fx_queries",
                                      extra=hashed_ctes("hq", "fx_queries", "qid", "text")))
def q_embed_texts(spark, sf):
    """Built-in signed hashed encoder (64 buckets), sparse ``(qid, bucket, value)``."""
    return rounded(synth.hashed_sparse(fx.queries(spark, sf), "qid", "text", DIM))


@register("embed_pairs", O.with_views(
    """select g.id, g.query, round(coalesce(n.qn, 0.0), 6) as q_norm, g.id in (select id from fx_vec_products) as has_product_vector
 from g_q g left join (select pk, sqrt(sum(value * value)) as qn from hp group by pk) n on n.pk = md5(concat(cast(g.id as varchar), ':', g.query))""",
    "fx_generated", "fx_vec_products",
    extra=G_CTES + [("g_qk", "select md5(concat(cast(id as varchar), ':', query)) as pk, query from g_q")] + hashed_ctes("hp", "g_qk", "pk", "query")))
def q_embed_pairs(spark, sf):
    """Positive synthetic pairs + query vector (hashed encoder) + product vector by left join, written as one table of pairs and read back."""
    products = fx.vec_products(spark, sf).select("id", "product_embedding")
    path = scratch_path(spark, "embedded-pairs")
    io.write_parquet(synth.embed_pairs(fx.generated(spark, sf), products, DIM), path, "gzip")
    back = io.read_parquet(spark, path)
    return rounded(back.select("id", "query", F.coalesce(V.norm("query_embedding"), F.lit(0.0)).alias("q_norm"),
                               F.col("product_embedding").isNotNull().alias("has_product_vector")))


_L7_CTES = (O.clean_collection_ctes() + O.eval_input_ctes() + hashed_ctes("hq", "ev_evalq", "qid", "text")
            + hashed_ctes("hd", "cc", "id", "product_text") + [
                ("l7_d", """select j.qid, j.docid, j.relevance_score,
 round(sqrt(greatest(coalesce(qq.s, 0) + coalesce(dd.s, 0) - 2 * coalesce(qd.s, 0), 0)), 9) as score
 from ev_j j left join (select qid, sum(value * value) as s from hq group by qid) qq on qq.qid = j.qid
 left join (select id, sum(value * value) as s from hd group by id) dd on dd.id = j.docid
 left join (select j2.qid, j2.docid, sum(q.value * d.value) as s from ev_j j2 join hq q on q.qid = j2.qid
            join hd d on d.id = j2.docid and d.bucket = q.bucket group by j2.qid, j2.docid) qd on qd.qid = j.qid and qd.docid = j.docid""")]
            + O.metric_ctes("l7_d", 5, 10, asc=True, evaluated="ev_evalq"))


@register("eval_encoder", O.with_views(
    """select round(avg(ndcg), 6) as ndcg, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall,
 count(*) as n_queries, cast(count_if(ndcg is null) as bigint) as n_undefined from mt_pq""", "fx_collection", "fx_queries", "fx_qrels", extra=_L7_CTES))
def q_eval_encoder(spark, sf):
    """Encoder retrieval: queries and collection through the hashed encoder, judged documents
    ranked by ascending Euclidean distance; macro NDCG@5 / P@10 / R@10."""
    coll = clean.clean_collection(fx.collection(spark, sf))
    q, judged = lexical.eval_inputs(fx.queries(spark, sf), fx.qrels(spark, sf), coll)
    evalq = q.filter(F.col("text").isNotNull())
    j = judged.join(evalq.select("qid"), "qid", "left_semi")
    hq = synth.hashed_sparse(evalq, "qid", "text", DIM)
    hd = synth.hashed_sparse(coll.select(F.col("id").alias("docid"), "product_text"), "docid", "product_text", DIM)
    scored = synth.sparse_distance(hq, hd, j).select("qid", "docid", "relevance_score", F.round("distance", 9).alias("score"))
    return rounded(ranking.macro_mean(ranking.per_query_metrics(evalq, scored, 5, 10, ascending=True)))


# ---------------------------------------------------------------- two-tower training data

def _kept_pairs(spark, sf, threshold=0.2):
    q, p, r = fx.vec_queries(spark, sf), fx.vec_products(spark, sf), fx.vec_qrels(spark, sf)
    s = vectors.pair_scores(r.filter("relevance_score >= 1").select("qid", "docid"), q, p)
    s = clean.drop_null_subset(s, ["score"]).filter(F.round("score", 6) >= threshold)
    return s.withColumn("pk", F.concat(F.col("qid").cast("string"), F.lit(":"), F.col("docid").cast("string")))


_M7_CTES = [("m7_k", f"""select r.qid, r.docid, concat(cast(r.qid as varchar), ':', cast(r.docid as varchar)) as pk
 from fx_vec_qrels r join fx_vec_queries q on q.qid = r.qid join fx_vec_products p on p.id = r.docid
 where r.relevance_score >= 1 and round(coalesce(list_dot_product(q.query_embedding, p.product_embedding) / nullif(sqrt(list_dot_product(q.query_embedding, q.query_embedding)) * sqrt(list_dot_product(p.product_embedding, p.product_embedding)), 0), 0.0), 6) >= 0.2"""),
            ("m7", f"select qid, docid, case when {_bucket_sql('pk')} < 8000 then 'train' else 'test' end as split from m7_k")]


@register("training_set", O.with_views("select qid, docid, split from m7", "fx_vec_queries", "fx_vec_products", "fx_vec_qrels", extra=_M7_CTES))
def q_training_set(spark, sf):
    """Pairs with vectors, nulls dropped, cosine >= 0.2, split 80/20 by hash of the pair."""
    return sampling.split_rows(_kept_pairs(spark, sf), "pk", 0.8, SEED).select("qid", "docid", "split")


@register("candidate_set", O.with_views("select distinct docid as id from m7", "fx_vec_queries", "fx_vec_products", "fx_vec_qrels", extra=_M7_CTES))
def q_candidate_set(spark, sf):
    return candidate_ids(_kept_pairs(spark, sf))


@register("candidate_set_all", O.with_views("select distinct id from fx_collection where id is not null", "fx_collection"))
def q_candidate_set_all(spark, sf):
    """The whole collection as candidates."""
    return candidate_ids(_kept_pairs(spark, sf), fx.collection(spark, sf))


@register("pair_counts", O.with_views(
    """select count(distinct docid) as n_products, count(*) as n_pairs, (select count(*) from fx_vec_products) as n_candidates,
 cast(count_if(split = 'train') as bigint) as n_train from m7""", "fx_vec_queries", "fx_vec_products", "fx_vec_qrels", extra=_M7_CTES))
def q_pair_counts(spark, sf):
    t = sampling.split_rows(_kept_pairs(spark, sf), "pk", 0.8, SEED)
    n_cand = fx.vec_products(spark, sf).agg(F.count("*")).scalar()
    return t.agg(F.count_distinct("docid").alias("n_products"), F.count("*").alias("n_pairs"),
                 n_cand.alias("n_candidates"), F.count_if(F.col("split") == "train").alias("n_train"))


# ---------------------------------------------------------------- decoding-setting search

SETTINGS = [(5, 3), (5, 5), (9, 3), (9, 5)]  # (window, num_queries)


@register("generation_score")
def q_generation_score(spark, sf):
    """Score = 1.5 * mean(ROUGE-1/2/L/Lsum of generated vs true query) + 1.0 * mean cosine
    (product vs generated queries, hashed encoder), per generator setting; rows-only check."""
    pairs = materialize(_pairs(spark, sf).select(F.col("pair_id").alias("id"), "query", "product_text"), "scored-pairs")
    # the terms are weighed once for all settings, which differ in how many they take and where they cut
    ranked = synth.ranked_terms(pairs, "id", "product_text", max(window * nq for window, nq in SETTINGS))
    own = pairs.groupBy("id").agg(F.collect_list(F.struct("query")).alias("refs"), F.array_join(F.collect_list("product_text"), "\n").alias("text"))
    ranked = materialize(ranked.join(synth.embed_rows(own, "text", DIM, "pv").drop("text"), "id"), "ranked-terms")
    gen = functools.reduce(DataFrame.unionByName, [synth.queries_of_terms(ranked, "id", nq, window).select(
        F.lit(window).alias("window"), F.lit(nq).alias("num_queries"), "*") for window, nq in SETTINGS])
    cand = synth.embed_rows(gen, "query", DIM, "qv").select(
        "window", "num_queries", F.concat_ws(":", "window", "num_queries", "id", "qpos").alias("cid"), "query", V.cosine("qv", "pv").alias("cosine"),
        F.explode("refs.query").alias("ref"))
    cand = materialize(cand, "candidate-queries")
    r = overlap.rouge(cand, "cid", "query", "ref").select("*", *[F.split_part("cid", F.lit(":"), F.lit(i)).cast("int").alias(c)
                                                                for i, c in ((1, "window"), (2, "num_queries"))])
    by = ["window", "num_queries"]
    rmean = r.groupBy(*by).agg(((F.avg("rouge1") + F.avg("rouge2") + F.avg("rougeL") + F.avg("rougeLsum")) / 4).alias("rouge"))
    cos = cand.groupBy(*by).agg(F.avg("cosine").alias("cosine"))
    out = spark.createDataFrame(SETTINGS, "window int, num_queries int").join(rmean, by, "left").join(cos, by, "left")
    return rounded(out.select(*by, "rouge", "cosine", (F.lit(1.5) * F.col("rouge") + F.lit(1.0) * F.col("cosine")).alias("score")))
