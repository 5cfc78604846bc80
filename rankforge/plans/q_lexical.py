"""Registered queries: tokenisation (H1-H3), BM25 index, search, evaluation and tuning (I1-I8, A11),
ranking helpers (E2, E4, E5, E9) and per-query metrics (L1-L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import python_tokenizer, tokenize
from ..operators import bm25, clean, ranking
from ..session import scratch_path
from ..sources import fixtures as fx
from . import lexical
from . import oracle as O
from .registry import register, rounded

VIEWS3 = ("fx_collection", "fx_queries", "fx_qrels")


def _coll(spark, sf):
    return clean.clean_collection(fx.collection(spark, sf))


def _index(spark, sf, lemmatize=False, **params):
    prm = {**bm25.FIXED_PARAMS, **params}
    return bm25.build_index(_coll(spark, sf), lemmatize=lemmatize, **prm)


def _scored(spark, sf, lemmatize=False, **params):
    coll = _coll(spark, sf)
    index = bm25.build_index(coll, lemmatize=lemmatize, **{**bm25.FIXED_PARAMS, **params})
    q, judged = lexical.eval_inputs(fx.queries(spark, sf), fx.qrels(spark, sf), index.doc_ids)
    evalq = q.filter(F.col("text").isNotNull())
    return evalq, lexical.score_judged(index, evalq, judged)


def _ctes(lemmatize=False, k1=1.2, b=0.9, eps=0.1):
    return (O.clean_collection_ctes() + O.bm25_index_ctes(k1=k1, b=b, eps=eps, lemmatize=lemmatize)
            + O.eval_input_ctes() + O.bm25_judged_scored_ctes(k1=k1, b=b, lemmatize=lemmatize))


_MACRO = """select round(avg(ndcg), 6) as ndcg, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall,
 count(*) as n_queries, cast(count_if(ndcg is null) as bigint) as n_undefined from mt_pq"""


@register("eval_bm25", O.with_views(_MACRO, *VIEWS3, extra=_ctes() + O.metric_ctes("ev_scored", 5, 10, evaluated="ev_evalq")))
def q_eval_bm25(spark, sf):
    """Flagship: judged-first BM25 evaluation (k1 1.2, b 0.9, epsilon 0.1; NDCG@5, P@10, R@10)."""
    coll = _coll(spark, sf)
    return rounded(lexical.evaluate_bm25(fx.queries(spark, sf), fx.qrels(spark, sf), coll, p=5, k=10))


@register("eval_bm25_lemma", O.with_views(_MACRO, *VIEWS3, extra=_ctes(True) + O.metric_ctes("ev_scored", 5, 10, evaluated="ev_evalq")))
def q_eval_bm25_lemma(spark, sf):
    """As eval_bm25 with the noun lemmatiser on (candidates checked against the corpus vocabulary)."""
    coll = _coll(spark, sf)
    return rounded(lexical.evaluate_bm25(fx.queries(spark, sf), fx.qrels(spark, sf), coll, p=5, k=10, lemmatize=True))


@register("bm25_fixed", O.with_views("select qid, ndcg, round(precision, 6) as precision, round(recall, 6) as recall from mt_pq",
                                     *VIEWS3, extra=_ctes() + O.metric_ctes("ev_scored", 10, 10, evaluated="ev_evalq")))
def q_bm25_fixed(spark, sf):
    """Per-query NDCG@10 / P@10 / R@10 of the untuned build (k1 1.2, b 0.9, epsilon 0.1)."""
    evalq, scored = _scored(spark, sf)
    return rounded(ranking.per_query_metrics(evalq, scored, 10, 10))


@register("macro_mean", O.with_views(_MACRO, *VIEWS3, extra=_ctes() + O.metric_ctes("ev_scored", 10, 10, evaluated="ev_evalq")))
def q_macro_mean(spark, sf):
    """Mean over queries of NDCG@10 / P@10 / R@10 (undefined NDCG excluded and counted)."""
    evalq, scored = _scored(spark, sf)
    return rounded(ranking.macro_mean(ranking.per_query_metrics(evalq, scored, 10, 10)))


@register("bm25_custom_tokenizer", O.with_views("select term, id, tf from bm_post", "fx_collection",
                                                extra=O.clean_collection_ctes() + O.bm25_index_ctes()))
def q_bm25_custom_tokenizer(spark, sf):
    """Index built with a user tokenizer callable (run batch-wise as a pandas UDF); here the
    callable re-implements the built-in rules in Python, so postings must be identical."""
    return bm25.build_index(_coll(spark, sf), tokenizer=python_tokenizer).postings


@register("ndcg_at_p", O.with_views("select qid, ndcg from mt_pq", *VIEWS3,
                                    extra=_ctes() + O.metric_ctes("ev_scored", 10, 10, evaluated="ev_evalq")))
def q_ndcg_at_p(spark, sf):
    evalq, scored = _scored(spark, sf)
    return ranking.per_query_metrics(evalq, scored, 10, 10).select("qid", "ndcg")


@register("precision_at_k", O.with_views("select qid, round(precision, 6) as precision from mt_pq", *VIEWS3,
                                         extra=_ctes() + O.metric_ctes("ev_scored", 5, 5, evaluated="ev_evalq")))
def q_precision_at_k(spark, sf):
    evalq, scored = _scored(spark, sf)
    return rounded(ranking.per_query_metrics(evalq, scored, 5, 5).select("qid", "precision"))


@register("recall_at_k", O.with_views("select qid, round(recall, 6) as recall from mt_pq", *VIEWS3,
                                      extra=_ctes() + O.metric_ctes("ev_scored", 10, 10, evaluated="ev_evalq")))
def q_recall_at_k(spark, sf):
    evalq, scored = _scored(spark, sf)
    return rounded(ranking.per_query_metrics(evalq, scored, 10, 10).select("qid", "recall"))


@register("bm25_scores", O.with_views("select qid, docid, round(score, 6) as score from ev_scored", *VIEWS3, extra=_ctes()))
def q_bm25_scores(spark, sf):
    _, scored = _scored(spark, sf)
    return rounded(scored.select("qid", "docid", "score"))


@register("rank_judged", O.with_views(
    "select qid, docid, cast(row_number() over (partition by qid order by score desc, docid) as integer) as rank from ev_scored",
    *VIEWS3, extra=_ctes()))
def q_rank_judged(spark, sf):
    _, scored = _scored(spark, sf)
    return ranking.rank_distributed(scored, "score").select("qid", "docid", "rank")


@register("positional_rank", O.with_views(
    """select * from (select qid, docid, cast(row_number() over (partition by qid order by score desc, docid) as integer) as rank
 from ev_scored) where rank <= 5""", *VIEWS3, extra=_ctes()))
def q_positional_rank(spark, sf):
    _, scored = _scored(spark, sf)
    return ranking.rank_within(scored, "score").filter(F.col("rank") <= 5).select("qid", "docid", "rank")


@register("ground_truth", O.with_views(
    """select qid, docid, relevance_score, cast(row_number() over (partition by qid order by relevance_score desc, docid) as integer) as rank
 from fx_qrels where docid in (select id from cc)""", "fx_collection", "fx_qrels", extra=O.clean_collection_ctes()))
def q_ground_truth(spark, sf):
    return ranking.ground_truth(fx.qrels(spark, sf), _coll(spark, sf))


_TOK_Q = O.with_views(f"select qid, cast(len({O.tokenize('text')}) as integer) as n_tokens, array_to_string({O.tokenize('text')}, ' ') as tokens from fx_queries",
                      "fx_queries")


@register("tokenize", _TOK_Q)
def q_tokenize(spark, sf):
    t = tokenize(F.col("text"))
    return fx.queries(spark, sf).select("qid", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("tokenize_corpus", O.with_views("select id, cast(len(tokens) as integer) as n_tokens, array_to_string(tokens, ' ') as tokens from bm_tok",
                                          "fx_collection", extra=O.clean_collection_ctes() + O.bm25_index_ctes()[:1]))
def q_tokenize_corpus(spark, sf):
    t = bm25.tokenize_corpus(_coll(spark, sf))
    return t.select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@register("tokenized_corpus", O.with_views("select id, cast(len(tokens) as integer) as n_tokens, array_to_string(tokens, ' ') as tokens from bm_tok",
                                           "fx_collection", extra=O.clean_collection_ctes() + O.bm25_index_ctes()[:1]))
def q_tokenized_corpus(spark, sf):
    """Token lists persisted as Parquet ``(id, tokens)`` keyed by id, reloaded for tuning."""
    path = scratch_path(spark, "tokens")
    bm25.tokenize_corpus(_coll(spark, sf)).write.mode("overwrite").parquet(path)
    t = spark.read.parquet(path)
    return t.select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@register("tokenize_errors", O.with_views(
    f"select qid, cast(len({O.tokenize('text')}) as integer) as n_tokens from fx_queries where text is null", "fx_queries"))
def q_tokenize_errors(spark, sf):
    """NULL text tokenises to an empty list (the reference would fail later on len(NaN))."""
    q = fx.queries(spark, sf).filter(F.col("text").isNull())
    return q.select("qid", F.size(tokenize(F.col("text"))).alias("n_tokens"))


@register("bm25_postings", O.with_views("select term, id, tf from bm_post", "fx_collection",
                                        extra=O.clean_collection_ctes() + O.bm25_index_ctes()))
def q_bm25_postings(spark, sf):
    return _index(spark, sf).postings


@register("bm25_corpus_stats", O.with_views(
    "select n as corpus_size, round(avgdl, 6) as avgdl, 1.2::double as k1, 0.9::double as b, 0.1::double as epsilon from bm_cstat", "fx_collection",
    extra=O.clean_collection_ctes() + O.bm25_index_ctes()))
def q_bm25_corpus_stats(spark, sf):
    return rounded(_index(spark, sf).corpus_stats())


@register("bm25_doc_freq", O.with_views("select term, df from bm_tstat", "fx_collection",
                                        extra=O.clean_collection_ctes() + O.bm25_index_ctes()))
def q_bm25_doc_freq(spark, sf):
    return _index(spark, sf).term_stats.select("term", "df")


@register("bm25_idf", O.with_views("select term, df, round(idf_raw, 6) as idf_raw, round(idf, 6) as idf from bm_tstat", "fx_collection",
                                   extra=O.clean_collection_ctes() + O.bm25_index_ctes()))
def q_bm25_idf(spark, sf):
    return rounded(_index(spark, sf).term_stats)


def _search_sql(n, k1, b, eps):
    return O.with_views(
        f"""select qid, id, rank, round(round(score, 9), 6) as score from (select qid, id, score,
 cast(row_number() over (partition by qid order by round(score, 9) desc, id) as integer) as rank from sr_m) where rank <= {n}""",
        "fx_collection", "fx_queries",
        extra=O.clean_collection_ctes() + O.bm25_index_ctes(k1=k1, b=b, eps=eps) + O.bm25_query_term_ctes("fx_queries") + [
            ("sr_m", f"""select qt.qid, p.id, sum(qt.qtf * t.idf * p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b} + {b} * d.doc_len / c.avgdl))) as score
 from ev_qt qt join bm_tstat t on t.term = qt.term join bm_post p on p.term = qt.term join bm_dstat d on d.id = p.id
 cross join bm_cstat c group by qt.qid, p.id""")])


@register("bm25_search", _search_sql(5, 1.2, 0.9, 0.1))
def q_bm25_search(spark, sf):
    """Top-5 documents of every query over the whole collection (fixed parameters)."""
    return rounded(bm25.search(_index(spark, sf), fx.queries(spark, sf), n=5).select("qid", "id", "rank", "score"))


@register("bm25_search_pruned", _search_sql(5, 1.2, 0.9, 0.1))
def q_bm25_search_pruned(spark, sf):
    """The same search by score bounds: documents that cannot be among the 5 best are not scored."""
    return rounded(bm25.search(_index(spark, sf), fx.queries(spark, sf), n=5, prune=True).select("qid", "id", "rank", "score"))


@register("bm25_top_n", _search_sql(10, 1.5, 0.75, 0.25))
def q_bm25_top_n(spark, sf):
    """Top-10 per query with the class-default parameters (k1 1.5, b 0.75, epsilon 0.25)."""
    idx = _index(spark, sf, **bm25.DEFAULT_PARAMS)
    return rounded(bm25.search(idx, fx.queries(spark, sf), n=10).select("qid", "id", "rank", "score"))


def _grid_sql():
    rows = bm25.grid_rows()
    vals = ", ".join(f"({r['g']}, {r['b']}, {r['epsilon']}, {r['k1']})" for r in rows)
    ctes = O.clean_collection_ctes() + O.bm25_index_ctes() + O.eval_input_ctes() + [
        ("gt_grid", f"select g, b::double as b, epsilon::double as epsilon, k1::double as k1 from (values {vals}) x(g, b, epsilon, k1)"),
        ("gt_s", "select * from ev_q order by md5(concat(cast(qid as varchar), ':', '119')), qid limit 10"),
        ("gt_e", "select qid, text from gt_s where text is not null"),
        ("gt_j", "select * from ev_judged where qid in (select qid from gt_e)"),
    ] + O.bm25_query_term_ctes("gt_e") + [
        ("gt_m", """select g.g, j.qid, j.docid, sum(qt.qtf * (case when t.idf_raw < 0 then g.epsilon * mi.mean_idf else t.idf_raw end) * p.tf * (g.k1 + 1)
   / (p.tf + g.k1 * (1 - g.b + g.b * d.doc_len / c.avgdl))) as score
 from gt_j j join ev_qt qt on j.qid = qt.qid join bm_tstat t on t.term = qt.term join bm_post p on p.term = qt.term and p.id = j.docid
 join bm_dstat d on d.id = j.docid cross join bm_cstat c cross join bm_mi mi cross join gt_grid g group by g.g, j.qid, j.docid"""),
        ("gt_scored", """select g.g, j.qid, j.docid, j.relevance_score, round(coalesce(m.score, 0.0), 9) as score
 from gt_j j cross join gt_grid g left join gt_m m on m.g = g.g and m.qid = j.qid and m.docid = j.docid"""),
    ] + O.metric_ctes("gt_scored", 5, 10, group="g") + [
        ("gt_score", "select g.g, g.b, g.epsilon, g.k1, coalesce(round(avg(m.ndcg), 9), 0.0) as score from gt_grid g left join mt_per m using (g) group by g.g, g.b, g.epsilon, g.k1"),
    ]
    return O.with_views("select b, epsilon, k1, round(score, 6) as score from gt_score order by score desc, g limit 1", *VIEWS3, extra=ctes)


@register("bm25_grid_tune", _grid_sql())
def q_bm25_grid_tune(spark, sf):
    """3x3x3 grid scored by NDCG@5 on 10 hash-sampled queries; first best in grid order wins."""
    return rounded(lexical.tune_bm25(fx.queries(spark, sf), fx.qrels(spark, sf), _coll(spark, sf)))


@register("bm25_index_io", O.with_views("select term, df, round(idf_raw, 6) as idf_raw, round(idf, 6) as idf from bm_tstat",
                                        "fx_collection", extra=O.clean_collection_ctes() + O.bm25_index_ctes()))
def q_bm25_index_io(spark, sf):
    """Save all index parts (+ k1, b, epsilon) as Parquet and load them back."""
    path = scratch_path(spark, "bm25-index")
    bm25.save_index(_index(spark, sf), path)
    return rounded(bm25.load_index(spark, path).term_stats)
