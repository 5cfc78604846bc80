"""Registered queries: judgements, triples and pair building (B8, B10, B11, B13-B15, C1-C6, F1, M4),
and the file sources / sinks (A1-A7) as write-then-read round trips in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import instruct_prefix
from ..operators import clean, pairs, ranking
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import io
from ..sources.tables import table
from . import oracle as O
from .registry import register

INSTRUCT_TASK = "Given a product search query, retrieve relevant products"


def _coll(spark, sf):
    return clean.clean_collection(fx.collection(spark, sf))


def _flat(spark, sf):
    return pairs.triples_from_qrels(fx.qrels(spark, sf), table(spark, sf, "documents"), fx.queries(spark, sf))


TRI = [("tri", """select r.qid as query_id, q.text as query, case when r.relevance_score >= 1 then 'positive' else 'negative' end as kind,
 r.docid, d.text from fx_qrels r join documents d on d.doc_id = r.docid left join fx_queries q on q.qid = r.qid""")]
FP = [("fp_kept", "select * from tri where docid in (select id from cc)"),
      ("fp", "select * from fp_kept where query_id in (select query_id from fp_kept where kind = 'positive')")]
BP = [("bp_pos", "select query_id, query, text as product_description, docid as product_id from fp where kind = 'positive'"),
      ("bp_t", "select p.*, c.title from bp_pos p left join cc c on p.product_id = c.id")] \
    + O.clean_collection_ctes("bp_t", "product_description", "title", "query_id, product_id", "pc") \
    + [("bp", """select pc.*, r.qid, r.docid, r.relevance_score from pc left join fx_qrels r
 on pc.query_id = r.qid and pc.product_id = r.docid where r.relevance_score >= 2""")]
VIEWS3 = ("fx_collection", "fx_queries", "fx_qrels")


@register("filter_relevance", O.with_views("select qid, docid, relevance_score from fx_qrels where relevance_score >= 2", "fx_qrels"))
def q_filter_relevance(spark, sf):
    return ranking.filter_relevance(fx.qrels(spark, sf))


@register("skip_null_queries", O.with_views("select qid, text from fx_queries where text is not null", "fx_queries"))
def q_skip_null_queries(spark, sf):
    return fx.queries(spark, sf).filter(F.col("text").isNotNull())


@register("filter_ids", O.with_views(
    "select id, title from cc where id in (select docid from fx_qrels where relevance_score >= 2)", *VIEWS3,
    extra=O.clean_collection_ctes()))
def q_filter_ids(spark, sf):
    ids = fx.qrels(spark, sf).filter(F.col("relevance_score") >= 2).select(F.col("docid").alias("id"))
    return _coll(spark, sf).join(ids, "id", "left_semi").select("id", "title")


@register("point_lookup", O.with_views(
    "select docid, count(*) as n_queries, max(relevance_score) as max_relevance from fx_qrels group by docid", "fx_qrels"))
def q_point_lookup(spark, sf):
    """Per-product lookups as one grouped plan instead of a loop of point filters."""
    return fx.qrels(spark, sf).groupBy("docid").agg(F.count("*").alias("n_queries"),
                                                    F.max("relevance_score").alias("max_relevance"))


@register("single_query_products", O.with_views(
    """select qid, docid, relevance_score from (select *, count(*) over (partition by docid) as n from fx_qrels where relevance_score >= 1)
 where n = 1""", "fx_qrels"))
def q_single_query_products(spark, sf):
    return pairs.single_query_products(fx.qrels(spark, sf).filter(F.col("relevance_score") >= 1))


@register("instruct_prefix", O.with_views(
    f"select qid, concat('Instruct: ', {O.lit(INSTRUCT_TASK)}, chr(10), 'Query: ', text) as prompt from fx_queries where text is not null",
    "fx_queries"))
def q_instruct_prefix(spark, sf):
    q = fx.queries(spark, sf).filter(F.col("text").isNotNull())
    return q.select("qid", instruct_prefix(INSTRUCT_TASK, "text").alias("prompt"))


@register("attach_title", O.with_views(
    "select f.query_id, f.docid as product_id, c.title from fp f left join cc c on f.docid = c.id where f.kind = 'positive'",
    *VIEWS3, extra=O.clean_collection_ctes() + TRI + FP))
def q_attach_title(spark, sf):
    coll = _coll(spark, sf)
    f = pairs.filter_passages(_flat(spark, sf), coll).filter(F.col("kind") == "positive")
    return pairs.attach_title(f.select("query_id", F.col("docid").alias("product_id")), coll)


@register("attach_relevance", O.with_views(
    """select f.query_id, f.docid as product_id, r.relevance_score from fp f join fx_qrels r on f.query_id = r.qid and f.docid = r.docid
 where f.kind = 'positive' and r.relevance_score >= 2""", *VIEWS3, extra=O.clean_collection_ctes() + TRI + FP))
def q_attach_relevance(spark, sf):
    coll = _coll(spark, sf)
    f = pairs.filter_passages(_flat(spark, sf), coll).filter(F.col("kind") == "positive") \
        .select("query_id", F.col("docid").alias("product_id"))
    return pairs.attach_relevance(f, fx.qrels(spark, sf)).select("query_id", "product_id", "relevance_score")


@register("dev_judgements", O.with_views(
    """select r.qid, q.text as query_text, r.docid, r.relevance_score from fx_qrels r join fx_queries q on q.qid = r.qid""",
    "fx_queries", "fx_qrels"))
def q_dev_judgements(spark, sf):
    q, r = ranking.common_qids(fx.queries(spark, sf), fx.qrels(spark, sf))
    return pairs.dev_judgements(q, r)


@register("common_qids", O.with_views(
    "select qid, text from fx_queries where qid in (select qid from fx_qrels)", "fx_queries", "fx_qrels"))
def q_common_qids(spark, sf):
    return ranking.common_qids(fx.queries(spark, sf), fx.qrels(spark, sf))[0]


@register("intersect_qids", O.with_views(
    "select qid from fx_queries intersect select qid from fx_qrels", "fx_queries", "fx_qrels"))
def q_intersect_qids(spark, sf):
    return ranking.intersect_qids(fx.queries(spark, sf), fx.qrels(spark, sf))


@register("judged_in_collection", O.with_views(
    "select qid, docid, relevance_score from fx_qrels where docid in (select id from cc)", *VIEWS3,
    extra=O.clean_collection_ctes()))
def q_judged_in_collection(spark, sf):
    return ranking.judged_in_collection(fx.qrels(spark, sf), _coll(spark, sf))


@register("filter_passages", O.with_views("select query_id, kind, docid from fp", *VIEWS3,
                                          extra=O.clean_collection_ctes() + TRI + FP))
def q_filter_passages(spark, sf):
    return pairs.filter_passages(_flat(spark, sf), _coll(spark, sf)).select("query_id", "kind", "docid")


_BP_COLS = "query_id, query, product_description, product_id, title, product_text, qid, docid, relevance_score"


@register("build_pairs", O.with_views(f"select {_BP_COLS} from bp", *VIEWS3, extra=O.clean_collection_ctes() + TRI + FP + BP))
def q_build_pairs(spark, sf):
    return pairs.build_pairs(_flat(spark, sf), _coll(spark, sf), fx.qrels(spark, sf)).select(*_BP_COLS.split(", "))


# ---- sources and sinks: write to the shared scratch folder, read back with the fixed rules ----

@register("src_collection", O.with_views(
    "select id, nullif(title, '') as title, nullif(description, '') as description from fx_collection", "fx_collection"))
def q_src_collection(spark, sf):
    path = scratch_path(spark, "collection-tsv")
    io.write_tsv(fx.collection(spark, sf), path, header=False)
    return io.read_collection(spark, path)


@register("src_tsv_header", O.with_views("select id, title, description, product_text from cc", "fx_collection",
                                         extra=O.clean_collection_ctes()))
def q_src_tsv_header(spark, sf):
    path = scratch_path(spark, "clean-tsv")
    io.write_tsv(_coll(spark, sf), path, header=True)
    schema = "id long, title string, description string, product_text string"
    return io.read_tsv(spark, path, spark.createDataFrame([], schema).schema, header=True)


@register("src_qrels", O.with_views("select qid, docid, relevance_score from fx_qrels", "fx_qrels"))
def q_src_qrels(spark, sf):
    path = scratch_path(spark, "qrels-tsv")
    r = fx.qrels(spark, sf).select("qid", F.lit("0").alias("iter"), "docid", "relevance_score")
    io.write_tsv(r, path, header=False)
    return io.read_qrels(spark, path)


@register("src_queries", O.with_views("select qid, text from fx_queries", "fx_queries"))
def q_src_queries(spark, sf):
    path = scratch_path(spark, "queries-tsv")
    io.write_tsv(fx.queries(spark, sf), path, header=False)
    return io.read_queries(spark, path)


@register("src_triples", O.with_views(
    "select query_id, kind, cast(row_number() over (partition by query_id, kind order by docid) - 1 as integer) as pos, docid from tri",
    *VIEWS3, extra=TRI))
def q_src_triples(spark, sf):
    path = scratch_path(spark, "triples-jsonl")
    io.write_triples(_flat(spark, sf).withColumn("pos", F.lit(0)), path)
    return io.read_triples(spark, path).select("query_id", "kind", "pos", "docid")


@register("sink_jsonl", O.with_views(
    "select query_id, kind, cast(row_number() over (partition by query_id, kind order by docid) - 1 as integer) as pos, docid from fp",
    *VIEWS3, extra=O.clean_collection_ctes() + TRI + FP))
def q_sink_jsonl(spark, sf):
    path = scratch_path(spark, "filtered-jsonl")
    f = pairs.filter_passages(_flat(spark, sf), _coll(spark, sf)).withColumn("pos", F.lit(0))
    io.write_triples(f, path)
    return io.read_triples(spark, path).select("query_id", "kind", "pos", "docid")


@register("sink_tsv", O.with_views(f"select {_BP_COLS} from bp", *VIEWS3, extra=O.clean_collection_ctes() + TRI + FP + BP))
def q_sink_tsv(spark, sf):
    path = scratch_path(spark, "pairs-tsv")
    bp = pairs.build_pairs(_flat(spark, sf), _coll(spark, sf), fx.qrels(spark, sf)).select(*_BP_COLS.split(", "))
    io.write_tsv(bp, path, header=True)
    return io.read_tsv(spark, path, bp.schema, header=True)
