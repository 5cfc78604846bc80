"""Registered queries: cleaning (B2-B7, E1, M5), profiling (D1-D11), head rows (E6), H4/H5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_count, whitespace_tokens
from ..operators import clean, profile
from ..sources import fixtures as fx
from . import oracle as O
from .registry import register, rounded

BP = O.in_list(clean.BOILERPLATE)


def _strip(x):
    for p in clean.STRIP_PHRASES:
        x = f"replace({x}, {O.lit(p)}, '')"
    return x


@register("null_boilerplate", O.with_views(
    f"""select id, case when title in {BP} then null else title end as title,
 case when description in {BP} then null else description end as description from fx_collection""", "fx_collection"))
def q_null_boilerplate(spark, sf):
    return clean.null_boilerplate(fx.collection(spark, sf))


@register("drop_any_null", O.with_views("select * from fx_collection where id is not null and title is not null and description is not null",
                                        "fx_collection"))
def q_drop_any_null(spark, sf):
    return clean.drop_any_null(fx.collection(spark, sf))


@register("drop_all_null", O.with_views(
    f"""select * from (select id, case when title in {BP} then null else title end as title,
 case when description in {BP} then null else description end as description from fx_collection)
 where title is not null or description is not null""", "fx_collection"))
def q_drop_all_null(spark, sf):
    return clean.drop_all_null(clean.null_boilerplate(fx.collection(spark, sf)))


@register("strip_phrases", O.with_views(f"select id, title, {_strip('description')} as description from fx_collection",
                                        "fx_collection"))
def q_strip_phrases(spark, sf):
    return clean.strip_phrases(fx.collection(spark, sf))


@register("product_text", O.with_views(
    "select id, concat(coalesce(title, ''), ' ', coalesce(description, '')) as product_text from fx_collection", "fx_collection"))
def q_product_text(spark, sf):
    return clean.product_text(fx.collection(spark, sf)).select("id", "product_text")


@register("dedupe_text", O.with_views(
    """select id, title, description from (select *, row_number() over (partition by description, title order by id) as rn
 from fx_collection) where rn = 1""", "fx_collection"))
def q_dedupe_text(spark, sf):
    return clean.dedupe_text(fx.collection(spark, sf))


@register("clean_collection", O.with_views("select id, title, description, product_text from cc", "fx_collection",
                                           extra=O.clean_collection_ctes()))
def q_clean_collection(spark, sf):
    return clean.clean_collection(fx.collection(spark, sf))


@register("null_counts", O.with_views(
    """select 'raw' as stage, count(*) as n_rows, cast(count_if(id is null) as bigint) as id_nulls, cast(count_if(title is null) as bigint) as title_nulls,
 cast(count_if(description is null) as bigint) as description_nulls from fx_collection
 union all
 select 'clean', count(*), cast(count_if(id is null) as bigint), cast(count_if(title is null) as bigint), cast(count_if(description is null) as bigint) from cc""",
    "fx_collection", extra=O.clean_collection_ctes()))
def q_null_counts(spark, sf):
    raw = fx.collection(spark, sf)
    c = clean.clean_collection(raw).select("id", "title", "description")
    return profile.null_counts(raw, "raw").unionByName(profile.null_counts(c, "clean"))


_PAIR_LEN = O.with_views(
    "", "fx_text_pairs",
    extra=[("pl", "select pair_id, len(list_filter(regexp_split_to_array(trim(query), '\\s+'), lambda w: w <> '')) as query_tokens, "
                  "length(query) as query_chars, length(product_text) as text_chars from fx_text_pairs")])


def _pair_len(spark, sf):
    p = fx.text_pairs(spark, sf)
    return p.select("pair_id", token_count("query").alias("query_tokens"),
                    F.char_length("query").alias("query_chars"), F.char_length("product_text").alias("text_chars"))


@register("describe_numeric", _PAIR_LEN + " " + " union all ".join(
    f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
 cast(min({c}) as double) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
 round(quantile_cont({c}, 0.75), 6) as p75, cast(max({c}) as double) as max from pl"""
    for c in ("query_tokens", "query_chars", "text_chars")))
def q_describe_numeric(spark, sf):
    return rounded(profile.describe_numeric(_pair_len(spark, sf), ["query_tokens", "query_chars", "text_chars"]))


@register("describe_all", O.with_views(" union all ".join(
    f"""select '{c}' as "column", cast(sum(n) as bigint) as count, count(*) as unique, arg_min(v, (-n, v)) as top, max(n) as freq
 from (select {c} as v, count(*) as n from cc where {c} is not null group by {c})""" for c in ("title", "description", "product_text")),
    "fx_collection", extra=O.clean_collection_ctes()))
def q_describe_all(spark, sf):
    c = clean.clean_collection(fx.collection(spark, sf))
    return profile.describe_text(c, ["title", "description", "product_text"])


@register("value_counts_topk", O.with_views(
    """select * from (select 'title_length' as what, cast(length(title) as varchar) as value, count(*) as count from fx_collection
  group by 2 order by count desc, value asc nulls first limit 10)
 union all select * from (select 'title', title, count(*) as count from fx_collection group by 2 order by count desc, 2 asc nulls first limit 10)""",
    "fx_collection"))
def q_value_counts_topk(spark, sf):
    c = fx.collection(spark, sf)
    a = profile.value_counts_topk(c, F.char_length("title").cast("string")).select(F.lit("title_length").alias("what"), "value", "count")
    b = profile.value_counts_topk(c, "title").select(F.lit("title").alias("what"), "value", "count")
    return a.unionByName(b)


@register("quantiles", O.with_views(
    "select " + ", ".join(f"round(quantile_cont(n, {p}), 6) as q{int(p * 100):02d}" for p in (0.25, 0.5, 0.75, 0.95, 0.99))
    + " from (select len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) as n from fx_queries where text is not null)",
    "fx_queries"))
def q_quantiles(spark, sf):
    q = fx.queries(spark, sf).filter(F.col("text").isNotNull()).select(token_count("text").alias("n"))
    return rounded(profile.quantiles(q, "n"))


@register("length_stats", O.with_views(
    "select round(avg(length(query)), 6) as mean_query_chars, round(avg(length(product_text)), 6) as mean_text_chars, "
    "round(stddev_samp(length(query)), 6) as std_query_chars from fx_text_pairs", "fx_text_pairs"))
def q_length_stats(spark, sf):
    p = fx.text_pairs(spark, sf)
    return rounded(p.agg(F.avg(F.char_length("query")).alias("mean_query_chars"),
                         F.avg(F.char_length("product_text")).alias("mean_text_chars"),
                         F.stddev_samp(F.char_length("query")).alias("std_query_chars")))


@register("char_length", O.with_views(
    "select id, cast(length(title) as integer) as title_chars, cast(length(description) as integer) as description_chars, cast(length(product_text) as integer) as text_chars from cc",
    "fx_collection", extra=O.clean_collection_ctes()))
def q_char_length(spark, sf):
    c = clean.clean_collection(fx.collection(spark, sf))
    return c.select("id", F.char_length("title").alias("title_chars"), F.char_length("description").alias("description_chars"),
                    F.char_length("product_text").alias("text_chars"))


@register("token_count", O.with_views(
    "select qid, cast(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) as integer) as n_tokens from fx_queries",
    "fx_queries"))
def q_token_count(spark, sf):
    return fx.queries(spark, sf).select("qid", token_count("text").alias("n_tokens"))


@register("distinct_ids", O.with_views("select distinct docid from fx_qrels", "fx_qrels"))
def q_distinct_ids(spark, sf):
    return fx.qrels(spark, sf).select("docid").distinct()


_HIST_SQL = O.with_views(
    """select b.bin, round(s.mn + (s.mx - s.mn) * b.bin / 50.0, 6) as lower, round(s.mn + (s.mx - s.mn) * (b.bin + 1) / 50.0, 6) as upper,
 coalesce(c.count, 0) as count
 from (select cast(range as integer) as bin from range(50)) b cross join s
 left join (select cast(least(floor((x - s.mn) * 50.0 / (s.mx - s.mn)), 49) as integer) as bin, count(*) as count
            from (select cast(length(description) as double) as x from fx_collection where description is not null) t, s group by 1) c on c.bin = b.bin""",
    "fx_collection", extra=[("s", "select min(cast(length(description) as double)) as mn, max(cast(length(description) as double)) as mx from fx_collection")])


@register("histogram", _HIST_SQL)
def q_histogram(spark, sf):
    c = fx.collection(spark, sf).select(F.char_length("description").alias("len"))
    return rounded(profile.histogram(c, "len", 50))


@register("vocab_diversity", O.with_views(
    """select q.v as query_vocab, t.v as text_vocab, round(q.v / t.v, 6) as ratio from
 (select count(distinct w) as v from (select unnest(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) as w from fx_text_pairs)) q,
 (select count(distinct w) as v from (select unnest(list_filter(regexp_split_to_array(product_text, '\\s+'), lambda w: w <> '')) as w from fx_text_pairs)) t""",
    "fx_text_pairs"))
def q_vocab_diversity(spark, sf):
    p = fx.text_pairs(spark, sf)
    tv = profile.vocab_size(p, whitespace_tokens("product_text")).scalar()
    q = profile.vocab_size(p, whitespace_tokens("query")).withColumnRenamed("vocab", "query_vocab")
    return rounded(q.select("query_vocab", tv.alias("text_vocab"), (F.col("query_vocab") / tv).alias("ratio")))


@register("missing_matrix", O.with_views(
    "select title is null as title_null, description is null as description_null, count(*) as n_rows from fx_collection group by 1, 2",
    "fx_collection"))
def q_missing_matrix(spark, sf):
    return profile.missing_matrix(fx.collection(spark, sf), ["title", "description"])


@register("head_rows", O.with_views("select id, title from cc order by id limit 10", "fx_collection", extra=O.clean_collection_ctes()))
def q_head_rows(spark, sf):
    return clean.clean_collection(fx.collection(spark, sf)).select("id", "title").orderBy("id").limit(10)
