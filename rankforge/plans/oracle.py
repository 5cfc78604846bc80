"""Independent SQL renderings (DuckDB dialect) used as the correctness oracle.

Only the driver tables are registered in the oracle engine, so the fixture views are inlined
as CTEs. Text rules (tokeniser, boilerplate, stop words) are rendered from the same fixed
values as the Spark expressions, but the plans are written independently in plain SQL.
"""

from __future__ import annotations

from ..functions import text as T
from ..operators.clean import BOILERPLATE, STRIP_PHRASES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lit_list(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def in_list(xs) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def java_to_re2_repl(rep: str) -> str:
    """``$1`` -> ``\\1`` for replacement strings."""
    out = rep
    for i in range(9, 0, -1):
        out = out.replace(f"${i}", f"\\{i}")
    return out


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_collection": ((), """select doc_id as id,
 case when doc_id % 40 = 9 then null else split_part(text, chr(10), 1) end as title,
 case when doc_id % 25 = 7 then 'Product Description Read more '
      when doc_id % 10 = 3 then concat('Product Description ', substr(text, length(split_part(text, chr(10), 1)) + 2), ' Read more')
      else substr(text, length(split_part(text, chr(10), 1)) + 2) end as description
from documents"""),
    "fx_queries": ((), """select item_id as qid, case when item_id % 20 = 19 then null else text end as text from benchmark"""),
    "fx_qrels": ((), """select b.item_id + case when b.item_id % 10 = 8 then 1000 else 0 end as qid, d.doc_id as docid,
 cast(case when contains(d.text, b.text) then 2 + coalesce(l.quality, 0) when l.quality = 1 then 1 else 0 end as integer) as relevance_score
from benchmark b join documents d on contains(d.text, b.text) or d.doc_id % 50 = b.item_id % 50
left join labels l on l.doc_id = d.doc_id"""),
    "fx_text_pairs": ((), """select pair_id, query, product_text from (select concat(conv_id, ':', turn) as pair_id, role, text as query,
 lead(text) over (partition by conv_id order by turn) as product_text, lead(role) over (partition by conv_id order by turn) as next_role
from conversations) t where role = 'user' and next_role = 'assistant'"""),
    "fx_vec_queries": ((), """select vec_id as qid, embedding::double[] as query_embedding, label from embeddings where vec_id % 10 = 0"""),
    "fx_vec_products": ((), """select vec_id as id, embedding::double[] as product_embedding, label from embeddings where vec_id % 10 <> 0"""),
    "fx_vectors": ((), """select vec_id as id, embedding::double[] as product_embedding, label from embeddings"""),
    "fx_turns": ((), """select concat(conv_id, ':', turn) as turn_id, text from conversations"""),
    "fx_vec_qrels": (("fx_vec_queries", "fx_vec_products"), """select q.qid, p.id as docid,
 cast(case when q.label = p.label then 1 + p.id % 3 else 0 end as integer) as relevance_score
from fx_vec_queries q join fx_vec_products p on q.label = p.label or p.id % 20 = q.qid % 7"""),
    "fx_generated": ((), """select doc_id as id, text as product_text, string_split(text, chr(10)) as queries from documents"""),
    "fx_runs": ((), """select event_type as run, 1 + cast(floor(cast(json_extract_string(props, '$.k') as int) / 10) as int) as epoch,
 round(avg(value), 6) as value from events group by 1, 2"""),
    "fx_history": ((), """select run, metric, epoch, value from (select event_type as run,
 1 + cast(floor(cast(json_extract_string(props, '$.k') as int) / 10) as int) as epoch,
 round(avg(value), 6) as mean, round(min(value), 6) as min, round(max(value), 6) as max from events group by 1, 2)
 unpivot (value for metric in (mean, min, max))"""),
    "fx_entries": ((), """select event_id as step, cast(floor(cast(json_extract_string(props, '$.k') as int) / 10) as double) as epoch,
 case when event_type in ('click', 'view') then value end as loss, case when event_type in ('click', 'view') then value / 2 end as grad_norm,
 case when event_type = 'click' then value / 1000 end as learning_rate, case when event_type = 'purchase' then value end as eval_loss,
 case when event_type = 'purchase' then value + 1 end as eval_runtime, case when event_type = 'purchase' then value * 2 end as eval_samples_per_second,
 case when event_type = 'purchase' and value > 10 then value * 3 end as eval_steps_per_second,
 case when event_type not in ('click', 'view', 'purchase') then cast(json_extract_string(props, '$.k') as int) + event_id / 1000 end as elapsed_time,
 case when event_type not in ('click', 'view', 'purchase') then value + 100 end as memory_usage_mb,
 case when event_type = 'error' then value / 10 end as cpu_usage_percent from events"""),
    "fx_log": ((), """select event_id as step, cast(json_extract_string(props, '$.k') as int) as epoch,
 case when event_type in ('click','view') then value end as loss,
 case when event_type = 'purchase' then value end as eval_loss from events"""),
}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named fixture views (and their dependencies), then ``extra`` CTEs, then body."""
    order: list[str] = []

    def add(n):
        for d in VIEWS[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def tokenize(x: str, stopwords: bool = True) -> str:
    t = f"lower(coalesce({x}, ''))"
    t = f"regexp_replace({t}, {lit(T.TOKEN_PUNCT)}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(T.TOKEN_COLON_COMMA)}, ' \\1', 'g')"
    t = f"regexp_replace({t}, {lit(T.TOKEN_CLITIC)}, ' \\2', 'g')"
    t = f"regexp_replace({t}, {lit(T.TOKEN_FINAL_PERIOD)}, ' \\1', 'g')"
    keep = "regexp_full_match(w, '[\\p{L}\\p{N}]+')"
    if stopwords:
        keep += f" and not list_contains({lit_list(T.STOPWORDS_EN)}, w)"
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: {keep})"


def rouge_tokens(x: str) -> str:
    t = f"trim(regexp_replace(lower(coalesce({x}, '')), {lit(T.ROUGE_NON_ALNUM)}, ' ', 'g'))"
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def bleu_tokens(x: str) -> str:
    t = f"coalesce({x}, '')"
    for pat, rep in T.BLEU_13A_STEPS:
        t = f"regexp_replace({t}, {lit(pat)}, {lit(java_to_re2_repl(rep))}, 'g')"
    return f"list_filter(regexp_split_to_array(trim({t}), '\\s+'), lambda w: w <> '')"


def tfidf_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(T.TFIDF_TOKEN)})"


def clean_collection_ctes(src: str = "fx_collection", d: str = "description", t: str = "title",
                          order: str = "id", prefix: str = "cc") -> list[tuple[str, str]]:
    bp = in_list(BOILERPLATE)
    strip = d
    for p in STRIP_PHRASES:
        strip = f"replace({strip}, {lit(p)}, '')"
    return [
        (f"{prefix}_dd", f"select * exclude (_rn) from (select *, row_number() over (partition by {d}, {t} order by {order}) as _rn from {src}) where _rn = 1"),
        (f"{prefix}_nb", f"select * replace (case when {t} in {bp} then null else {t} end as {t}, case when {d} in {bp} then null else {d} end as {d}) from {prefix}_dd"),
        (f"{prefix}_dn", f"select * replace ({strip} as {d}) from {prefix}_nb where not ({t} is null and {d} is null)"),
        (prefix, f"select *, concat(coalesce({t}, ''), ' ', coalesce({d}, '')) as product_text from {prefix}_dn"),
    ]


def lemma_ctes(terms: str, vocab: str, out: str) -> list[tuple[str, str]]:
    """``out(term, lemma)`` for the distinct terms of ``terms(term)`` against ``vocab(term)``."""
    rules = ", ".join(f"({i + 1}, {lit(s)}, {lit(r)})" for i, (s, r) in enumerate(T.NOUN_DETACHMENT_RULES))
    return [
        (f"{out}_t", f"select distinct term from {terms}"),
        (f"{out}_c", f"""select t.term, r.r, left(t.term, length(t.term) - length(r.suf)) || r.rep as cand
 from {out}_t t join (select * from (values {rules}) x(r, suf, rep)) r
 on suffix(t.term, r.suf) and not suffix(t.term, 'ss') and length(t.term) > length(r.suf)
 union all select term, 0, term from {out}_t"""),
        (f"{out}_h", f"select term, arg_min(cand, (length(cand), r)) as lemma from {out}_c where cand in (select term from {vocab}) group by term"),
        (out, f"select t.term, coalesce(h.lemma, t.term) as lemma from {out}_t t left join {out}_h h using (term)"),
    ]


def bm25_index_ctes(coll: str = "cc", k1: float = 1.2, b: float = 0.9, eps: float = 0.1,
                    lemmatize: bool = False) -> list[tuple[str, str]]:
    post = "select term, id, cast(count(*) as integer) as tf from (select id, unnest(tokens) as term from bm_tok) group by term, id"
    if lemmatize:
        posts = [("bm_post0", post), ("bm_vocab", "select distinct term from bm_post0")] + lemma_ctes("bm_vocab", "bm_vocab", "bm_lm") + [
            ("bm_post", "select l.lemma as term, p.id, cast(sum(p.tf) as integer) as tf from bm_post0 p join bm_lm l using (term) group by l.lemma, p.id")]
    else:
        posts = [("bm_post", post)]
    return [
        ("bm_tok", f"select id, {tokenize('product_text')} as tokens from {coll}"),
        *posts,
        ("bm_dstat", "select id, len(tokens) as doc_len from bm_tok"),
        ("bm_cstat", "select count(*) as n, avg(doc_len) as avgdl from bm_dstat"),
        ("bm_traw", "select term, df, ln(((select n from bm_cstat) - df + 0.5) / (df + 0.5)) as idf_raw from (select term, count(*) as df from bm_post group by term) x"),
        ("bm_mi", "select avg(idf_raw) as mean_idf from bm_traw"),
        # the mean by a window: joined to its own source, it hangs under a LIMIT
        ("bm_tstat", f"select term, df, idf_raw, case when idf_raw < 0 then {eps} * avg(idf_raw) over () else idf_raw end as idf from bm_traw"),
    ]


def eval_input_ctes(queries: str = "fx_queries", qrels: str = "fx_qrels", coll: str = "cc") -> list[tuple[str, str]]:
    return [
        ("ev_q", f"select * from {queries} where qid in (select qid from {qrels})"),
        ("ev_r", f"select qid, docid, max(relevance_score) as relevance_score from {qrels} where qid in (select qid from {queries}) group by qid, docid"),
        ("ev_judged", f"select * from ev_r where docid in (select id from {coll})"),
        ("ev_evalq", "select qid, text from ev_q where text is not null"),
        ("ev_j", "select * from ev_judged where qid in (select qid from ev_evalq)"),
    ]


def metric_ctes(scored: str, p: int, k: int, group: str = "", asc: bool = False, evaluated: str | None = None,
                prefix: str = "mt") -> list[tuple[str, str]]:
    g = f"{group}, " if group else ""
    o = "asc" if asc else "desc"
    ctes = [
        (f"{prefix}_rk", f"select *, row_number() over (partition by {g}qid order by score {o}, docid) as rnk, "
                         f"row_number() over (partition by {g}qid order by relevance_score desc, docid) as irnk from {scored}"),
        (f"{prefix}_per", f"select {g}qid, round(sum(case when rnk <= {p} then relevance_score / log2(rnk + 1) else 0 end) / "
                          f"nullif(sum(case when irnk <= {p} then relevance_score / log2(irnk + 1) else 0 end), 0), 5) as ndcg, "
                          f"count_if(rnk <= {k} and relevance_score > 0) / {float(k)} as precision, "
                          f"coalesce(count_if(rnk <= {k} and relevance_score > 0) / nullif(count_if(relevance_score > 0), 0), 0.0) as recall "
                          f"from {prefix}_rk group by {g}qid"),
    ]
    if evaluated:
        ctes.append((f"{prefix}_pq", f"select e.{g}qid, m.ndcg, coalesce(m.precision, 0.0) as precision, coalesce(m.recall, 0.0) as recall "
                                     f"from {evaluated} e left join {prefix}_per m using ({g}qid)"))
    return ctes


def bm25_query_term_ctes(src: str = "ev_evalq", lemmatize: bool = False) -> list[tuple[str, str]]:
    raw = f"select qid, unnest({tokenize('text')}) as term from {src} where text is not null"
    if not lemmatize:
        return [("ev_qt", f"select qid, term, count(*) as qtf from ({raw}) group by qid, term")]
    return [("ev_qt0", raw)] + lemma_ctes("ev_qt0", "bm_vocab", "ev_lm") + [
        ("ev_qt", "select q.qid, l.lemma as term, count(*) as qtf from ev_qt0 q join ev_lm l using (term) group by q.qid, l.lemma")]


def bm25_judged_scored_ctes(k1: float = 1.2, b: float = 0.9, lemmatize: bool = False) -> list[tuple[str, str]]:
    return bm25_query_term_ctes("ev_evalq", lemmatize) + [
        ("ev_m", f"""select j.qid, j.docid, sum(qt.qtf * t.idf * p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b} + {b} * d.doc_len / c.avgdl))) as score
 from ev_j j join ev_qt qt on j.qid = qt.qid join bm_tstat t on t.term = qt.term
 join bm_post p on p.term = qt.term and p.id = j.docid join bm_dstat d on d.id = j.docid cross join bm_cstat c group by j.qid, j.docid"""),
        ("ev_scored", "select j.qid, j.docid, j.relevance_score, round(coalesce(m.score, 0.0), 9) as score from ev_j j left join ev_m m using (qid, docid)"),
    ]
