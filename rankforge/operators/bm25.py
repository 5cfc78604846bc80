"""Okapi BM25 as Spark plans over an inverted index.

Index = three tables plus scalar statistics:

* ``postings(term, id, tf)``   -- ``explode(tokens)`` + ``groupBy(term, id).count()``; partial
  aggregation runs before the shuffle and the (term, id) key never skews;
* ``doc_stats(id, doc_len)``   -- narrow projection, no shuffle;
* ``term_stats(term, df, idf_raw, idf)`` -- ``groupBy(term)`` over postings (partial agg again);
* corpus scalars ``n``, ``avgdl``, ``mean_idf`` as lazy scalar subqueries (no cross join, no
  driver round trip).

``idf = ln((N - df + 0.5) / (df + 0.5))``; the mean over all terms (negatives included, before
the floor) times ``epsilon`` replaces every negative idf.

Scoring keeps the postings of the queries' terms, deals them by document to their lengths and joins
them there to the query terms, which are written first, so that a small table of them is broadcast. Judged-first
evaluation joins the judged (qid, docid) pairs by document too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOUN_DETACHMENT_RULES, token_rows, tokenize, tokenizer_udf
from ..session import materialize
from ..session import materialize as written
from .skew import heavy_terms, split_join

# Parameters of the untuned build and of the class defaults.
FIXED_PARAMS = {"k1": 1.2, "b": 0.9, "epsilon": 0.1}
DEFAULT_PARAMS = {"k1": 1.5, "b": 0.75, "epsilon": 0.25}
# Tuning grid; grid order = sorted key names (b, epsilon, k1), last key varies fastest.
PARAM_GRID = {"k1": [1.2, 1.5, 1.8], "b": [0.6, 0.75, 0.9], "epsilon": [0.1, 0.25, 0.5]}


def grid_rows(grid: dict | None = None) -> list[dict]:
    grid = grid or PARAM_GRID
    keys = sorted(grid)
    rows = [{}]
    for k in keys:
        rows = [dict(r, **{k: v}) for r in rows for v in grid[k]]
    for i, r in enumerate(rows):
        r["g"] = i
    return rows


@dataclass
class BM25Index:
    postings: DataFrame     # term, id, tf
    doc_stats: DataFrame    # id, doc_len
    term_stats: DataFrame   # term, df, idf_raw, idf
    n_docs: Column          # scalar
    avgdl: Column           # scalar
    mean_idf: Column        # scalar
    k1: float
    b: float
    epsilon: float
    lemmas: DataFrame | None = None  # term -> lemma, when built with lemmatize=True
    doc_ids: DataFrame | None = None  # every indexed document id (from the materialised pass)

    def corpus_stats(self) -> DataFrame:
        """One row: ``corpus_size, avgdl, k1, b, epsilon, mean_idf`` (all lazy scalars)."""
        return self.postings.agg(F.count("*").alias("_n")).select(
            self.n_docs.alias("corpus_size"), self.avgdl.alias("avgdl"), F.lit(self.k1).alias("k1"),
            F.lit(self.b).alias("b"), F.lit(self.epsilon).alias("epsilon"))


def tokenize_corpus(df: DataFrame, id_col: str = "id", text_col: str = "product_text",
                    stopwords: bool = True) -> DataFrame:
    """``(id, tokens)``; NULL text -> empty token list (still a document)."""
    return df.select(F.col(id_col).alias("id"), tokenize(F.col(text_col), stopwords).alias("tokens"))


def lemma_map(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term -> lemma with the noun detachment rules, a candidate accepted only when it is itself
    in ``vocabulary``; the shortest accepted form wins (ties: the word, then rule order).

    Both inputs are single-column ``term`` tables; the result is an equi join on the candidate,
    so neither side is broadcast unless AQE finds it small."""
    rules = F.array(*[F.struct(F.lit(i + 1).alias("r"), F.lit(suf).alias("suf"), F.lit(rep).alias("rep"))
                      for i, (suf, rep) in enumerate(NOUN_DETACHMENT_RULES)])
    t = terms.select("term").distinct()
    cands = t.select("term", F.inline(rules)).filter(
        F.col("term").endswith(F.col("suf")) & ~F.col("term").endswith(F.lit("ss"))
        & (F.length("term") > F.length("suf"))
    ).select("term", "r", F.concat(F.expr("substring(term, 1, length(term) - length(suf))"), F.col("rep")).alias("cand"))
    self_c = t.select("term", F.lit(0).alias("r"), F.col("term").alias("cand"))
    v = vocabulary.select(F.col("term").alias("cand")).distinct()
    hits = cands.unionByName(self_c).join(v, "cand", "left_semi")
    best = hits.groupBy("term").agg(
        F.min_by("cand", F.struct(F.length("cand"), F.col("r"))).alias("lemma"))
    return t.join(best, "term", "left").select("term", F.coalesce("lemma", "term").alias("lemma"))


def build_index(docs: DataFrame, k1: float = FIXED_PARAMS["k1"], b: float = FIXED_PARAMS["b"],
                epsilon: float = FIXED_PARAMS["epsilon"], lemmatize: bool = False, id_col: str = "id",
                text_col: str = "product_text", tokens_col: str | None = None,
                materialize: bool = True, tokenizer=None) -> BM25Index:
    """Index over a keyed text table (or a pre-tokenised ``tokens_col`` array).

    The corpus is tokenised exactly once: the postings exchange is the only consumer of the
    text, and document lengths, document frequencies and avgdl are all derived from it (AQE
    reuses that exchange across the main plan and the scalar subqueries). Documents with no
    token count in N and in avgdl but never match, so they need no doc_stats row."""
    # one sentinel row (term NULL) per document: the same pass also counts N, empty docs included
    if tokenizer is not None or tokens_col:
        # user callable text -> list[str], run batch-wise through Arrow (slow path by design)
        tokens = tokenizer_udf(tokenizer)(F.col(text_col)) if tokenizer is not None else F.col(tokens_col)
        own = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull())
        rows = docs.select(F.col(id_col).alias("id"), F.explode(F.array_append(own, F.lit(None).cast("string"))).alias("term"))
    else:
        rows = token_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")), "id", "_t", mark=True)
    counted = rows.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"))
    postings = counted.filter(F.col("term").isNotNull())
    if materialize:
        # written once to spark.checkpoint.dir: cuts the lineage (text scan, cleaning,
        # tokenising) so every index part reads the written postings; the corpus scalars
        # are then two small aggregates over it, passed on as literals
        counted = written(counted, "bm25-postings")
        postings = counted.filter(F.col("term").isNotNull())
        st = counted.agg(F.sum(F.when(F.col("term").isNull(), F.col("tf"))).alias("n"),
                         F.sum(F.when(F.col("term").isNotNull(), F.col("tf"))).alias("total")).first()
        n = int(st["n"] or 0)
        avgdl = F.lit(float(st["total"] or 0) / n) if n else F.lit(None).cast("double")
        idx = index_from_postings(postings, F.lit(n).cast("long"), k1, b, epsilon, lemmatize, avgdl=avgdl, eager=True)
    else:
        n_docs = counted.filter(F.col("term").isNull()).agg(F.sum("tf").cast("long")).scalar()
        idx = index_from_postings(postings, n_docs, k1, b, epsilon, lemmatize)
    idx.doc_ids = counted.filter(F.col("term").isNull()).select("id")
    return idx


def index_from_postings(postings: DataFrame, n_docs: Column, k1: float, b: float, epsilon: float,
                        lemmatize: bool = False, avgdl: Column | None = None, eager: bool = False) -> BM25Index:
    """Derived parts; scalars are lazy subqueries, or (``eager``) small aggregates run now."""
    lemmas = None
    if lemmatize:
        vocab = postings.select("term").distinct()
        lemmas = lemma_map(vocab, vocab)
        postings = postings.join(lemmas, "term").groupBy(F.col("lemma").alias("term"), "id") \
            .agg(F.sum("tf").cast("int").alias("tf"))
    doc_stats = postings.groupBy("id").agg(F.sum("tf").cast("int").alias("doc_len"))
    if avgdl is None:
        avgdl = postings.agg(F.sum("tf").cast("double")).scalar() / n_docs
    df_ = postings.groupBy("term").agg(F.count("*").alias("df"))
    if eager:
        df_ = written(df_, "bm25-df")
    with_raw = df_.withColumn(
        "idf_raw", F.log((n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))))
    if eager:
        m = with_raw.agg(F.avg("idf_raw")).first()[0]
        mean_idf = F.lit(m).cast("double")
    else:
        mean_idf = with_raw.agg(F.avg("idf_raw")).scalar()
    term_stats = with_raw.withColumn(
        "idf", F.when(F.col("idf_raw") < 0, F.lit(epsilon) * mean_idf).otherwise(F.col("idf_raw")))
    return BM25Index(postings, doc_stats, term_stats, n_docs, avgdl, mean_idf, k1, b, epsilon, lemmas)


def query_terms(index: BM25Index, queries: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """``(qid, term, qtf)``; repeated query terms keep their multiplicity; NULL texts skipped."""
    qt = queries.filter(F.col(text).isNotNull()).select(
        F.col(qid).alias("qid"), F.explode(tokenize(F.col(text))).alias("term"))
    if index.lemmas is not None:
        vocab = index.lemmas.select("term")
        lm = lemma_map(qt.select("term"), vocab)
        qt = qt.join(lm, "term").select("qid", F.col("lemma").alias("term"))
    qt = qt.groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    # written, so that plans know how small it is: a few queries are broadcast, and postings stay where they are
    return qt if qt.isStreaming else written(qt, "query-terms")


def _contribution(index: BM25Index, k1, b, idf: Column) -> Column:
    tf = F.col("tf").cast("double")
    norm = F.lit(k1) * (F.lit(1.0) - F.lit(b) + F.lit(b) * F.col("doc_len") / index.avgdl)
    return F.col("qtf") * idf * tf * (F.lit(k1) + F.lit(1.0)) / (tf + norm)


def _postings_of(index: BM25Index, terms: DataFrame) -> DataFrame:
    """``(id, term, tf, doc_len)`` of the postings of these terms, dealt by document: what is joined to a query's terms then needs no shuffle more."""
    return index.postings.join(terms.select("term"), "term", "left_semi").join(index.doc_stats, "id")


def _all_matches(index: BM25Index, terms: DataFrame) -> DataFrame:
    """``terms(qid, term, ..)`` with every posting of their term."""
    return split_join(_postings_of(index, terms), terms, heavy_terms(index.term_stats), ["id"])


def _pair_matches(index: BM25Index, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``terms(qid, term, ..)`` with the postings of their term in the documents that ``pairs(qid, id)`` names for the query. Pairs meet
    their document's postings by id; they are never multiplied with a query's terms."""
    return pairs.select("qid", "id").join(_postings_of(index, terms), "id").join(terms, ["qid", "term"])


def score_matches(index: BM25Index, qterms: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(qid, id, score)`` for every document sharing a term with its query (scores > 0 or the
    floor), optionally restricted to ``pairs(qid, id)``. Documents without a match are absent."""
    qt = written(qterms.join(index.term_stats.select("term", "idf"), "term"), "query-weights")
    return _weighted(index, _all_matches(index, qt) if pairs is None else _pair_matches(index, qt, pairs))


def bm25_scores(index: BM25Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores for the given ``pairs(qid, id)``; pairs without a shared term score exactly 0.0."""
    s = score_matches(index, query_terms(index, queries), pairs)
    return pairs.select("qid", "id").join(s, ["qid", "id"], "left") \
        .select("qid", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def grid_scores(index: BM25Index, queries: DataFrame, pairs: DataFrame, grid: dict | None = None) -> DataFrame:
    """Scores of ``pairs`` under every grid point in one pass: postings and df are computed once,
    the (small, fixed) parameter grid is exploded onto matched rows only.
    Returns ``(g, b, epsilon, k1, qid, id, score)`` including zero-score pairs."""
    rows = grid_rows(grid)
    arr = F.array(*[F.struct(F.lit(r["g"]).alias("g"), F.lit(float(r["b"])).alias("b"),
                             F.lit(float(r["epsilon"])).alias("epsilon"), F.lit(float(r["k1"])).alias("k1"))
                    for r in rows])
    qt = written(query_terms(index, queries).join(index.term_stats.select("term", "idf_raw"), "term"), "query-weights")
    m = _pair_matches(index, qt, pairs)
    m = m.select("*", F.inline(arr))
    idf = F.when(F.col("idf_raw") < 0, F.col("epsilon") * index.mean_idf).otherwise(F.col("idf_raw"))
    tf = F.col("tf").cast("double")
    contrib = F.col("qtf") * idf * tf * (F.col("k1") + 1.0) / (
        tf + F.col("k1") * (F.lit(1.0) - F.col("b") + F.col("b") * F.col("doc_len") / index.avgdl))
    s = m.groupBy("g", "qid", "id").agg(F.sum(contrib).alias("score"))
    # every judged pair under every grid point (zero when nothing matched): explode the fixed grid
    full = pairs.select("qid", "id", F.inline(arr))
    return full.join(s, ["g", "qid", "id"], "left") \
        .select("g", "b", "epsilon", "k1", "qid", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_n(scores: DataFrame, n: int, part: str = "qid", score: str = "score", key: str = "id") -> DataFrame:
    """Top-n per query by score descending, ties by key ascending; adds ``rank``.
    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(key).asc())
    r = scores.withColumn("rank", F.row_number().over(w))
    return r.filter(F.col("rank") <= n) if n > 0 else r


#: Share of a query's posting rows that are read to find its threshold.
LEAD_SHARE = 0.1
#: Posting rows of all query terms from which a search prunes unless told otherwise.
PRUNE_ROWS = 20_000_000
#: Scores closer than this to the threshold are kept; above any rounding of sums.
MARGIN = 1e-6


def term_bounds(index: BM25Index, qterms: DataFrame) -> DataFrame:
    """``(qid, term, qtf, idf, df, bound)``: no posting of the term adds more to the query's score than ``bound`` (or, if the
    idf is negative, less). A document is at least as long as the term is often in it, so the largest tf bounds all postings."""
    most = index.postings.join(qterms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.max("tf").cast("double").alias("_tf"))
    tf = F.col("_tf")
    norm = F.lit(index.k1) * (F.lit(1.0) - F.lit(index.b) + F.lit(index.b) * tf / index.avgdl)
    return qterms.join(index.term_stats.select("term", "idf", "df"), "term").join(most, "term").select(
        "qid", "term", "qtf", "idf", "df", (F.col("qtf") * F.col("idf") * tf * F.lit(index.k1 + 1.0) / (tf + norm)).alias("bound"))


def _weighted(index: BM25Index, m: DataFrame) -> DataFrame:
    return m.groupBy("qid", "id").agg(F.sum(_contribution(index, index.k1, index.b, F.col("idf"))).alias("score"))


def essential_terms(index: BM25Index, bounds: DataFrame, n: int) -> DataFrame:
    """The rows of ``bounds`` with ``theta`` and ``essential``. The rarest terms of a query, with some ``LEAD_SHARE`` of its posting rows, give
    its n best partial scores; the n-th is a threshold that the n-th whole score reaches. Terms of the smallest bounds whose sum stays below
    it are not essential: a document with none but these cannot be among the n. Queries without n matches there keep all terms."""
    from pyspark.sql import Window

    rare = Window.partitionBy("qid").orderBy("df", "term")
    total = F.sum("df").over(Window.partitionBy("qid"))
    lead = bounds.withColumn("_at", F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, Window.currentRow))) \
        .withColumn("_no", F.row_number().over(rare)).withColumn("_total", total) \
        .filter((F.col("_no") == 1) | (F.col("_at") <= LEAD_SHARE * F.col("_total"))).select("qid", "term", "qtf", "idf")
    partial = top_n(_weighted(index, _all_matches(index, written(lead, "bm25-lead"))), n)
    theta = partial.groupBy("qid").agg(F.count("*").alias("_n"), F.min("score").alias("_low")).filter(F.col("_n") >= n)
    below = bounds.groupBy("qid").agg(F.sum(F.least("bound", F.lit(0.0))).alias("_neg"))  # what terms of negative idf may take away
    theta = theta.join(below, "qid").select("qid", (F.col("_low") + F.col("_neg") - MARGIN).alias("theta"))
    least = Window.partitionBy("qid").orderBy(F.greatest("bound", F.lit(0.0)), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bounds.join(theta, "qid", "left").withColumn("_sum", F.sum(F.greatest("bound", F.lit(0.0))).over(least)) \
        .withColumn("essential", F.coalesce(F.col("_sum") >= F.col("theta"), F.lit(True))).drop("_sum")


def best_matches(index: BM25Index, queries: DataFrame, n: int) -> DataFrame:
    """``(qid, id, score)`` of every document that can be among the n best of its query (all matches of a query that has fewer): postings of essential
    terms are read whole, those of the others only for documents that can still reach the threshold."""
    terms = materialize(essential_terms(index, materialize(term_bounds(index, query_terms(index, queries)), "bm25-bounds"), n), "bm25-terms")
    first = _all_matches(index, terms.filter("essential").select("qid", "term", "qtf", "idf"))
    rest = terms.groupBy("qid").agg(F.max("theta").alias("theta"), F.sum(F.when(~F.col("essential"), F.greatest("bound", F.lit(0.0))).otherwise(0.0)).alias("_more"))
    open_ = _weighted(index, first).join(rest, "qid").filter(F.col("theta").isNull() | (F.col("score") + F.col("_more") >= F.col("theta")))
    open_ = materialize(open_.select("qid", "id", "score"), "bm25-open")
    more = _pair_matches(index, terms.filter("not essential").select("qid", "term", "qtf", "idf"), open_)
    return open_.unionByName(_weighted(index, more)).groupBy("qid", "id").agg(F.sum("score").alias("score"))


def search(index: BM25Index, queries: DataFrame, n: int = 5, prune: bool | None = None) -> DataFrame:
    """``get_top_n`` for many queries in one plan: n rows per query if the collection has n documents.

    Queries with fewer than n matches are filled up, score 0, with the smallest ids that do not match. Among the n
    smallest ids of the collection there are always enough of them, so only |queries| x n rows are made.
    With ``prune`` documents that cannot be among the n best are left out by score bounds (``best_matches``): the same rows
    from fewer postings, but more stages. By default that is done if the queries' terms have over ``PRUNE_ROWS`` posting rows.
    With ``n <= 0`` all matches are returned."""
    q = query_terms(index, queries)
    if prune is None and n > 0:
        prune = (q.join(index.term_stats.select("term", "df"), "term").agg(F.sum("df")).first()[0] or 0) > PRUNE_ROWS
    s = best_matches(index, queries, n) if prune and n > 0 else score_matches(index, q)
    s = s.withColumn("score", F.round("score", 9))
    if n <= 0 or index.doc_ids is None:
        return top_n(s, n)
    top = written(top_n(s, n).drop("rank"), "top-matches")
    ids = [r["id"] for r in index.doc_ids.select("id").distinct().orderBy("id").limit(n).collect()]
    asked = queries.filter(F.col("text").isNotNull()).select("qid").distinct()
    few = asked.join(top.groupBy("qid").agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select("qid"), "qid", "left_anti")
    # which of these few ids match is read from their own postings, not from all scores anew
    match = q.select("qid", "term").join(index.postings.filter(F.col("id").isin(ids)), "term").select("qid", "id")
    zero = few.select("qid", F.explode(F.array(*map(F.lit, ids))).alias("id")).join(match, ["qid", "id"], "left_anti") \
        .select("qid", "id", F.lit(0.0).alias("score"))
    return top_n(top.select("qid", "id", "score").unionByName(zero), n)


def save_index(index: BM25Index, path: str) -> None:
    """Write postings once, then derive and write the other parts from the written postings
    (the corpus is not tokenised again, and the written table cuts the lineage)."""
    spark = index.postings.sparkSession
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    saved = index_from_postings(spark.read.parquet(f"{path}/postings"), index.n_docs, index.k1, index.b, index.epsilon)
    saved.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    saved.term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
    saved.corpus_stats().withColumn("mean_idf", saved.mean_idf) \
        .write.mode("overwrite").parquet(f"{path}/corpus_stats")


def load_index(spark, path: str) -> BM25Index:
    postings = spark.read.parquet(f"{path}/postings")
    doc_stats = spark.read.parquet(f"{path}/doc_stats")
    term_stats = spark.read.parquet(f"{path}/term_stats")
    cs = spark.read.parquet(f"{path}/corpus_stats")
    p = cs.select("k1", "b", "epsilon").first()  # one row of parameters
    return BM25Index(postings, doc_stats, term_stats, cs.select("corpus_size").scalar(),
                     cs.select("avgdl").scalar(), cs.select("mean_idf").scalar(),
                     float(p["k1"]), float(p["b"]), float(p["epsilon"]))
