"""Fixture views: the driver tables presented in the shapes the retrieval operators expect.

Each builder is lazy and reads whole driver tables. Deviations from a naive SQL rendering are
made for scale only and return the same rows:

* qrels use a window index for containment plus an equi join instead of a nested-loop join
  with ``contains(..) OR ..``;
* text pairs join each turn to turn + 1 of the same conversation (turns are consecutive) instead
  of a ``lead`` window, so one huge conversation cannot pin a whole window to one task;
* vector judgements are two disjoint equi joins instead of an ``OR`` theta join.

Queries are the **whole** benchmark passages (not prefixes), and generated queries come from
every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.textmatch import contains_matches
from .tables import table

# Fixed values of the fixture definitions.
COLLECTION_NULL_TITLE = (40, 9)          # doc_id % 40 = 9 -> title NULL
COLLECTION_BOILERPLATE = (25, 7)         # doc_id % 25 = 7 -> description is pure boilerplate
COLLECTION_WRAPPED = (10, 3)             # doc_id % 10 = 3 -> description wrapped in phrases
QUERY_NULL_TEXT = (20, 19)               # item_id % 20 = 19 -> query text NULL
QREL_SHIFTED = (10, 8, 1000)             # item_id % 10 = 8 -> qid shifted by 1000 (no query)
QREL_POOL_MOD = 50                       # pool: doc_id % 50 = item_id % 50
VEC_QUERY_MOD = 10                       # vec_id % 10 = 0 -> query vector, else product
VEC_POOL = (20, 7)                       # pool: id % 20 = qid % 7
SALTS = 32                               # replication of the query side (ids and labels) in low-cardinality joins


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 raw collection ``(id, title, description)``: first line = title, rest = description."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    rest = F.substring(F.col("text"), F.length(first) + 2, 2147483647)
    did = F.col("doc_id")
    return d.select(
        did.alias("id"),
        F.when(did % COLLECTION_NULL_TITLE[0] == COLLECTION_NULL_TITLE[1], F.lit(None).cast("string"))
        .otherwise(first).alias("title"),
        F.when(did % COLLECTION_BOILERPLATE[0] == COLLECTION_BOILERPLATE[1], F.lit("Product Description Read more "))
        .when(did % COLLECTION_WRAPPED[0] == COLLECTION_WRAPPED[1],
              F.concat(F.lit("Product Description "), rest, F.lit(" Read more")))
        .otherwise(rest).alias("description"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 queries ``(qid, text)``: whole benchmark passages, a few planted NULL texts."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("qid"),
        F.when(F.col("item_id") % QUERY_NULL_TEXT[0] == QUERY_NULL_TEXT[1], F.lit(None).cast("string"))
        .otherwise(F.col("text")).alias("text"),
    )


_PERSISTED: dict = {}


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 judgements ``(qid, docid, relevance_score)``.

    Documents containing the passage get 2 + quality, pool members (doc_id % 50 = item_id % 50)
    get 1 if quality = 1 else 0. Judgements are an input table (a file in the reference); the
    derivation reads all documents, so it is persisted once per session and source
    and shared by every plan that reads it (blocks lost with an executor are recomputed)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    df = _PERSISTED.get(key)
    if df is None:
        df = _qrels(spark, sf_dir).persist()
        _PERSISTED[key] = df
    return df


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    hits = contains_matches(docs, "doc_id", "text", bench, "item_id", "text",
                            out_doc="doc_id", out_pat="item_id").withColumn("hit", F.lit(True))
    pool = docs.select("doc_id", F.pmod("doc_id", F.lit(QREL_POOL_MOD)).alias("k")).join(
        bench.select("item_id", F.pmod("item_id", F.lit(QREL_POOL_MOD)).alias("k")), "k"
    ).select("doc_id", "item_id", F.lit(False).alias("hit"))
    pairs = hits.unionByName(pool).groupBy("doc_id", "item_id").agg(F.max("hit").alias("hit")) \
        .join(labels, "doc_id", "left")
    shift = F.when(F.col("item_id") % QREL_SHIFTED[0] == QREL_SHIFTED[1], F.lit(QREL_SHIFTED[2])).otherwise(F.lit(0))
    rel = (F.when(F.col("hit"), F.lit(2) + F.coalesce(F.col("quality"), F.lit(0)))
           .when(F.col("quality") == 1, F.lit(1)).otherwise(F.lit(0)))
    return pairs.select((F.col("item_id") + shift).alias("qid"), F.col("doc_id").alias("docid"),
                        rel.cast("int").alias("relevance_score"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6/T10 pairs ``(pair_id, query, product_text)``: a user turn and the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("product_text"))
    return u.join(a, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "query", "product_text")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as ``(id, product_embedding, label)``, for operators that need no query / product role."""
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("v").alias("product_embedding"), "label")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as ``(turn_id, text)``."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.filter(F.col("vec_id") % VEC_QUERY_MOD == 0).select(
        F.col("vec_id").alias("qid"), F.col("v").alias("query_embedding"), "label")


def vec_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.filter(F.col("vec_id") % VEC_QUERY_MOD != 0).select(
        F.col("vec_id").alias("id"), F.col("v").alias("product_embedding"), "label")


def vec_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same label -> 1 + id % 3; other pool members (id % 20 = qid % 7) -> 0."""
    # Both joins are on keys with few values (10 labels, 20 pool classes): salt them so that one
    # hot key is spread over SALTS tasks -- products get a hashed salt, queries are replicated. Their narrow rows make many pairs, so the number of
    # partitions is held: AQE would put them into one by the size of what goes in.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    q = vec_queries(spark, sf_dir).select("qid", F.col("label").alias("ql"), salts)
    p = vec_products(spark, sf_dir).select("id", F.col("label").alias("pl"),
                                           F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    ql, pl = q.repartition(parts, "ql", "salt"), p.repartition(parts, "pl", "salt")
    same = ql.join(pl, (F.col("ql") == F.col("pl")) & (ql["salt"] == pl["salt"])).select(
        "qid", F.col("id").alias("docid"), (F.lit(1) + F.col("id") % 3).cast("int").alias("relevance_score"))
    qk = q.withColumn("k", F.pmod("qid", F.lit(VEC_POOL[1])).cast("long")).repartition(parts, "k", "salt")
    pk = p.withColumn("k", F.pmod("id", F.lit(VEC_POOL[0])).cast("long")).repartition(parts, "k", "salt")
    other = qk.join(pk, ["k", "salt"]).filter(~F.coalesce(F.col("ql") == F.col("pl"), F.lit(False))).select(
        "qid", F.col("id").alias("docid"), F.lit(0).alias("relevance_score"))
    return same.unionByName(other)


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 generated queries ``(id, product_text, queries)``: the lines of every document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("product_text"),
                    F.split(F.col("text"), "\n").alias("queries"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16 history, long form ``(run, epoch, value)``."""
    e = table(spark, sf_dir, "events")
    epoch = (F.lit(1) + F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int")).alias("epoch")
    return e.groupBy(F.col("event_type").alias("run"), epoch).agg(F.round(F.avg("value"), 6).alias("value"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16 training history, long form ``(run, metric, epoch, value)``: per event type (run) and
    epoch the mean / min / max event value as three metrics."""
    e = table(spark, sf_dir, "events")
    epoch = (F.lit(1) + F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int")).alias("epoch")
    agg = e.groupBy(F.col("event_type").alias("run"), epoch).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("min"),
        F.round(F.max("value"), 6).alias("max"))
    return agg.unpivot(["run", "epoch"], ["mean", "min", "max"], "metric", "value") \
        .select("run", "metric", "epoch", "value")


def trainer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17 ragged trainer log ``(step, epoch, loss, eval_loss)``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("step"),
        F.get_json_object("props", "$.k").cast("int").alias("epoch"),
        F.when(F.col("event_type").isin("click", "view"), F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("eval_loss"),
    )


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17 entries of a trainer and resource log, keys absent where NULL: clicks and views train, purchases evaluate, the others tell resources."""
    e = table(spark, sf_dir, "events")
    k, v, kind = F.get_json_object("props", "$.k").cast("int"), F.col("value"), F.col("event_type")
    train, ev = kind.isin("click", "view"), kind == "purchase"
    other = ~train & ~ev
    return e.select(
        F.col("event_id").alias("step"), F.floor(k / 10).cast("double").alias("epoch"),
        F.when(train, v).alias("loss"), F.when(train, v / 2).alias("grad_norm"), F.when(kind == "click", v / 1000).alias("learning_rate"),
        F.when(ev, v).alias("eval_loss"), F.when(ev, v + 1).alias("eval_runtime"), F.when(ev, v * 2).alias("eval_samples_per_second"),
        F.when(ev & (v > 10), v * 3).alias("eval_steps_per_second"),
        F.when(other, k + F.col("event_id") / 1000).alias("elapsed_time"), F.when(other, v + 100).alias("memory_usage_mb"),
        F.when(other & (kind == "error"), v / 10).alias("cpu_usage_percent"))
