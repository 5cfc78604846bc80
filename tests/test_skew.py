"""Split joins and pruned search against their plain forms."""

import random

from pyspark.sql import functions as F

from rankforge.operators import bm25, tfidf
from rankforge.operators.skew import heavy_terms, split_join


def _rows(n):
    return [(i, "the") for i in range(n)] + [(i, f"t{i % 97}") for i in range(n)] + [(n, None)]


def test_split_join_equals_join_and_spreads_a_term_of_every_row(spark):
    rows = spark.createDataFrame(_rows(4000), "id long, term string")
    stats = rows.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    heavy = heavy_terms(stats, share=32)
    assert {r.term: r._copies for r in heavy.collect()} == {"the": 16}
    other = stats.select("term", (F.col("df") * 2).alias("v"))
    got = split_join(rows, other, heavy, ["id"])
    assert sorted(got.select("id", "term", "v").collect()) == sorted(rows.join(other, "term").select("id", "term", "v").collect())
    # rows of a (term, copy) key: the heavy term's keys are no larger than a few times an even share
    copies = rows.filter("term = 'the'").groupBy(F.pmod(F.xxhash64("id"), F.lit(16)).alias("c")).count().collect()
    assert len(copies) == 16 and max(r["count"] for r in copies) < 2 * 4000 / 16
    assert split_join(rows.limit(0), other, heavy, ["id"]).count() == 0
    assert split_join(rows, other.limit(0), heavy_terms(stats.limit(0)), ["id"]).count() == 0


def test_transform_with_a_term_in_every_row(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7} " + "common " * (i % 3)) for i in range(300)] + [(300, None), (301, "")], "k long, text string")
    vocab = tfidf.fit(docs, ["k"])
    counts = tfidf.term_counts(docs, ["k"]).join(vocab.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = counts.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    want = counts.join(norms, "k").select("k", "term", F.round(F.col("w") / F.col("norm"), 9).alias("weight"))
    got = tfidf.transform(docs, ["k"], vocab).select("k", "term", F.round("weight", 9).alias("weight"))
    assert sorted(got.collect()) == sorted(want.collect())


def _corpus(spark, seed, docs=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.06)), 119)] for _ in range(n))
    d = [(i, text(r.randint(1, 40))) for i in range(docs)] + [(docs, None), (docs + 1, ""), (docs + 2, "w0 " * 200)]
    d += [(docs + 3 + i, d[5][1]) for i in range(8)]  # ties
    q = [(i, text(r.randint(1, 9))) for i in range(40)] + [(40, None), (41, "nowhere"), (42, "w119"), (43, "w0 w0 w0 w1"), (44, "")]
    return spark.createDataFrame(d, "id long, product_text string"), spark.createDataFrame(q, "qid long, text string")


def test_pruned_search_gives_the_same_rows_and_reads_less(spark):
    for seed, n, epsilon in ((1, 3, 0.1), (2, 10, 0.25), (3, 1, -0.5)):  # a negative floor makes terms of negative weight
        docs, queries = _corpus(spark, seed)
        index = bm25.build_index(docs, epsilon=epsilon)
        q = bm25.query_terms(index, queries)
        plain = bm25.top_n(bm25.score_matches(index, q).withColumn("score", F.round("score", 9)), n)
        pruned = bm25.top_n(bm25.best_matches(index, queries, n).withColumn("score", F.round("score", 9)), n)
        key = lambda rows: sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in rows.collect())
        assert key(pruned) == key(plain)
        if epsilon > 0 and n == 3:
            terms = bm25.essential_terms(index, bm25.term_bounds(index, q), n)
            every, whole = terms.agg(F.sum("df"), F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0))).first()
            print("postings", every, whole)
            assert whole < every
