"""Scoring joins read each posting once, by document, and keep their rows whatever keys repeat or are NULL."""

import pytest
from pyspark.sql import functions as F

from rankforge.operators import bm25, clean, synth

DOCS = [(1, "red blue blue"), (2, "blue green"), (2, "green red"), (3, ""), (4, None), (None, "red pink"), (5, "pink pink red green")]
QUERIES = [(10, "blue red red"), (11, "pink"), (12, "absent"), (13, None)]


def _index(spark, **kw):
    return bm25.build_index(spark.createDataFrame(DOCS, "id long, product_text string"), **kw)


def test_postings_are_made_in_one_pass(spark):
    idx = _index(spark)
    got = sorted((r["term"], r["id"] or 0, r["tf"]) for r in idx.postings.collect())
    assert got == [("blue", 1, 2), ("blue", 2, 1), ("green", 2, 2), ("green", 5, 1), ("pink", 0, 1), ("pink", 5, 2), ("red", 0, 1), ("red", 1, 1), ("red", 2, 1), ("red", 5, 1)]
    assert idx.corpus_stats().first()["corpus_size"] == 7
    own = bm25.build_index(spark.createDataFrame(DOCS, "id long, product_text string"), tokenizer=lambda t: (t or "").split())
    assert sorted((r["term"], r["id"] or 0, r["tf"]) for r in own.postings.collect()) == got
    lazy = _index(spark, materialize=False).postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in lazy  # the texts were read twice before, for tokens and for the count of documents


def test_pairs_meet_postings_by_document(spark):
    idx = _index(spark)
    q = spark.createDataFrame(QUERIES, "qid long, text string")
    pairs = spark.createDataFrame([(x, i) for x in (10, 11, 12, 13) for i in (1, 2, 3, 5)] + [(10, None), (None, 1)], "qid long, id long")
    whole = {(r["qid"], r["id"]): r["score"] for r in bm25.score_matches(idx, bm25.query_terms(idx, q)).collect()}
    some = {(r["qid"], r["id"]): r["score"] for r in bm25.score_matches(idx, bm25.query_terms(idx, q), pairs).collect()}
    assert some == pytest.approx(whole) and set(some) == {(10, 1), (10, 2), (10, 5), (11, 5)}
    scores = bm25.score_matches(idx, bm25.query_terms(idx, q), pairs)
    scores.collect()
    assert "term" not in [k for line in scores._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line
                          for k in line.split("hashpartitioning(")[1].split(")")[0].replace("#", " ").split()]
    for prune in (False, True):
        top = [(r["qid"], r["id"]) for r in bm25.search(idx, q, 3, prune=prune).orderBy("qid", "rank").collect()]
        assert [i for x, i in top if x == 12 and i is not None] == [1, 2] and [i for x, i in top if x == 10] == [1, 2, 5]


def test_texts_are_not_shuffled_to_drop_copies(spark):
    rows = [(1, "a", "b"), (2, "a", "b"), (2, "a", "b"), (3, "a", None), (4, "a", None), (None, "x", "y"), (None, "a", "b"), (5, "1:b", ""), (6, "1", "b")]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    out = clean.dedupe_text(df)
    assert sorted(r["id"] for r in out.collect()) == [1, 3, 5, 6]
    assert out.columns == df.columns
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    two = clean.dedupe_text(df.withColumn("n", F.lit(1)), order_by=("id", "n"))
    assert sorted(r["id"] for r in two.collect()) == [3, 5, 6]  # a NULL comes first and equals nothing


def test_sparse_distances_of_pairs(spark):
    q = spark.createDataFrame([(1, 0, 0.6), (1, 3, 0.8), (2, 1, 1.0)], "qid long, bucket int, value double")
    d = spark.createDataFrame([(7, 0, 1.0), (8, 3, -1.0)], "docid long, bucket int, value double")
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 9), (3, 7), (3, 9)], "qid long, docid long")
    got = {(r["qid"], r["docid"]): round(r["distance"], 9) for r in synth.sparse_distance(q, d, pairs).collect()}
    assert got == {(1, 7): round(0.8 ** 0.5, 9), (1, 8): round(3.6 ** 0.5, 9), (2, 7): round(2 ** 0.5, 9), (2, 9): 1.0, (3, 7): 1.0, (3, 9): 0.0}
