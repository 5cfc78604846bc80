"""Steps whose memory, time or shuffled bytes grew faster than their input; keys may repeat or be NULL."""

import pytest

import __spark_entry__ as E
from rankforge.operators import overlap, synth, vectors


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_pairs_pass_by_their_vectors_unsorted(spark):
    pairs = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 9), (4, None), (None, 7)], "qid long, docid long")
    vecs = spark.createDataFrame([(7, [1.0, 2.0]), (8, [3.0]), (8, []), (9, None), (None, [1.0])], "docid long, v array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = vectors.attach(pairs, vecs, "docid")
        assert sorted(((r["qid"] or 0, r["docid"], r["v"]) for r in j.collect()), key=str) == sorted(
            [(1, 7, [1.0, 2.0]), (2, 7, [1.0, 2.0]), (2, 8, [3.0]), (2, 8, []), (3, 9, None), (0, 7, [1.0, 2.0])], key=str)
        assert "Sort" not in _plan(j)  # a task sorted all of its pairs before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_generator_sends_a_term_once_a_block(spark):
    text = "red blue blue green"
    docs = spark.createDataFrame([(1, text), (2, "blue Red"), (2, "pink red"), (3, None), (None, "red pink"), (None, "pink"), (4, "a b")], "id long, product_text string")
    got = {(r["id"], r["qpos"]): r["query"] for r in synth.generate_queries(docs, num_queries=2, window=2).collect()}
    assert got[(1, 0)] == "red blue" and got[(1, 1)] == "green" and (got[(2, 0)], got[(2, 1)]) == ("blue pink", "red") and len(got) == 4
    many = spark.range(3000).selectExpr("id", f"'{text}' as product_text")
    ranked = synth.ranked_terms(many, k=2)
    rows = ranked.collect()
    assert len(rows) == 3000 and {(tuple(r["terms"]), tuple(r["ranks"])) for r in rows} == {(("blue", "green"), (1, 2))}
    assert "SortMergeJoin" not in _plan(ranked) and "[term" not in " ".join(x for x in _plan(ranked).splitlines() if "Join" in x)  # every term of every document was joined


def test_rows_are_encoded_where_they_are(spark):
    docs = spark.createDataFrame([(1, "red blue blue a"), (2, None), (3, ""), (4, "Ünï_1 red")], "id long, text string")
    own = synth.embed_rows(docs, "text", 8, "v")
    assert "Exchange" not in _plan(own)
    want = {r["id"]: r["v"] for r in synth.embed_texts(docs, "id", "text", dim=8, out="v").collect()}
    assert all(r["v"] == pytest.approx(want[r["id"]]) and len(r["v"]) == 8 for r in own.collect())


def test_rouge_sends_texts_not_grams(spark):
    rows = [(1, "red blue red", "red red pink"), (2, None, "x"), (3, "", ""), (4, "a b\nc", "c a b"), (4, "a b", "a"), (None, "a", "a")]
    df = spark.createDataFrame(rows, "k long, p string, r string")
    whole = overlap.rouge(df, "k", "p", "r")
    got = sorted((r["k"], round(r["rouge1"], 6), round(r["rouge2"], 6)) for r in whole.select("k", "rouge1", "rouge2").collect())
    by_gram = [(r["k"], round(r["rouge1"], 6), round(r["rouge2"], 6)) for r in overlap.rouge_n(df, "k", "p", "r").collect()]
    assert got == sorted([x for x in by_gram for _ in range(2 if x[0] == 4 else 1)])  # joined once more with the rows of the key
    assert _plan(whole).count("Exchange hashpartitioning") == 1


def test_pairs_are_embedded_whole(spark, tmp_path):
    """Each pair has its query's vector and its product's; only the queries' norms met the products."""
    g = spark.createDataFrame([(1, ["red blue", "", "red blue", "a"]), (2, ["red"]), (2, ["red"]), (10, ["pink"]), (None, ["red"]), (3, None)], "id long, queries array<string>")
    p = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (2, None), (3, [1.0, 1.0])], "id long, product_embedding array<double>")
    pairs = synth.embed_pairs(g, p, 8)
    want = {r["t"]: r["v"] for r in synth.embed_texts(spark.createDataFrame([("red blue",), ("a",), ("red",), ("pink",)], "t string")
                                                      .selectExpr("t", "t as text"), "t", "text", dim=8, out="v").collect()}
    got = sorted(((r["id"] or 0, r["query"], r["product_embedding"] or []) for r in pairs.collect()), key=str)
    assert got == sorted([(0, "red", []), (1, "a", [1.0, 2.0]), (1, "red blue", [1.0, 2.0]), (10, "pink", []), *[(2, "red", v) for v in ([3.0, 4.0], []) * 2]], key=str)
    assert all(r["query_embedding"] is None if r["id"] is None else r["query_embedding"] == pytest.approx(want[r["query"]]) for r in pairs.collect())
    spark.createDataFrame([(1, "red blue\n\nred blue"), (2, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.5], "x") for i in (1, 5, 10)], "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = E.queries()["embed_pairs"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, "red blue", 1.0, True), (2, "a", 0.0, False)]
    table = spark.read.parquet(next(f for f in df.inputFiles()).rsplit("/", 1)[0])
    assert {r["id"]: (len(r["query_embedding"]), r["product_embedding"]) for r in table.collect()} == {1: (64, [1.0, 0.5]), 2: (64, None)}
