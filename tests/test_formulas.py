"""Hand-computed cases for every formula (BM25 floor, ranking metrics, ROUGE, BLEU, towers, text)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions.text import rouge_tokens, tokenize
from rankforge.operators import bm25, overlap, ranking, towers


def test_tokenizer_sample(spark):
    s = "Men's Jungle-Rat (60ml) 3,000 a,b $5 5% can't U.S. dog. é 漢字 \"x\" end."
    df = spark.createDataFrame([(s,)], "t string")
    got = df.select(F.array_join(tokenize(F.col("t"), stopwords=False), " ")).first()[0]
    assert got == "men 60ml a b 5 5 ca dog é 漢字 x end"
    with_sw = df.select(F.array_join(tokenize(F.col("t")), " ")).first()[0]
    assert with_sw == "men 60ml b 5 5 ca dog é 漢字 x end"


def test_null_text_tokenizes_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(F.size(tokenize(F.col("t")))).first()[0] == 0


def test_bm25_negative_idf_floor(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple cherry"), (3, "apple date"), (4, "kiwi")],
                                 "id long, product_text string")
    idx = bm25.build_index(docs, k1=1.5, b=0.75, epsilon=0.25)
    ts = {r["term"]: r for r in idx.term_stats.collect()}
    n = 4
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in
           {"apple": 3, "banana": 1, "cherry": 1, "date": 1, "kiwi": 1}.items()}
    mean = sum(raw.values()) / len(raw)
    assert raw["apple"] < 0
    assert ts["apple"]["idf"] == pytest.approx(0.25 * mean)
    assert ts["kiwi"]["idf"] == pytest.approx(raw["kiwi"])
    # score of doc 1 for query "banana banana" counts the repeated term twice
    q = spark.createDataFrame([(7, "banana banana")], "qid long, text string")
    pairs = spark.createDataFrame([(7, 1), (7, 4)], "qid long, id long")
    s = {r["id"]: r["score"] for r in bm25.bm25_scores(idx, q, pairs).collect()}
    avgdl = 7 / 4
    one = raw["banana"] * 1 * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * 2 / avgdl))
    assert s[1] == pytest.approx(2 * one)
    assert s[4] == 0.0


def _scored(spark, rows):
    return spark.createDataFrame(rows, "qid long, docid long, relevance_score int, score double")


def test_ndcg_precision_recall_cases(spark):
    rows = [(1, 10, 3, 0.9), (1, 11, 0, 0.8), (1, 12, 2, 0.7),   # 3 judged docs, k = 5
            (2, 20, 0, 0.5), (2, 21, 0, 0.4)]                       # all zero -> undefined NDCG
    ev = spark.createDataFrame([(1,), (2,), (3,)], "qid long")       # qid 3: no judged doc
    m = {r["qid"]: r for r in ranking.per_query_metrics(ev, _scored(spark, rows), p=5, k=5).collect()}
    dcg = 3 / math.log2(2) + 0 + 2 / math.log2(4)
    idcg = 3 / math.log2(2) + 2 / math.log2(3)
    assert m[1]["ndcg"] == pytest.approx(round(dcg / idcg, 5))
    assert m[1]["precision"] == pytest.approx(2 / 5)   # divided by k, not by the list length
    assert m[1]["recall"] == pytest.approx(1.0)
    assert m[2]["ndcg"] is None and m[2]["precision"] == 0.0 and m[2]["recall"] == 0.0
    assert m[3]["ndcg"] is None and m[3]["precision"] == 0.0
    macro = ranking.macro_mean(ranking.per_query_metrics(ev, _scored(spark, rows), 5, 5)).first()
    assert macro["n_undefined"] == 2 and macro["n_queries"] == 3


def test_score_ties_break_by_docid(spark):
    rows = [(1, 30, 1, 0.5), (1, 20, 0, 0.5), (1, 10, 2, 0.5)]
    r = ranking.rank_within(_scored(spark, rows), "score").orderBy("rank").collect()
    assert [x["docid"] for x in r] == [10, 20, 30]


def test_rouge_hand_cases(spark):
    df = spark.createDataFrame([(1, "the cat", "the cat sat"), (2, "a b c", "a b c"), (3, "x y", "p q"), (4, "", "p q")],
                               "k long, pred string, ref string")
    r = {x["k"]: x for x in overlap.rouge(df, "k", "pred", "ref").collect()}
    assert r[1]["rouge1"] == pytest.approx(0.8)
    assert r[1]["rouge2"] == pytest.approx(2 / 3)
    assert r[1]["rougeL"] == pytest.approx(0.8)
    assert r[1]["rougeLsum"] == pytest.approx(0.8)
    assert r[2]["rouge1"] == pytest.approx(1.0) and r[2]["rougeL"] == pytest.approx(1.0)
    assert r[3]["rouge1"] == 0.0 and r[3]["rougeL"] == 0.0
    assert r[4]["rouge1"] == 0.0 and r[4]["rougeLsum"] == 0.0


def test_bleu_hand_cases(spark):
    df = spark.createDataFrame([(1, "the quick brown fox jumps", "the quick brown fox jumps"),
                                (2, "alpha beta", "gamma delta"), (3, "", "gamma delta")], "k long, pred string, ref string")
    b = {x["k"]: x["bleu"] for x in overlap.bleu(df, "k", "pred", "ref").collect()}
    assert b[1] == pytest.approx(1.0)
    assert b[2] == 0.0 and b[3] == 0.0


def test_lcs_matches_brute_force():
    rng = np.random.default_rng(3)

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
        return t[-1][-1]

    for _ in range(200):
        a = list(rng.integers(0, 5, rng.integers(0, 12)))
        b = list(rng.integers(0, 5, rng.integers(0, 12)))
        assert overlap.lcs_len(a, b) == brute(a, b)


def test_rouge_tokens(spark):
    df = spark.createDataFrame([("Don't STOP-me now!! 42",)], "t string")
    assert df.select(F.array_join(rouge_tokens("t"), " ")).first()[0] == "don t stop me now 42"


def test_tower_forward_hand_case():
    # 2 -> 2 (elu) -> 2, then L2 norm; one negative pre-activation so that elu matters
    w1, b1 = np.array([[1.0, -2.0], [0.5, 1.0]]), np.array([0.0, 0.0])
    w2, b2 = np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([0.0, 0.0])
    theta = np.concatenate([w1.ravel(), b1, w2.ravel(), b2])
    params, _ = towers.unpack(theta, 2, [2, 2])
    x = np.array([[1.0, 1.0]])
    y, _ = towers.forward(params, x)
    a = np.array([1.5, -1.0])              # x @ w1
    h = np.array([1.5, math.exp(-1.0) - 1])  # elu
    assert np.allclose(y[0], h / np.linalg.norm(h))


def test_tower_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    layers = [4, 3]
    tq, tp = towers.init_params(5, layers, 1), towers.init_params(6, layers, 2)
    xq, xp = rng.normal(size=(4, 5)), rng.normal(size=(4, 6))
    loss, g = towers.batch_loss_grad(tq, tp, xq, xp, 5, 6, layers)
    theta = np.concatenate([tq, tp])
    eps = 1e-6
    for i in rng.choice(len(theta), 12, replace=False):
        t2 = theta.copy()
        t2[i] += eps
        l2, _ = towers.batch_loss_grad(t2[:len(tq)], t2[len(tq):], xq, xp, 5, 6, layers)
        assert (l2 - loss) / eps == pytest.approx(g[i], rel=1e-3, abs=1e-5)


def _lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def test_bit_parallel_lcs_equals_the_table():
    import random

    rng = random.Random(8)
    for _ in range(400):
        a, b = ([rng.choice("abcdefgh"[:rng.randint(1, 8)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        t = _lcs_table(a, b)
        assert overlap.lcs_len(a, b) == t[-1][-1]
        i, j, want = len(a), len(b), []
        while i and j:
            if a[i - 1] == b[j - 1]:
                want.append(i - 1)
                i, j = i - 1, j - 1
            elif t[i - 1][j] > t[i][j - 1]:
                i -= 1
            else:
                j -= 1
        assert overlap._lcs_indices(a, b) == want[::-1]


def test_lcs_of_long_texts_in_bounded_memory():
    import random
    import tracemalloc

    rng = random.Random(9)
    words = [str(k) for k in range(500)]
    a = [rng.choice(words) for _ in range(20_000)]
    b = [w for w in a if rng.random() < 0.7] + [rng.choice(words) for _ in range(6_000)]
    tracemalloc.start()
    at = overlap._lcs_indices(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # the table would have some 400 million cells
    assert len(at) == overlap.lcs_len(a, b) > 13_000 and all(x < y for x, y in zip(at, at[1:]))
    it = iter(b)
    assert all(a[i] in it for i in at)  # a subsequence of the other text too
