"""Spark operators against plain-Python brute force on the smallest fixture."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rankforge.functions.text import python_tokenizer
from rankforge.operators import bm25, clean
from rankforge.operators.textmatch import contains_matches
from rankforge.sources import fixtures as fx
from rankforge.sources.tables import table


def test_containment_scan_equals_naive_substring_search(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    bench = table(spark, SF_SMALL, "benchmark").select("item_id", "text")
    got = {(r["doc_id"], r["pattern_id"]) for r in contains_matches(docs, "doc_id", "text", bench, "item_id", "text").collect()}
    d = [(r["doc_id"], r["text"]) for r in docs.collect()]
    b = [(r["item_id"], r["text"]) for r in bench.collect()]
    want = {(di, bi) for di, dt in d for bi, bt in b if dt is not None and bt is not None and bt in dt}
    assert got == want and len(want) > 0


def test_containment_of_odd_patterns_and_hot_windows(spark):
    import random

    rng = random.Random(7)
    words = ["ab", "abc", "b", "c", "é", "中文", "x.y", "it's"]
    texts = [None, "", " ", "ab", "a", "xab cy", "ab  c", "ab\nc b", " lead", "trail ", "one two three four five six"]
    texts += [rng.choice([" ", " ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    pats = [None, "", " ", "a", "b c", "ab  c", "c b ab", "zzz", "ne two three four fiv", "wo three f", " lead", "trail ", "文 é", "文", "\n", "x.y it's b c é 中"]
    for t in texts[11:111]:  # pieces of texts, cut anywhere
        a = rng.randrange(len(t))
        pats.append(t[a:a + rng.randint(1, 40)])
    pats += [texts[20], texts[20], texts[20] + " never", "ab abc b c"]
    docs = spark.createDataFrame([(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)] + [(None, "ab")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(pats)) + [(None, "ab")], "item_id long, text string")
    got = Counter((r["doc_id"], r["pattern_id"]) for r in contains_matches(docs, "doc_id", "text", bench, "item_id", "text").collect())
    want = Counter((i // 2 if i < 20 else i, j) for i, t in enumerate(texts) for j, x in enumerate(pats) if t is not None and x is not None and x in t)
    assert got == want
    assert contains_matches(docs, "doc_id", "text", bench.limit(0), "item_id", "text").collect() == []
    assert contains_matches(docs.limit(0), "doc_id", "text", bench, "item_id", "text").collect() == []


def test_bm25_scores_equal_plain_python_okapi(spark):
    k1, b, eps = 1.2, 0.9, 0.1
    coll = clean.clean_collection(fx.collection(spark, SF_SMALL)).select("id", "product_text")
    docs = {r["id"]: python_tokenizer(r["product_text"]) for r in coll.collect()}
    n = len(docs)
    avgdl = sum(len(t) for t in docs.values()) / n
    df = Counter(t for toks in docs.values() for t in set(toks))
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {t: (floor if v < 0 else v) for t, v in idf.items()}
    tf = {i: Counter(t) for i, t in docs.items()}
    queries = {r["qid"]: r["text"] for r in fx.queries(spark, SF_SMALL).collect() if r["text"] is not None}

    def score(q, i):
        s = 0.0
        for term in python_tokenizer(q):
            f = tf[i].get(term, 0)
            if f:
                s += idf.get(term, 0) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(docs[i]) / avgdl))
        return s

    idx = bm25.build_index(coll, k1=k1, b=b, epsilon=eps)
    got = bm25.score_matches(idx, bm25.query_terms(idx, fx.queries(spark, SF_SMALL))).collect()
    assert len(got) > 0
    for r in got:
        assert r["score"] == pytest.approx(score(queries[r["qid"]], r["id"]), rel=1e-9, abs=1e-12)
    # documents with no shared term are exactly the ones Spark leaves out (score 0.0)
    matched = {(r["qid"], r["id"]) for r in got}
    some_q = next(iter(queries))
    for i in list(docs)[:50]:
        if (some_q, i) not in matched:
            assert score(queries[some_q], i) == 0.0
    top = bm25.search(idx, fx.queries(spark, SF_SMALL), 5).filter(F.col("qid") == some_q).orderBy("rank").collect()
    want = sorted(docs, key=lambda i: (-round(score(queries[some_q], i), 9), i))[:5]
    assert [r["id"] for r in top] == want[:len(top)]
