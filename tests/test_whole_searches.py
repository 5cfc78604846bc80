"""The searches answer every query vector (ids divisible by 10) against all vectors; those with ids divisible by 20 alone are half of them."""

import numpy as np
import pytest

import __spark_entry__ as E


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("vectors"))
    x = np.random.default_rng(4).normal(size=(61, 5)).astype(np.float32)
    rows = [(i, x[i].tolist(), f"l{i % 3}") for i in range(61)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{at}/embeddings.parquet")
    return at, x.astype(np.float64)


@pytest.mark.parametrize("name, k, nearest", [("brute_force_topk", 10, False), ("index_search", 10, True), ("index_top_n", 5, True)])
def test_every_query_meets_every_vector(spark, folder, name, k, nearest):
    at, x = folder
    got = {(r["qid"], r["rank"]): r["id"] for r in E.queries()[name](spark, at).collect()}
    want = {}
    for qid in range(0, 61, 10):
        cost = np.sqrt(((x - x[qid]) ** 2).sum(1)) if nearest else -(x @ x[qid])
        want |= {(qid, rank): int(i) for rank, i in enumerate(np.lexsort((np.arange(61), np.round(cost, 9)))[:k], 1)}
    assert got == want
    assert "vec_id % 20" not in E.oracle_sql()[name].split("fx_vec_queries AS")[1].split("fx_vectors AS")[0]
