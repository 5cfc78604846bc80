"""The ball index against brute force for every metric, and how much it skips."""

import numpy as np
import pytest

from rankforge.operators import ball_search
from rankforge.operators.ball_search import BallIndex, split_balls


def _frames(spark, n=600, dim=6, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(15, dim)) * 3
    x = np.round(centers[r.integers(0, 15, n)] + r.normal(size=(n, dim)) * 0.2, 3)
    x[50:130] = x[0]  # one vector very often
    x[7] = 0
    rows = [(i, x[i].tolist()) for i in range(n)]
    c = spark.createDataFrame([*rows, (None, [0.0] * dim), (9999, None)], "id long, product_embedding array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, n, 20)] + [(-1, None)], "qid long, query_embedding array<double>")
    return x, c, q


def _plain(x, metric, k):
    out = set()
    for i in range(0, len(x), 20):
        if metric == "l2":
            s = np.sqrt(((x - x[i]) ** 2).sum(1))
        else:
            s = x @ x[i]
            if metric == "cosine":
                n = np.linalg.norm(x, axis=1) * np.linalg.norm(x[i])
                s = np.divide(s, n, out=np.zeros(len(x)), where=n > 0)
        order = np.lexsort((np.arange(len(x)), np.round(s, 6) * (1 if metric == "l2" else -1)))[:k]
        out |= {(i, int(j), rank) for rank, j in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("metric", ["dot", "l2", "cosine"])
def test_equals_brute_force(spark, metric, monkeypatch):
    for name, n in (("BALL_ROWS", 16), ("GROUP_ROWS", 100), ("PIVOTS", 4), ("QUERY_BLOCK", 7), ("HEAD_BLOCK", 11), ("MEET", 9)):
        monkeypatch.setattr(ball_search, name, n)
    x, c, q = _frames(spark)
    got = BallIndex.build(c, metric).search(q, 12, digits=6)
    assert {(r.qid, r.id, r.rank) for r in got.collect()} == _plain(x, metric, 12)


def test_written_index_and_visits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ball_search, "BALL_ROWS", 16)
    x, c, q = _frames(spark)
    BallIndex.build(c, "l2").write(str(tmp_path / "balls"))
    index = BallIndex.read(spark, str(tmp_path / "balls"))
    n = index.visits(q, 5).first()
    assert n.n_queries == 30 and index.balls.agg({"n": "sum"}).first()[0] == len(x)
    assert 30 <= n.n_read < n.n_queries * n.n_balls / 3
    assert {(r.qid, r.id, r.rank) for r in index.search(q, 5, digits=6).collect()} == _plain(x, "l2", 5)


def test_few_candidates_and_empty_tables(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.5, 0.5])], "id long, product_embedding array<double>")
    q = spark.createDataFrame([(5, [1.0, 0.0])], "qid long, query_embedding array<double>")
    assert [(r.id, r.rank, r.score) for r in BallIndex.build(c, "dot").search(q, 10).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 0.5), (2, 3, 0.0)]
    assert BallIndex.build(c, "dot").search(q.limit(0), 10).collect() == []
    assert BallIndex.build(c.limit(0), "dot").search(q, 10).collect() == []


def test_split():
    x = np.concatenate([np.random.default_rng(3).normal(size=(500, 3)), np.ones((200, 3))])
    parts = split_balls(x, 20)
    assert max(map(len, parts)) <= 20 and sorted(np.concatenate(parts).tolist()) == list(range(700))
