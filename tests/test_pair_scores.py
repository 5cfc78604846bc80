"""Scores of pairs by blocks: the rows of the two equi joins, whatever the vectors and keys, and no pair that travels with a vector."""

import pytest
from pyspark.sql import functions as F

from rankforge.functions import vectors as V
from rankforge.operators import vectors

ODD = [[1.0, 2.0, 3.0], [0.5, -1.0, 2.0], [0.0, 0.0, 0.0], None, [1.0, None, 2.0], [1.0, 2.0], [], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [3.0, 1.0, 0.25]]


def _tables(spark):
    q = spark.createDataFrame([(i % 8 if i < 10 else None, v) for i, v in enumerate([*ODD, [1.0, 1.0, 1.0]])], "qid long, query_embedding array<double>")
    p = spark.createDataFrame([(100 + i % 9 if i < 10 else None, v) for i, v in enumerate([*ODD, [1.0, 1.0, 1.0]])], "id long, product_embedding array<double>")
    ids = [*range(10), None]
    pairs = spark.createDataFrame([(a, None if b is None else 100 + b, f"{a}-{b}") for a in ids for b in [*ids, 3]], "qid long, docid long, note string")
    return q, p, pairs


@pytest.mark.parametrize("fn", list(vectors.KERNELS))
def test_blocks_equal_joins(spark, fn):
    q, p, pairs = _tables(spark)
    plain = lambda a, b: fn(a, b)  # noqa: E731  (not among the kernels: two equi joins)
    want, got = vectors.pair_scores(pairs, q, p, plain), vectors.pair_scores(pairs, q, p, fn, block=3)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    key = lambda r: tuple(str(x if not isinstance(x, float) else round(x, 9) + 0.0) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_no_pair_is_shuffled_with_a_vector(spark):
    q, p, pairs = _tables(spark)
    plan = vectors.pair_scores(pairs, q, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


def test_empty_sides(spark):
    q, p, pairs = _tables(spark)
    assert vectors.pair_scores(pairs.limit(0), q, p).count() == 0
    assert vectors.pair_scores(pairs, q.limit(0), p).count() == 0
    assert vectors.pair_scores(pairs, q, p.filter(F.lit(False)), V.dot).count() == 0
