"""Steps whose files on disk grew with the square of the input, or held every text several times at once; keys may repeat or be NULL."""

import os

import numpy as np
import pyarrow as pa

from rankforge.functions import vectors as V
from rankforge.operators import search, vectors
from rankforge.sources import io


def test_triples_are_written_gzipped_by_slices(spark, tmp_path, monkeypatch):
    rows = [(q, f"q{q}" if q else None, "positive" if d % 3 else "negative", 0, d, f"text {d}" if d % 4 else None) for q in [*range(9), None] for d in range(7)]
    flat = spark.createDataFrame([*rows, rows[3]], "query_id long, query string, kind string, pos int, docid long, text string")
    released = []
    monkeypatch.setattr(io, "release_shuffles", lambda s: released.append(1))
    io.write_triples(flat, f"{tmp_path}/whole")
    monkeypatch.setattr(io, "SLICE_ROWS", 20)
    io.write_triples(flat, f"{tmp_path}/slices")
    assert len(released) == 4
    whole, slices = (sorted(map(str, io.read_triples(spark, f"{tmp_path}/{x}").collect())) for x in ("whole", "slices"))
    assert whole == slices and len(whole) == 71
    assert all(f.endswith(".json.gz") for f in spark.read.json(f"{tmp_path}/slices").inputFiles())


def test_pairs_are_packed_and_come_back_whole(spark, monkeypatch):
    q, p = np.repeat(np.arange(100), 400), np.tile(np.arange(400), 100)
    t = pa.RecordBatch.from_arrays([pa.array(q % 3), pa.array(q), pa.array(p), pa.array([f"n{x}" if x % 7 else None for x in p])], ["_block", "qid", "docid", "note"])
    rows = [r for b in vectors._packed(iter([t.slice(0, 9000), t.slice(9000, 0), t.slice(9000)]), ["docid", "qid", "note"], 20_000) for r in b.to_pylist()]
    assert {r["_block"] for r in rows} == {0, 1, 2} and len(rows) == 3  # the second piece ends the chunk
    ids = [len(x) for b in vectors._packed(iter([t]), ["docid", "qid"], 20_000) for x in b.column("_data").to_pylist()]
    assert sum(ids) < 40_000  # under a byte a pair; ids alone had sixteen before compression
    got = {(r["_block"], *x.values()) for r in rows for x in vectors._unpacked(pa.chunked_array([[r["_data"]]], pa.binary())).to_pylist()}
    assert got == {(int(a % 3), int(b), int(a), f"n{b}" if b % 7 else None) for a, b in zip(q, p, strict=True)}
    vec = lambda name: spark.range(60).selectExpr(f"id as {name}", "array(double(id), 1.0) as v")
    pairs = spark.range(60).selectExpr("id as qid", "explode(sequence(0, 59)) as docid", "id % 5 as k").repartition(3)
    monkeypatch.setattr(vectors, "CHUNK", 100)
    s = vectors.pair_scores(pairs, vec("qid"), vec("id"), V.dot, q_vec="v", p_vec="v", block=20)
    assert sorted((r["qid"], r["docid"], r["k"], r["score"]) for r in s.collect()) == [(i, j, i % 5, i * j + 1.0) for i in range(60) for j in range(60)]
    lines = [x for x in s._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(_block" in x]
    assert len(lines) >= 2 and "FlatMapCoGroupsInArrow" in s._jdf.queryExecution().executedPlan().toString()


def test_cosines_are_listed_where_they_are_made(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(40, 3))
    q = spark.createDataFrame([*((i % 18, x[i].tolist()) for i in range(20)), (None, [1.0, 1.0, 1.0])], "qid long, query_embedding array<double>")
    p = spark.createDataFrame([*((100 + i % 18, x[20 + i].astype("f4").tolist()) for i in range(20)), (130, None)], "id long, product_embedding array<double>")
    pairs = spark.createDataFrame([(i, 100 + j) for i in range(20) for j in range(20) if (i + j) % 3] + [(1, 130), (2, 130), (1, 101), (None, 101), (1, None)], "qid long, docid long")
    monkeypatch.setattr(vectors, "GROUP_PAIRS", 5)
    own = vectors.semantic_similarity(pairs, q, p)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("FlatMapCoGroupsInArrow")[0]  # scores were shuffled to their products
    monkeypatch.setattr(vectors, "QUERY_BYTES", 0)
    by_blocks = vectors.semantic_similarity(pairs, q, p)
    assert "Aggregate" in by_blocks._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    key = lambda r: (r["docid"], r["n_queries"], round(r["mean_cosine"], 9), [round(c, 9) + 0.0 for c in r["cosines"]])
    got = sorted(map(key, own.collect()))
    assert got == sorted(map(key, by_blocks.collect())) and own.dtypes == by_blocks.dtypes and len(got) == 19
    assert vectors.semantic_similarity(pairs, q.limit(0), p).count() == 0


def test_single_precision_only_where_it_holds(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    assert tuple(vectors._size(df([(1, [0.5, float("nan")]), (2, None), (3, [None, 2.0, 1.0])]), "v")) == (3, True, 3)
    assert vectors._size(df([(1, [0.5]), (2, [0.1])]), "v")[1] is False and vectors._size(df([]), "v") == (0, True, 0)


def test_accuracy_by_slices_equals_the_whole(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(60, 3))
    q = spark.createDataFrame([(i, x[i].tolist()) for i in [*range(12), 3]] + [(None, [1.0, 1.0, 1.0]), (50, None)], "qid long, query_embedding array<double>")
    c = spark.createDataFrame([(i, x[i].tolist()) for i in [*range(60), 7]] + [(None, [1.0, 0.0, 0.0])], "id long, product_embedding array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(i, 60, 3)] + [(2, 5), (2, 5), (50, 1), (None, 3)], "qid long, docid long")
    counts = lambda a, b: search.greater_counts(a, c, vectors.pair_scores(b, a, c, V.dot, "own_score"))
    whole = search.accuracy_by_slices(q, pairs, counts)
    monkeypatch.setattr(search, "SLICE_PAIRS", 60)
    kept = spark.conf.get("spark.checkpoint.dir")
    before = {f for f in os.listdir(kept) if f.startswith("own-scores")}
    slices = search.accuracy_by_slices(q, pairs, counts)
    assert {f for f in os.listdir(kept) if f.startswith("own-scores")} == before  # the pairs of all queries lay there at once
    assert slices.columns == whole.columns and [t for _, t in slices.dtypes] == [t for _, t in whole.dtypes]
    assert [round(float(v), 12) for v in slices.first()] == [round(float(v), 12) for v in whole.first()] and whole.first()["n_pairs"] > 180
    monkeypatch.setattr(search, "SLICE_PAIRS", 1)
    assert tuple(search.accuracy_by_slices(q.limit(0), pairs.limit(2), counts).first()) == (None,) * 5 + (0,)
