"""Properties: splits, sampling, negatives, search paths, judged-first evaluation, ingest rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rankforge.functions import vectors as V
from rankforge.operators import bm25, clean, profile, ranking, sampling, search, towers
from rankforge.plans import lexical
from rankforge.session import scratch_path
from rankforge.sources import fixtures as fx
from rankforge.sources import io


def test_splits_disjoint_complete_and_partition_independent(spark):
    c = fx.collection(spark, SF_SMALL).select("id")
    a = sampling.split_by_key(c, "id", 0.05, 119)
    b = sampling.split_by_key(c.repartition(7), "id", 0.05, 119)
    ra = {r["id"]: r["split"] for r in a.collect()}
    rb = {r["id"]: r["split"] for r in b.collect()}
    assert ra == rb and len(ra) == c.count()
    s1 = [r["id"] for r in sampling.sample_n(c, "id", 10, 119).collect()]
    s2 = [r["id"] for r in sampling.sample_n(c.repartition(5), "id", 10, 119).collect()]
    assert s1 == s2 and len(set(s1)) == 10


def test_negatives_never_equal_positive(spark):
    g = fx.generated(spark, SF_SMALL).select("id")
    d = g.withColumn("_s", F.col("id").cast("string"))
    neg = sampling.negative_ids(g, "id", d, "id", "_s")
    assert neg.filter(F.col("neg_id") == F.col("id")).count() == 0
    assert neg.count() == g.count()


def test_normalised_vectors_have_unit_norm(spark):
    p = fx.vec_products(spark, SF_SMALL)
    norms = [r[0] for r in p.select(V.norm(V.l2_normalize("product_embedding"))).collect()]
    assert np.allclose(norms, 1.0)


def test_batch_topk_equals_numpy_full_sort(spark):
    q, p = fx.vec_queries(spark, SF_SMALL), fx.vec_products(spark, SF_SMALL)
    small = search.brute_force_topk(q, p.repartition(3), 7, "dot", query_block=2, candidate_block=5).collect()
    got = search.brute_force_topk(q, p.repartition(3), 7, "dot").collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))
    Q = {r["qid"]: np.array(r["query_embedding"]) for r in q.collect()}
    P = {r["id"]: np.array(r["product_embedding"]) for r in p.collect()}
    for qid, qv in Q.items():
        full = sorted(P, key=lambda i: (-round(float(qv @ P[i]), 9), i))[:7]
        mine = [r["id"] for r in sorted([r for r in got if r["qid"] == qid], key=lambda r: r["rank"])]
        assert mine == full


def test_judged_first_equals_full_ranking(spark):
    """Scoring only judged pairs gives the same metrics as ranking the whole collection first."""
    coll = clean.clean_collection(fx.collection(spark, SF_SMALL))
    queries, qrels = fx.queries(spark, SF_SMALL), fx.qrels(spark, SF_SMALL)
    idx = bm25.build_index(coll)
    judged_first = ranking.macro_mean(lexical.evaluate_bm25(queries, qrels, coll, index=idx, per_query=True)).first()
    q, judged = lexical.eval_inputs(queries, qrels, coll)
    evalq = q.filter(F.col("text").isNotNull())
    full = bm25.score_matches(idx, bm25.query_terms(idx, evalq))          # every matching doc
    all_pairs = evalq.select("qid").join(coll.select("id"), how="cross")  # small fixture only
    ranked = all_pairs.join(full, ["qid", "id"], "left").select(
        "qid", F.col("id").alias("docid"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    scored = ranked.join(judged, ["qid", "docid"])
    other = ranking.macro_mean(ranking.per_query_metrics(evalq, scored, 5, 10)).first()
    for k in ("ndcg", "precision", "recall", "n_queries"):
        assert judged_first[k] == pytest.approx(other[k])


def test_distributed_rank_equals_window_rank(spark):
    rows = [(q, d, float((d * 7919) % 13), 0) for q in (1, 2, 3) for d in range(300 if q == 1 else 20)]
    df = spark.createDataFrame(rows, "qid long, docid long, score double, relevance_score int").repartition(5)
    a = {(r["qid"], r["docid"]): r["rank"] for r in ranking.rank_within(df, "score").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = {(r["qid"], r["docid"]): r["rank"] for r in ranking.rank_distributed(df, "score").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_distributed_rank_keeps_extra_columns_of_many_rows(spark):
    df = spark.range(1_000_000).select(F.lit(1).cast("long").alias("qid"), F.col("id").alias("docid"),
                                       F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("score"),
                                       F.concat(F.lit("text "), "id").alias("text")).repartition(11)
    r = ranking.rank_distributed(df, "score")
    assert r.count() == 1_000_000
    got = r.groupBy().agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"),
                          F.count_if(F.col("text") != F.concat(F.lit("text "), "docid")).alias("bad")).first()
    assert (got["n"], got["a"], got["b"], got["bad"]) == (1_000_000, 1, 1_000_000, 0)
    top = [x["docid"] for x in df.orderBy(F.desc("score"), "docid").limit(50).collect()]
    assert [x["docid"] for x in r.filter("rank <= 50").orderBy("rank").collect()] == top


def test_one_record_per_query_with_many_passages(spark):
    flat = spark.range(2500).select(F.lit(7).cast("long").alias("query_id"), F.lit("q").alias("query"), F.lit("positive").alias("kind"),
                                    F.lit(0).alias("pos"), F.col("id").alias("docid"), F.lit("t").alias("text"))
    path = scratch_path(spark, "triples-large")
    io.write_triples(flat, path)
    assert spark.read.json(path).count() == 1
    assert [(r["pos"], r["docid"]) for r in io.read_triples(spark, path).orderBy("docid").collect()] == [(i, i) for i in range(2500)]


def test_histogram_of_a_constant_column(spark):
    rows = profile.histogram(spark.range(9).select(F.lit(4).alias("x")), "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [9, 0, 0, 0, 0]


def test_pair_ids_do_not_collide(spark, tmp_path):
    spark.createDataFrame([(1, 1000, "user", "a"), (1, 1001, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d")],
                          "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from rankforge.sources import fixtures

    assert sorted(tuple(r) for r in fixtures.text_pairs(spark, str(tmp_path)).collect()) == [("1:1000", "a", "b"), ("2:0", "c", "d")]


def test_search_returns_n_rows_when_few_match(spark):
    docs = spark.createDataFrame([(3, "red shoe"), (1, "blue hat"), (2, "green hat"), (9, "")], "id long, product_text string")
    qs = spark.createDataFrame([(1, "shoe"), (2, "nothing"), (3, None)], "qid long, text string")
    got = bm25.search(bm25.build_index(docs), qs, n=3).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"]) for r in got] == [(1, 3), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert [r["score"] == 0 for r in got] == [False, True, True, True, True, True]


def test_tsv_ingest_rules(spark):
    path = scratch_path(spark, "edge-tsv")
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/edge.tsv", "w") as f:
        f.write('1\tA "quoted" word\tdesc\n')
        f.write('2\t"x ""y""\tz"\tNA\n')
        f.write('3\tnull\t\n')
        f.write('4\tmulti\t"line1\nline2"\n')
    rows = {r["id"]: r for r in io.read_collection(spark, path).collect()}
    assert len(rows) == 4
    assert rows[1]["title"] == 'A "quoted" word'
    assert rows[2]["title"] == 'x "y"\tz' and rows[2]["description"] == "NA"
    assert rows[3]["title"] == "null" and rows[3]["description"] is None
    assert rows[4]["description"] == "line1\nline2"


def test_triples_round_trip(spark):
    flat = spark.createDataFrame([(1, "q", "positive", 0, 5, "t5"), (1, "q", "negative", 0, 6, "t6"),
                                  (2, "r", "positive", 0, 7, "t7")],
                                 "query_id long, query string, kind string, pos int, docid long, text string")
    path = scratch_path(spark, "triples")
    io.write_triples(flat, path)
    back = io.read_triples(spark, path).collect()
    assert sorted((r["query_id"], r["kind"], r["docid"]) for r in back) == [(1, "negative", 6), (1, "positive", 5), (2, "positive", 7)]


def test_dedupe_keeps_first_and_groups_nulls(spark):
    df = spark.createDataFrame([(3, None, "d"), (1, None, "d"), (2, "t", None), (4, "t", None), (5, "t", "d")],
                               "id long, title string, description string")
    ids = sorted(r["id"] for r in clean.dedupe_text(df).collect())
    assert ids == [1, 2, 5]


def test_tower_training_loss_falls_and_is_deterministic(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(64, 8))
    rows = [(i, i, base[i].tolist(), (base[i] + 0.05 * rng.normal(size=8)).tolist()) for i in range(64)]
    pairs = spark.createDataFrame(rows, "qid long, docid long, query_embedding array<double>, product_embedding array<double>")
    *_, h1 = towers.train_towers(pairs, layers=[16, 8], epochs=6, batch_size=16, lr=0.1, seed=3)
    *_, h2 = towers.train_towers(pairs, layers=[16, 8], epochs=6, batch_size=16, lr=0.1, seed=3)
    losses = [x[1] for x in h1]
    assert losses[-1] < losses[0]
    assert np.allclose(losses, [x[1] for x in h2], rtol=1e-9)


def _plain_training(rows, batch_of, n_batches, layers, epochs, per_step, optimizer, seed, lr=0.1):
    """The same training in one process: whole batches, one after another."""
    from rankforge.operators.towers import OPTIMIZERS, batch_loss_grad, init_params

    dim = len(rows[0][2])
    theta = np.concatenate([init_params(dim, layers, seed), init_params(dim, layers, seed + 1)])
    nq, steps = len(theta) // 2, math.ceil(n_batches / per_step)
    opt = OPTIMIZERS[optimizer](lr, 0.1, epochs * steps)
    state, losses = opt.start(len(theta)), []
    for _ in range(epochs):
        total = 0.0
        for k in range(steps):
            g = np.zeros(len(theta))
            for b in range(k * per_step, (k + 1) * per_step):
                own = sorted(r for r in rows if batch_of[r[0], r[1]] == b)
                if own:
                    x, d = batch_loss_grad(theta[:nq], theta[nq:], np.array([r[2] for r in own]), np.array([r[3] for r in own]), dim, dim, layers)
                    g, total = g + d, total + x
            theta, state = opt.step(theta, g, state)
        losses.append(total)
    return theta, losses


def test_barrier_training_equals_a_plain_loop_and_validates(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(90, 6))
    rows = [(i, 1000 + i % 80, base[i].tolist(), (base[i % 80] + 0.05 * rng.normal(size=6)).tolist()) for i in range(90)]
    schema = "qid long, docid long, query_embedding array<double>, product_embedding array<double>"
    pairs, val = spark.createDataFrame(rows[:70], schema), spark.createDataFrame(rows[70:], schema)
    cands = spark.createDataFrame([(1000 + i, rows[i][3]) for i in range(80)], "id long, product_embedding array<double>")
    n_batches = 5
    dealt = pairs.select("qid", "docid", towers._batch_of(3, n_batches).alias("b")).collect()
    batch_of = {(r.qid, r.docid): r.b for r in dealt}
    for per_step, optimizer in ((1, "adagrad"), (2, "adam")):
        tq, tp, in_q, in_p, layers, h = towers.train_towers(pairs, layers=[7, 5], epochs=3, batch_size=14, seed=3, batches_per_step=per_step, optimizer=optimizer,
                                                           validation=val, candidates=cands)
        theta, losses = _plain_training(rows[:70], batch_of, n_batches, [7, 5], 3, per_step, optimizer, 3)
        assert np.allclose(np.concatenate([tq, tp]), theta, rtol=1e-9, atol=1e-12) and np.allclose([x[1] for x in h], losses, rtol=1e-9)
        assert [x[2] for x in h] == [70] * 3 and len(h[0]) == 9
        # the last epoch's validation, by hand
        query, product = towers.unpack(tq, in_q, layers)[0], towers.unpack(tp, in_p, layers)[0]
        q, own = (towers.forward(t, np.array([r[c] for r in rows[70:]]))[0] for t, c in ((query, 2), (product, 3)))
        c = towers.forward(product, np.array([rows[i][3] for i in range(80)]))[0]
        s, limit = np.round(q @ c.T, 9), np.round((q * own).sum(1), 9)
        better = ((s > limit[:, None]) & (1000 + np.arange(80)[None, :] != np.array([r[1] for r in rows[70:]])[:, None])).sum(1)
        assert [round(x, 9) for x in h[-1][4:]] == [round(float((better < k).mean()), 9) for k in towers.KS]
        b = spark.createDataFrame(rows[70:], schema).select("qid", towers._batch_of(3, 2).alias("b")).collect()
        groups = [sorted(r for r in rows[70:] if r[0] in {x.qid for x in b if x.b == k}) for k in (0, 1)]
        want = sum(towers.batch_loss_grad(tq, tp, np.array([r[2] for r in g]), np.array([r[3] for r in g]), 6, 6, layers)[0] for g in groups if g)
        assert h[-1][3] == pytest.approx(want)


def test_quantiles_equal_percentile(spark, monkeypatch):
    rng = np.random.default_rng(2)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
    for limit in (100_000, 30):  # read at once, and narrowed again and again
        monkeypatch.setattr(profile, "BRACKET", limit)
        monkeypatch.setattr(profile, "RANK_PARTS", 50 if limit == 30 else 10_000)
        for values in (rng.normal(size=3001), np.round(rng.exponential(size=2000), 1), np.repeat([1.0, 5.0, 5.0, 9.0], 400), np.array([3.0])):
            df = spark.createDataFrame([(float(x),) for x in values] + [(None,)] * 5, "x double").repartition(7)
            want = df.agg(*[F.percentile("x", p) for p in probs]).first()
            assert np.allclose(profile.exact_quantiles(df, "x", probs), list(want), rtol=1e-12)
    assert profile.exact_quantiles(df.filter("x is null"), "x", (0.5,)) == [None]


def test_last_text_wins(spark):
    from rankforge.operators import pairs, synth

    q = spark.createDataFrame([(1, "zz", 1), (1, "a", 3), (1, "m", 2), (2, None, 2), (2, "b", 1), (3, "c", 1)], "qid long, text string, at int")
    r = spark.createDataFrame([(1, 10, 1), (2, 11, 0), (9, 12, 1)], "qid long, docid long, relevance_score int")
    assert sorted(map(tuple, pairs.dev_judgements(q, r, "at").collect())) == [(1, "a", 10, 1), (2, None, 11, 0)]
    assert sorted(map(tuple, pairs.dev_judgements(q.coalesce(1), r).collect())) == [(1, "m", 10, 1), (2, "b", 11, 0)]
    g = spark.createDataFrame([(1, "t", ["x"]), (5, "t", ["y", "z"]), (2, "u", []), (3, None, ["n"])], "id long, product_text string, queries array<string>")
    assert sorted((x.id, x.queries) for x in synth.queries_by_text(g).collect()) == [(2, []), (3, ["n"]), (5, ["y", "z"])]
    assert sorted(x.id for x in pairs.candidate_ids(r, g.select("id").unionByName(g.select("id"))).collect()) == [1, 2, 3, 5]
    assert sorted(x.id for x in pairs.candidate_ids(r.unionByName(r)).collect()) == [10, 11, 12]


def test_ragged_log(spark, tmp_path):
    import json

    from rankforge.operators import runs

    log = [{"step": 1, "epoch": 0.5, "loss": 2.0, "grad_norm": 1.0}, {"step": 1, "epoch": 1.0, "eval_loss": 1.5, "eval_runtime": 3},
           {"step": 2, "epoch": 1.5, "loss": None}, {"initial": True, "elapsed_time": 0.0, "memory_usage_mb": 10}, {"train_runtime": 9.0},
           {"step": 10, "epoch": 1, "elapsed_time": 4.0, "memory_usage_mb": 30, "cpu_usage_percent": 50.0},
           {"step": 20, "epoch": 2, "elapsed_time": 9.0, "memory_usage_mb": 20}]
    for name, text in (("array", json.dumps(log, indent=1)), ("lines", "\n".join(map(json.dumps, log)))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "log.json").write_text(text)
        entries = runs.read_entries(spark, str(tmp_path / name))
        assert sorted((r.kind, r.step, r.epoch, r.loss, r.grad_norm, r.eval_loss, r.eval_runtime) for r in runs.log_series(entries).collect() if r.loss or r.eval_loss) == \
            [("eval", 1, 1.0, None, None, 1.5, 3.0), ("train", 1, 0.5, 2.0, 1.0, None, None)]
        assert [(r.step, r.loss) for r in runs.log_series(entries).filter("epoch = 1.5").collect()] == [(2, None)]  # the key is there, its value is null
        per = runs.resources_per_epoch(runs.resource_series(entries)).orderBy(F.asc_nulls_first("epoch")).collect()
        assert [(r.epoch, r.n_entries, r.last_elapsed, r.seconds, r.max_memory_mb, r.peak_memory_mb, r.avg_cpu) for r in per] == \
            [(None, 1, 0.0, 0.0, 10.0, 10.0, None), (1.0, 1, 4.0, 4.0, 30.0, 30.0, 50.0), (2.0, 1, 9.0, 5.0, 20.0, 30.0, None)]


def test_all_vectors_are_embedded(spark):
    from rankforge.plans import q_towers

    got = q_towers.q_embed_candidates(spark, SF_SMALL)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in fx.vectors(spark, SF_SMALL).collect())
