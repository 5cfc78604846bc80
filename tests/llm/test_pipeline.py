"""The pipeline's decisions against plain versions of its stages, stage by stage."""

import re

import corpus_pipeline
from rankforge.llm import decontaminate, secrets
from rankforge.llm.common import prepare

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        was = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        state[name] = (was, docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    was, now = state["quality"]
    kept = {r.doc_id for r in now.collect()}
    right = [(i in kept) == bool(q) for i, q in quality.items() if i in was]
    assert sum(right) / len(right) > 0.95
    was, now = state["near_duplicates"]
    sets = {}
    for i, r in was.items():
        w = WORD.findall((r.text or "").lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    kept = {r.doc_id for r in now.collect()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(any(near(a, b) for b in sets if b < a) for a in set(sets) - kept)
    was, now = state["decontamination"]
    kept = {r.doc_id for r in now.collect()}
    assert not any(t in decontaminate.normal(was[i].text) for i in kept for t in items)
    assert all(any(t in decontaminate.normal(was[i].text) for t in items) for i in set(was) - kept)
    was, now = state["secrets"]
    rows = {r.doc_id: r for r in now.collect()}
    assert set(rows) == set(was)
    assert all((r.text == was[i].text) == (not secrets.scan(was[i].text)) and r.n_chars == len(r.text) for i, r in rows.items())
    was, now = state["packing"]
    assert {r.doc_id for r in now.collect()} == set(was)


def test_oracles(spark):
    import duckdb

    from rankforge.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SF)
        want = con.execute(sql)
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.fetchall())


def test_near_duplicate_stage_compares_five_words(spark):
    prepare(spark)
    words = [f"w{i}" for i in range(200)]
    few, some = list(words), list(words)
    few[50] = "zz"
    for i in range(10, 190, 18):  # near on two words, not on five
        some[i] = f"zz{i}"
    docs = spark.createDataFrame([(i, " ".join(x), "en", "s", 1) for i, x in enumerate((words, few, some))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 2]
