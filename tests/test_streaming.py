"""Streaming scoring gives the same top-n as the batch search."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from rankforge.operators import bm25, clean
from rankforge.session import scratch_path
from rankforge.sources import fixtures as fx
from rankforge.streaming import scoring


def test_stream_scoring_matches_batch(spark):
    coll = clean.clean_collection(fx.collection(spark, SF_SMALL))
    idx = bm25.build_index(coll)
    ipath = scratch_path(spark, "stream-index")
    bm25.save_index(idx, ipath)
    qdir = scratch_path(spark, "stream-queries")
    os.makedirs(qdir, exist_ok=True)
    rows = [r.asDict() for r in fx.queries(spark, SF_SMALL).collect()]
    for i in range(0, len(rows), 10):  # queries arrive as several files
        with open(f"{qdir}/part-{i:04d}.json", "w") as f:
            for r in rows[i:i + 10]:
                f.write(json.dumps(r) + "\n")
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    q = scoring.start_scoring(spark, ipath, qdir, out, ck)
    q.awaitTermination(300)
    got = scoring.top_n_from_contributions(spark, out, 5).select("qid", "id", "rank", "score")
    want = bm25.search(bm25.load_index(spark, ipath), fx.queries(spark, SF_SMALL), 5).select("qid", "id", "rank", "score")
    a = sorted((r["qid"], r["id"], r["rank"], round(r["score"], 6)) for r in got.collect())
    b = sorted((r["qid"], r["id"], r["rank"], round(r["score"], 6)) for r in want.collect())
    assert a == b and len(a) > 0
    assert got.filter(F.col("rank") > 5).count() == 0
