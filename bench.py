"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print ONE JSON line.

Each query is executed fully with the ``noop`` sink (no collect to the driver). A short warm-up
on the smallest fixture runs first and is not timed (JVM start / code generation).
Set BENCH_QUERIES=q1,q2 to choose queries, BENCH_ALL=1 to time every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "eval_bm25", "bm25_search", "bm25_grid_tune", "clean_collection", "build_pairs",
    "tfidf_pair_cosine", "brute_force_topk", "topk_accuracy", "eval_embeddings", "eval_encoder",
    "rouge_n", "bleu", "negative_pairs", "generate_queries", "train_towers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    os.environ.setdefault("BENCH_CPUS", "8")
    from rankforge.plans.registry import load_all
    from rankforge.session import get_spark

    # local mode: two shuffle partitions per core (AQE coalesces further); clusters set their own
    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(os.environ["BENCH_CPUS"]) * 2))
    spark = get_spark(shuffle_partitions=shuffle)
    queries, _ = load_all()
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else (list(queries) if os.environ.get("BENCH_ALL") else HEADLINE)

    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        queries["eval_bm25"](spark, warm).write.format("noop").mode("overwrite").save()

    times, rows = {}, {}
    for name in names:
        t0 = time.time()
        df = queries[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    n_products = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = {"metric": "total_wall_clock", "value": total, "unit": "sec", "queries": times,
           "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if "generate_queries" in times:
        out["generate_queries_products_per_sec"] = round(n_products / max(times["generate_queries"], 1e-9), 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
