"""Exact vector search over a persisted partition of the candidates into balls.

*Index.* Candidates go to the nearest of a bounded number of pivots; cells are cut by a hash to groups of bounded size, and each group is split at its far
ends until a ball holds at most ``BALL_ROWS`` vectors. A ball is one row: centre, covering radius, ids and vectors. The table can be written and read again.

*Search.* By the triangle inequality no vector of a ball scores better than its centre's score and radius allow. Every query first reads the balls
whose bounds are best, until they hold k vectors; the k-th score found there is its limit. Then it reads only the balls whose
bounds reach the limit. All scores are exact, ties go by id, and how many balls were read can be counted.

Only bounds are computed for all (query, ball) pairs, in blocks; vectors move for the pairs that are read."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .search import _dealt, _scores

#: Vectors of a ball and of a group that is split in one task; pivots at most (a bounded sample of the vectors, drawn by a hash of the id).
BALL_ROWS, GROUP_ROWS, PIVOTS = 256, 20_000, 1024
#: Queries, and heads of balls, of one block; queries that one ball meets at once.
QUERY_BLOCK, HEAD_BLOCK, MEET = 2048, 8192, 4096
#: What rounding may cost a bound, in parts of its size.
SLACK = 1e-8

_BALL = "center array<double>, radius double, n long, ids binary, vectors binary"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def split_balls(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Positions of ``x`` in sets of ``rows`` at most: each larger set is split between two far points of it."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        p = x[at]
        a = p[np.argmax(((p - p.mean(0)) ** 2).sum(1))]
        da = ((p - a) ** 2).sum(1)
        b = p[np.argmax(da)]
        left = da <= ((p - b) ** 2).sum(1)
        if left.all():  # all are equal
            left = np.arange(len(at)) < len(at) // 2
        todo += [at[left], at[~left]]
    return out


@dataclass
class BallIndex:
    """Balls ``(ball, center, radius, n, ids, vectors)`` and the metric they are searched by: ``dot``, ``cosine`` (unit vectors are kept) or ``l2``."""
    balls: DataFrame
    metric: str

    @classmethod
    def build(cls, candidates: DataFrame, metric: str = "dot", c_id: str = "id", c_vec: str = "product_embedding") -> BallIndex:
        """Candidates without an id or a vector take no part; rows that repeat an id are candidates of their own."""
        unit = metric == "cosine"
        c = candidates.select(F.col(c_id).cast("long").alias("id"), F.col(c_vec).cast("array<double>").alias("v")).filter("id is not null and v is not null")
        c = materialize(c, "candidates")
        n = c.count()
        wanted = min(PIVOTS, math.ceil(n / GROUP_ROWS))
        pivots = _stack([r["v"] for r in c.orderBy(F.xxhash64("id"), "id").limit(max(1, wanted)).collect()])
        pivots = _unit(pivots) if unit and len(pivots) else pivots

        def assign(batches):
            for b in batches:
                x = _stack(b["v"])
                x = _unit(x) if unit else x
                cell = np.argmin((pivots ** 2).sum(1)[None, :] - 2 * (x @ pivots.T), 1) if len(x) else np.zeros(0, np.int64)
                yield b.assign(cell=cell)

        dealt = materialize(c.mapInPandas(assign, "id long, v array<double>, cell long"), "cells")
        groups = dealt.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))  # a row per pivot
        dealt = dealt.join(F.broadcast(groups), "cell").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))

        def split(part: pd.DataFrame) -> pd.DataFrame:
            x, ids = _stack(part["v"]), part["id"].to_numpy(np.int64)
            x = _unit(x) if unit else x
            out = []
            for at in split_balls(x, BALL_ROWS):
                center = x[at].mean(0)
                out.append((center, float(np.sqrt(((x[at] - center) ** 2).sum(1).max())), len(at), ids[at].tobytes(), x[at].tobytes()))
            return pd.DataFrame(out, columns=["center", "radius", "n", "ids", "vectors"])

        balls = dealt.groupBy("cell", "part").applyInPandas(split, _BALL).withColumn("ball", F.monotonically_increasing_id())
        return cls(materialize(balls, "balls"), metric)

    def write(self, path: str) -> None:
        self.balls.withColumn("metric", F.lit(self.metric)).write.parquet(path)

    @classmethod
    def read(cls, spark, path: str) -> BallIndex:
        df = spark.read.parquet(path)
        row = df.select("metric").first()
        return cls(df.drop("metric"), row["metric"] if row else "dot")

    def _queries(self, queries: DataFrame, q_id: str, q_vec: str) -> DataFrame:
        return queries.select(F.col(q_id).cast("long").alias("qid"), F.col(q_vec).cast("array<double>").alias("q")).filter("qid is not null and q is not null")

    def _bounds(self, queries: DataFrame, pick, schema: str) -> DataFrame:
        """``pick(rows, ids, least, most, n)`` for every block of queries and heads; least and most: what the cost (lower is better) of a ball's
        vectors can be."""
        metric = self.metric

        def bounds(q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
            names = [f.split()[0] for f in schema.split(", ")]
            if not len(q) or not len(h):
                return pd.DataFrame({c: [] for c in names})
            x, c, r = _stack(q["q"]), _stack(h["center"]), h["radius"].to_numpy(np.float64)[None, :]
            if metric == "l2":
                mid = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0))
                room = r
            else:
                x = _unit(x) if metric == "cosine" else x
                mid, room = -(x @ c.T), r * np.linalg.norm(x, axis=1)[:, None]
            slack = SLACK * (1 + np.abs(mid) + room + np.linalg.norm(x, axis=1)[:, None])
            rows = pick(q, h["ball"].to_numpy(np.int64), mid - room - slack, mid + room + slack, h["n"].to_numpy(np.int64))
            return pd.concat(rows) if rows else pd.DataFrame({c: [] for c in names})

        heads = self.balls.select("ball", "center", "radius", "n")
        a, b = _dealt(queries, ("qid",), heads, "ball", QUERY_BLOCK, HEAD_BLOCK)
        return a.cogroup(b).applyInPandas(bounds, schema)

    def _first(self, queries: DataFrame, k: int) -> DataFrame:
        """Per query the balls with the best bounds, as many as hold k vectors."""
        def pick(q, ball, least, most, n):
            out = []
            for i, qid in enumerate(q["qid"]):
                order = np.argsort(least[i], kind="stable")
                order = order[:int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
                out.append(pd.DataFrame({"qid": qid, "ball": ball[order], "least": least[i][order], "n": n[order]}))
            return out

        own = Window.partitionBy("qid").orderBy("least", "ball")
        near = self._bounds(queries, pick, "qid long, ball long, least double, n long")
        before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return near.withColumn("before", before).filter(F.col("before") < k).select("qid", "ball")

    def _read(self, pairs: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
        """The best k of each pair's ball, exactly: ``(qid, id, score)``."""
        metric, up = self.metric, self.metric == "l2"
        chunks = max(1, math.ceil(queries.count() / MEET))

        def meet(key, t: pa.Table, p: pa.Table) -> pa.Table:
            out_q, out_i, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if p.num_rows:
                for ids, raw in zip(t.column("ids").to_pylist(), t.column("vectors").to_pylist(), strict=True):
                    ids = np.frombuffer(ids, np.int64)
                    s = np.round(_scores(_stack(p.column("q").to_pylist()), np.frombuffer(raw, np.float64).reshape(len(ids), -1), metric), digits)
                    for i, qid in enumerate(p.column("qid").to_pylist()):
                        best = np.lexsort((ids, s[i] if up else -s[i]))[:k]
                        out_q.append(np.full(len(best), qid, np.int64))
                        out_i.append(ids[best])
                        out_s.append(s[i][best])
            return pa.table({"qid": np.concatenate(out_q), "id": np.concatenate(out_i), "score": np.concatenate(out_s)})

        asked = pairs.join(queries, "qid").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)))
        held = self.balls.select("ball", "ids", "vectors").join(pairs.select("ball").distinct(), "ball", "left_semi") \
            .withColumn("chunk", F.explode(F.expr(f"sequence(0L, {chunks - 1}L)")))
        return held.groupBy("ball", "chunk").cogroup(asked.groupBy("ball", "chunk")).applyInArrow(meet, "qid long, id long, score double")

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        o = F.col("score").asc() if self.metric == "l2" else F.col("score").desc()
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(o, "id"))).filter(F.col("rank") <= k)

    def _rounds(self, queries: DataFrame, k: int, digits: int, q_id: str, q_vec: str):
        q = materialize(self._queries(queries, q_id, q_vec), "queries")
        first = materialize(self._first(q, k), "first-balls")
        seen = materialize(self._ranked(self._read(first, q, k, digits), k), "first-found")
        sign = 1.0 if self.metric == "l2" else -1.0
        limit = seen.filter(F.col("rank") == k).select("qid", (F.col("score") * sign).alias("limit"))

        def pick(p, ball, least, most, n):
            # the limit is a rounded score
            reach = least <= p["limit"].to_numpy(np.float64)[:, None] + 10.0 ** -digits
            i, j = np.nonzero(reach)
            return [pd.DataFrame({"qid": p["qid"].to_numpy(np.int64)[i], "ball": ball[j]})]

        limited = q.join(limit, "qid", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        more = self._bounds(limited, pick, "qid long, ball long").join(first, ["qid", "ball"], "left_anti")
        return q, first, seen, materialize(more, "further-balls")

    def search(self, queries: DataFrame, k: int = 10, q_id: str = "qid", q_vec: str = "query_embedding", digits: int = 9) -> DataFrame:
        """Exact top-k per query: ``(qid, id, rank, score)``, best first, ties by id; scores are rounded to ``digits`` before ranking. Query ids are unique."""
        q, _, seen, more = self._rounds(queries, k, digits, q_id, q_vec)
        return self._ranked(seen.select("qid", "id", "score").unionByName(self._read(more, q, k, digits)), k).select("qid", "id", "rank", "score")

    def visits(self, queries: DataFrame, k: int = 10, q_id: str = "qid", q_vec: str = "query_embedding", digits: int = 9) -> DataFrame:
        """One row: queries, balls, and how many (query, ball) pairs a search reads."""
        q, first, _, more = self._rounds(queries, k, digits, q_id, q_vec)
        n = first.select("qid", "ball").unionByName(more).agg(F.count("*").alias("n_read"))
        return n.select(F.lit(q.count()).cast("long").alias("n_queries"), F.lit(self.balls.count()).cast("long").alias("n_balls"), "n_read")
