"""Hard negatives: cover trees over norm-augmented vectors, searched best first.

Vectors are quantised to integers, so scores are exact. A further coordinate lifts each vector to the length of the longest; it is zero
for an anchor, so inner products stay as they are, and a node whose points lie within ``radius`` of its centre
has scores within ``|anchor| * radius`` of the centre's score.

1. *Index.* Rows are dealt to blocks of bounded size by a hash. Each block holds a cover tree per label: the points of a node of covering radius r
   go to the nearest point of a greedy net of separation r / ``BASE``, level by level, down to leaves. Blocks are written once, a row each.
2. *Positives.* Every anchor meets every block; the node with the highest bound is opened first, leaves are scored exactly, and the descent ends when no
   bound reaches the k-th score. A window function merges the k best of the blocks.
3. *Negatives.* The positives' scores give each anchor its windows. Nodes whose bounds miss all windows, or cannot reach a
   window's k-th score, are skipped; leaves are scored exactly.

Blocks grow in number with the table and anchors are sent to them in chunks; nothing is collected or broadcast."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block, anchors that a block meets at once, points of a leaf, and the ratio of neighbouring covering radii.
BLOCK_ROWS, CHUNK, LEAF, BASE = 4096, 2048, 32, 1.4
#: Share of a bound's size that rounding may cost.
SLACK = 1e-9


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part, v = floor(scale * x) as array<bigint>: no NULL id, label or vector, no NULL or non-finite component."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).filter(~bad) \
        .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


class CoverTree:
    """A forest over points with one tree per label. Nodes stand in arrays, children side by side; the points of a node are a run."""

    FIELDS = ("center", "radius", "label", "child", "n_child", "start", "stop")

    def __init__(self, lifted: np.ndarray, labels: np.ndarray):
        self.x = lifted
        self.order: list[np.ndarray] = []
        self.nodes: list[list] = []
        self.placed = 0
        roots = [(int(lab), np.flatnonzero(labels == lab)) for lab in np.unique(labels)]
        for lab, at in roots:
            self.nodes.append([at[0], 0.0, lab, 0, 0, 0, 0])
        self.roots = len(roots)
        for k, (_, at) in enumerate(roots):
            self._fill(k, at)
        self.perm = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)

    def _fill(self, root: int, points: np.ndarray) -> None:
        todo = [(root, points)]
        while todo:  # depth first, so that a subtree's points are one run
            k, at = todo.pop()
            if at is None:
                self.nodes[k][6] = self.placed
                continue
            node = self.nodes[k]
            node[5] = self.placed
            far = self._distance(at, node[0])
            node[1] = float(far.max())
            parts = self._net(at, far, node[1]) if len(at) > LEAF and node[1] > 0 else []
            if not parts:
                self.order.append(at)
                self.placed += len(at)
                node[6] = self.placed
                continue
            node[3], node[4] = len(self.nodes), len(parts)
            self.nodes += [[p[0], 0.0, node[2], 0, 0, 0, 0] for p in parts]
            todo.append((k, None))
            todo += [(node[3] + j, parts[j]) for j in reversed(range(len(parts)))]

    def _distance(self, at: np.ndarray, center: int) -> np.ndarray:
        d = self.x[at] - self.x[center]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _net(self, at: np.ndarray, far: np.ndarray, radius: float) -> list[np.ndarray]:
        """Points by the nearest member of a greedy net of separation ``radius / BASE``, the node's own centre first in it."""
        near, owner, n = far.copy(), np.zeros(len(at), np.int64), 1
        chosen = [int(np.argmin(far))]
        while True:
            k = int(np.argmax(near))
            if near[k] <= radius / BASE:
                break
            if n > len(at) // 4:
                return []  # hardly two points of it are near each other: a leaf
            d = self._distance(at, at[k])
            closer = d < near
            near[closer], owner[closer] = d[closer], n
            chosen.append(k)
            n += 1
        out = []
        for j, c in enumerate(chosen):
            mine = np.flatnonzero(owner == j)
            mine = np.concatenate([[c], mine[mine != c]])  # the centre stands first
            out.append(at[mine])
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        cols = list(zip(*self.nodes, strict=True)) or [()] * 7
        return {f: np.array(c, np.float64 if f == "radius" else np.int64) for f, c in zip(self.FIELDS, cols, strict=True)}


class Searcher:
    """Best-first descents of one block for a slice of anchors; ``q``: their vectors."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, rids: np.ndarray, tree: dict[str, np.ndarray], roots: int, q: np.ndarray, exact: bool):
        self.v, self.ids, self.rids, self.roots, self.exact = v, ids, rids, roots, exact
        self.child, self.n_child, self.start, self.stop, self.label = (tree[k].tolist() for k in ("child", "n_child", "start", "stop", "label"))
        at = q.astype(np.float64) @ v[tree["center"]].astype(np.float64).T if len(tree["center"]) else np.zeros((len(q), 0))
        size = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        room = size[:, None] * tree["radius"][None, :]
        slack = SLACK * (np.abs(at) + room + size[:, None] * np.sqrt((v.astype(np.float64) ** 2).sum(1).max(initial=0)) + 1)
        self.q, self.up, self.low = q, at + room + slack, at - room - slack
        self.opened = 0

    def scores(self, k: int, node: int) -> np.ndarray:
        self.opened += 1
        part = self.v[self.start[node]:self.stop[node]]
        if self.exact:  # sums below 2 ** 53: floating point is exact
            return (part @ self.q[k]).astype(np.int64)
        return np.array([sum(a * b for a, b in zip(r, self.q[k].tolist(), strict=True)) for r in part.tolist()], object)

    def _best(self, found: list, s: np.ndarray, lo: int, keep: np.ndarray, top: int) -> list:
        """``found`` (sorted ``(-score, id, rid)``) with the points of ``keep`` from ``lo`` on."""
        if len(keep) > top:  # ties at the border stay in
            border = np.sort(s[keep])[len(keep) - top]
            keep = keep[s[keep] >= border]
        at = keep + lo
        return sorted(found + list(zip((-s[keep]).tolist(), self.ids[at].tolist(), self.rids[at].tolist(), strict=True)))[:top]

    def nearest(self, k: int, label: int, rid: int, top: int) -> list[tuple[int, int, int]]:
        """The best ``top`` rows of a label, without the row ``rid``."""
        up, found = self.up[k], []
        heap = [(-up[r], r) for r in range(self.roots) if self.label[r] == label]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(found) == top and bound > found[-1][0]:
                break
            if self.n_child[node]:
                first = self.child[node]
                for c in range(first, first + self.n_child[node]):
                    if len(found) < top or -up[c] <= found[-1][0]:
                        heapq.heappush(heap, (-up[c], c))
                continue
            lo = self.start[node]
            s = self.scores(k, node)
            found = self._best(found, s, lo, np.flatnonzero(self.rids[lo:self.stop[node]] != rid), top)
        return found

    def windows(self, k: int, label: int, bounds: list[tuple[int, int]], top: int) -> list[list[tuple[int, int, int]]]:
        """Per window ``(least, most)`` the best ``top`` rows of other labels whose scores lie in it."""
        up, low = self.up[k], self.low[k]
        found: list[list] = [[] for _ in bounds]
        floor = [a for a, _ in bounds]
        most = max(b for _, b in bounds)

        def wanted(node: int) -> bool:
            u, w = up[node], low[node]
            return any(u >= f and w <= b for f, (_, b) in zip(floor, bounds, strict=True))

        heap = [(-min(up[r], most), r) for r in range(self.roots) if self.label[r] != label and wanted(r)]
        heapq.heapify(heap)
        while heap:
            _, node = heapq.heappop(heap)
            if not wanted(node):
                continue
            if self.n_child[node]:
                first = self.child[node]
                for c in range(first, first + self.n_child[node]):
                    if wanted(c):
                        heapq.heappush(heap, (-min(up[c], most), c))
                continue
            s = self.scores(k, node)
            for j, (_, b) in enumerate(bounds):
                keep = np.flatnonzero((s <= b) & (s >= floor[j]))
                if len(keep):
                    found[j] = self._best(found[j], s, self.start[node], keep, top)
                    if len(found[j]) == top:
                        floor[j] = -found[j][-1][0]
        return found


def build_index(rows: DataFrame, blocks: int, dim: int, longest: float) -> DataFrame:
    """A row per block: vectors, ids, row numbers and the tree of its rows ``(rid, vec_id, label, v)``. ``longest``: the greatest length of all vectors."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid")
        v = np.zeros((len(part), dim), np.int64)
        for k, x in enumerate(part["v"]):
            v[k, :len(x)] = x
        f = v.astype(np.float64)
        lift = np.sqrt(np.maximum(longest ** 2 - (f ** 2).sum(1), 0))
        tree = CoverTree(np.concatenate([f, lift[:, None]], 1), part["label"].to_numpy())
        a = tree.arrays()
        place = np.empty(len(part), np.int64)
        place[tree.perm] = np.arange(len(part))
        a["center"] = place[a["center"]]
        row = {"block": int(part["block"].iloc[0]), "n": len(part), "roots": tree.roots, "v": v[tree.perm].tobytes(),
               "ids": part["vec_id"].to_numpy(np.int64)[tree.perm].tobytes(), "rids": part["rid"].to_numpy(np.int64)[tree.perm].tobytes()}
        return pd.DataFrame([row | {k: x.tobytes() for k, x in a.items()}])
    fields = ", ".join(f"{k} binary" for k in ("v", "ids", "rids", *CoverTree.FIELDS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("long"))
    return materialize(dealt.groupBy("block").applyInPandas(build, f"block bigint, n bigint, roots bigint, {fields}"), "cover-trees")


def _opened(r: dict, dim: int, q: np.ndarray, exact: bool) -> Searcher:
    tree = {k: np.frombuffer(r[k], np.float64 if k == "radius" else np.int64) for k in CoverTree.FIELDS}
    v = np.frombuffer(r["v"], np.int64).reshape(-1, dim)
    return Searcher(v.astype(np.float64) if exact else v, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rids"], np.int64), tree, r["roots"],
                    q.astype(np.float64) if exact else q, exact)


def _slices(anchors: pd.DataFrame, dim: int, n: int = 256) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for lo in range(0, len(anchors), n):
        part = anchors.iloc[lo:lo + n]
        q = np.zeros((len(part), dim), np.int64)
        for k, x in enumerate(part["v"]):
            q[k, :len(x)] = x
        yield part, q


def _upto(n: int):
    """The numbers below ``n``, as long."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """Of ``rows(vec_id, label, v)`` (integers in v): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. A negative's score is at least ``share`` hundredths of its positive's score, and not above
    it; a negative positive score has no such rows. Ties go by the smaller id. Rows that repeat an id are rows of their own, each an anchor, a positive or a
    negative by itself (equal scores and ids go by a row number). Shorter vectors count as filled up with zeros; scores have to fit a long."""
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    own = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    n, dim, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.sqrt(own)), F.lit(0.0))).head()
    dim = max(1, dim)
    exact = longest ** 2 < 2 ** 52
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    index = build_index(rows, blocks, dim, longest * (1 + SLACK))
    anchor = rows.filter(F.col("vec_id") % every == 0)
    chunks = max(1, math.ceil(anchor.count() / CHUNK))
    chunk = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(chunks)).cast("long")
    at_chunks = index.withColumn("chunk", F.explode(_upto(chunks))).groupBy("block", "chunk")

    def met(anchors: DataFrame):
        """Anchors, once for every block."""
        return anchors.withColumn("chunk", chunk).withColumn("block", F.explode(_upto(blocks))).groupBy("block", "chunk")

    def found(trees: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in trees.to_dict("records"):
            for part, q in _slices(anchors, dim):
                s = _opened(r, dim, q, exact)
                for k, (rid, lab) in enumerate(zip(part["rid"], part["label"], strict=True)):
                    out += [(rid, -x, i, o) for x, i, o in s.nearest(k, lab, rid, positives)]
        return pd.DataFrame(out, columns=["rid", "score", "other", "other_rid"])

    near = at_chunks.cogroup(met(anchor.select("rid", "label", "v"))).applyInPandas(found, "rid bigint, score bigint, other bigint, other_rid bigint")
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "other", "other_rid")
    near = materialize(near.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= positives), "positives")
    wide = near.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "score"))).alias("w")).select("rid", F.col("w.score").alias("w"))

    def mined(trees: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in trees.to_dict("records"):
            for part, q in _slices(anchors, dim):
                s = _opened(r, dim, q, exact)
                for k, (rid, lab, w) in enumerate(zip(part["rid"], part["label"], part["w"], strict=True)):
                    bounds = [(-(-share * int(p) // 100), int(p)) for p in w]
                    real = [j for j, (a, b) in enumerate(bounds) if a <= b]
                    if real:
                        for j, hits in zip(real, s.windows(k, lab, [bounds[j] for j in real], negatives), strict=True):
                            out += [(rid, j + 1, -x, i, o) for x, i, o in hits]
        return pd.DataFrame(out, columns=["rid", "k", "score", "other", "other_rid"])

    neg = at_chunks.cogroup(met(anchor.select("rid", "label", "v").join(wide, "rid"))).applyInPandas(mined, "rid bigint, k int, score bigint, other bigint, other_rid bigint")
    best = Window.partitionBy("rid", "k").orderBy(F.desc("score"), "other", "other_rid")
    neg = neg.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    pos = near.select("rid", "k", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return neg.join(pos, ["rid", "k"]).join(anchor.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
