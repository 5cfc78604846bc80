"""Mined negatives against brute force over many blocks, the trees' invariants and pruning, and odd inputs."""

import math

import numpy as np
import pytest

from rankforge.llm import hard_negatives as hn
from rankforge.llm.common import prepare

SCHEMA = "vec_id long, embedding array<double>, label int, v string, rid long"


def vectors(n, dim=8, seed=0, labels=4):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, dim))
    out = []
    for i in range(n):
        x = centers[r.integers(0, 12)] + r.normal(size=dim) * 0.3
        out.append((i, [float(c) for c in x], int(r.integers(0, labels))))
    return out


def plain(rows, every=100, positives=5, negatives=5):
    """``rows``: (id, vector, label)."""
    use = [(i, [math.floor(256 * c) for c in x], lab) for i, x, lab in rows
           if i is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for k, (i, x, lab) in enumerate(use):
        if i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), j, m) for m, (j, y, _) in enumerate(use) if m != k)
        for t, j, _ in [z for z in s if use[z[2]][2] == lab][:positives]:
            hits = [(u, w) for u, w, m in s if use[m][2] != lab and 80 * -t <= 100 * -u <= 100 * -t][:negatives]
            out += [(i, j, rank, w, -t, -u) for rank, (u, w) in enumerate(hits, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    prepare(spark)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hn.hard_negatives(hn.quantised(df).select("vec_id", "label", "v"), **kw).collect()))


@pytest.fixture(scope="module")
def rows():
    out = vectors(900)
    out += [(1000 + k, out[3][1], k % 2) for k in range(80)]  # one vector very often
    out += [(2000, None, 1), (2100, [1.0, None] + [0.0] * 6, 1), (2200, [math.nan] * 8, 1), (2300, [math.inf] + [0.0] * 7, 1), (2400, [1.0] * 8, None), (None, [9.0] * 8, 1)]
    return out + [(2500, [], 1), (2600, [0.5, -0.25], 2), (2700, [0.0] * 8, 3)]


def test_equals_brute_force(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_many_blocks_chunks_and_levels(spark, rows, monkeypatch):
    for name, n in (("BLOCK_ROWS", 150), ("CHUNK", 3), ("LEAF", 3)):
        monkeypatch.setattr(hn, name, n)
    got = run(spark, rows, every=40)
    assert got == plain(rows, 40) and len(got) > 300


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    # repeated ids are rows of their own; a negative positive score has no window, zero only itself
    few = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.0], 2), (3, [0.0, 1.0], 1), (4, [0.0, 2.0], 2), (100, [-1.0, 0.0], 1)]
    assert run(spark, few) == plain(few)
    big = [(i, [float(x) * 1e5 for x in v], lab) for i, v, lab in vectors(120, 4, 5)]
    assert run(spark, big, every=20) == plain(big, 20)


def test_tree():
    rows = vectors(1500, 6, 2, 2)
    x, lab = np.array([r[1] for r in rows]) * 256, np.array([r[2] for r in rows])
    x = np.concatenate([x, np.repeat(x[:1], 200, 0)])
    lab = np.concatenate([lab, np.zeros(200, int)])
    t = hn.CoverTree(x, lab)
    a = t.arrays()
    assert sorted(t.perm.tolist()) == list(range(len(x))) and t.roots == 2
    for k in range(len(t.nodes)):
        at = t.perm[a["start"][k]:a["stop"][k]]
        assert (lab[at] == a["label"][k]).all()
        assert np.sqrt(((x[at] - x[a["center"][k]]) ** 2).sum(1)).max() <= a["radius"][k] + 1e-9
        if a["n_child"][k]:
            c = slice(a["child"][k], a["child"][k] + a["n_child"][k])
            assert a["start"][c][0] == a["start"][k] and a["stop"][c][-1] == a["stop"][k] and (a["start"][c][1:] == a["stop"][c][:-1]).all()
            assert a["radius"][c].max() <= a["radius"][k] / hn.BASE + 1e-9
    assert sum(n[4] > 0 for n in t.nodes) > 5


def test_descent_skips_nodes():
    r = np.random.default_rng(9)
    centers = r.normal(size=(30, 5)) * 4
    v = np.floor(256 * (centers[r.integers(0, 30, 3000)] + r.normal(size=(3000, 5)) * 0.05)).astype(np.int64)
    lab = r.integers(0, 2, 3000)
    longest = np.sqrt((v.astype(float) ** 2).sum(1)).max()
    t = hn.CoverTree(np.concatenate([v, np.sqrt(np.maximum(longest ** 2 - (v.astype(float) ** 2).sum(1), 0))[:, None]], 1), lab)
    a = t.arrays()
    place = np.empty(3000, np.int64)
    place[t.perm] = np.arange(3000)
    a["center"] = place[a["center"]]
    leaves = int((a["n_child"] == 0).sum())
    s = hn.Searcher(v[t.perm].astype(float), t.perm, t.perm, a, t.roots, v[:20].astype(float), True)
    for k in range(20):
        want = sorted((-int(v[j] @ v[k]), int(j)) for j in np.flatnonzero(lab == lab[k]) if j != k)[:5]
        got = s.nearest(k, lab[k], k, 5)
        assert [(x, i) for x, i, _ in got] == want
        most = -want[0][0]
        ranked = sorted((-int(v[j] @ v[k]), int(j)) for j in np.flatnonzero(lab != lab[k]))
        assert [(x, i) for x, i, _ in s.windows(k, lab[k], [(most * 4 // 5, most)], 5)[0]] == [z for z in ranked if most * 4 // 5 <= -z[0] <= most][:5]
    assert s.opened < 20 * leaves / 4
