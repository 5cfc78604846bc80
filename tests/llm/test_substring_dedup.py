"""Repeated 13-word windows against a plain version, over many blocks and buckets, and on odd inputs."""

import hashlib
import random

import numpy as np
import pytest

from rankforge.llm import substring_dedup as sd
from rankforge.llm.common import prepare

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdé中") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def prose(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def plain(rows, width=sd.WIDTH):
    """``rows``: (doc_id, text) without NULL ids."""
    words = [(i, (x or "").encode().split()) for i, x in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < i:
                gone[k:k + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(w), int(gone.sum()), spans, hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def run(spark, rows, **kw):
    prepare(spark)
    return sorted(map(tuple, sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()))


@pytest.fixture(scope="module")
def rows():
    passages = [prose(n) for n in (12, 13, 14, 30, 60)]
    out = [(5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "x " * 400), (10, "x " * 100)]
    for i in range(20, 320):
        w = prose(rng.randint(5, 60))
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p + (p if rng.random() < 0.1 else [])
        out.append((rng.choice([i, 1000 - i]), rng.choice([" ", "\n", "\t \r\n"]).join(w)))
    long = prose(30_000)
    out += [(2000, " ".join(long)), (2001, " ".join(long[:20_000] + ["new"] + long[20_000:])), (2002, " ".join(long))]
    out += [(3000 + k, " ".join(passages[4])) for k in range(300)]  # one large group of copies
    return out


def test_equals_the_plain_version(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_many_blocks_buckets_and_sendings(spark, rows, monkeypatch):
    for name, n in (("BLOCK_BYTES", 20_000), ("BUCKET_NAMES", 3_000), ("HELD_NAMES", 500), ("SLICE_BYTES", 4_000)):
        monkeypatch.setattr(sd, name, n)
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, width=5) == plain(rows, 5)


def test_odd_rows(spark):
    p = " ".join(prose(40))
    got = run(spark, [(1, p), (1, p), (2, p), (2, p + " more")])
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, 40), (2, 40)]
    assert run(spark, []) == []
    prepare(spark)
    docs = spark.createDataFrame([(None, p, 1), (3, p, 1), (None, p, 1)], "doc_id long, text string, block long")
    assert [(r.doc_id, r.n_removed) for r in sd.substring_dedup(docs).collect()] == [(None, 0), (3, 0), (None, 0)] or \
        sorted((r.doc_id is None, r.n_removed) for r in sd.substring_dedup(docs).collect()) == [(False, 0), (True, 0), (True, 0)]


def test_words_and_hashes():
    texts = ["a bb\tccc", "", "  d", "e\x1cf g\x0bh", "é中 x"]
    raw = [x.encode() for x in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    h, at = sd.Words().split(np.frombuffer(b"".join(raw), np.uint8), off)
    words = [w for b in raw for w in b.split()]
    assert len(h) == len(words) and np.diff(at).tolist() == [len(b.split()) for b in raw]
    assert len(set(h.tolist())) == len(set(words))
    again, _ = sd.Words().split(np.frombuffer(b"zz ccc zz", np.uint8), np.array([0, 9]))
    assert again[1] == h[2] and again[0] == again[2]
    w = np.arange(40, dtype=np.uint64) % np.uint64(10)
    for k in (0, 1):
        g = sd.window_hashes(w, 13, k)
        assert g[3] == g[13] and len(set(g.tolist())) == 10
    assert sd.removed_spans(np.array([1, 1, 0, 0, 1, 0, 1], bool)) == [(0, 2), (4, 5), (6, 7)]
