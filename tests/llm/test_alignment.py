"""Token alignment and pair counts against a plain version, over many blocks, partitions and frames, and on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankforge.llm import alignment as al
from rankforge.llm.common import prepare
from rankforge.llm.queries import tokenizer_path

PATHS = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
rng = random.Random(12)
VOCAB = ["the", "of", "größer", "naïve", "中文字符", "tokenization", "3.1415", "don't", "x\ny", "<s>", "<|endoftext|>", "emoji😀", "ﬁ", "ab" * 9, "Привет", "▁", "_", "a b"] + \
    ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(150)]


def texts():
    out = [None, "", " ", "  two  blanks ", "line\n\nbreak \n x", "\tTab", "one", "one", "a" * 3000, "é" * 500, "no\x00nul", "中" * 300, "▁x y", "end ", " lead"]
    out += [rng.choice([" ", " ", " ", "  ", "\n"]).join(rng.choice(VOCAB) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    return out + [" ".join(rng.choice(VOCAB) for _ in range(20_000))] + ["the same text of many"] * 60


def plain(rows):
    """``rows``: (id, text). Whole texts are encoded, tokens decoded and every occurrence pair visited."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    ta.encode_special_tokens = True
    alphabet = al.byte_alphabet()
    docs, seen = [], Counter()
    for i, x in rows:
        groups = []
        if x:
            want = (" " + x).encode()
            a = ta.encode(" " + x, add_special_tokens=False).ids
            b = tb.encode(x)
            wa = [bytes(alphabet[c] for c in ta.id_to_token(k)) for k in a]
            wb = [bytes([int(p[3:5], 16)]) if tb.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, tb.id_to_piece(k)) for k in b)]
            if b"".join(wa) == want and b"".join(wb) == want:
                ea, eb = np.cumsum([len(w) for w in wa]).tolist(), np.cumsum([len(w) for w in wb]).tolist()
                cut, lo = sorted(set(ea) & set(eb)), 0
                for c in cut:
                    groups.append(([k for k, e in zip(a, ea, strict=True) if lo < e <= c], [k for k, e in zip(b, eb, strict=True) if lo < e <= c])) if len(x) < 9000 else None
                    lo = c
                if len(x) >= 9000:  # the same by one pass
                    ga, gb = defaultdict(list), defaultdict(list)
                    for k, e in zip(a, np.searchsorted(cut, ea).tolist(), strict=True):
                        ga[e].append(k)
                    for k, e in zip(b, np.searchsorted(cut, eb).tolist(), strict=True):
                        gb[e].append(k)
                    groups = [(ga[e], gb[e]) for e in range(len(cut))]
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        seen.update(links.keys())
        docs.append((i, groups, links))
    top = defaultdict(int)
    for (p, _), n in seen.items():
        top[p] = max(top[p], n)
    out = []
    for i, groups, links in docs:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
                    sum(m for k, m in links.items() if seen[k] == top[k[0]]), sum(m * seen[k] for k, m in links.items()), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out)


def run(spark, rows):
    prepare(spark)
    return sorted(map(tuple, al.alignment(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()))


@pytest.fixture(scope="module")
def rows():
    return [(k, x) for k, x in enumerate(texts())]


def test_equals_the_plain_version(spark, rows):
    got = run(spark, rows)
    assert got == plain(rows)
    assert sum(r[1] > 0 for r in got) > 150


def test_many_blocks_parts_and_frames(spark, rows, monkeypatch):
    for name, n in (("BLOCK_RECORDS", 300), ("BLOCK_DOCS", 7), ("FRAME", 5), ("POOL", 40), ("PART_BYTES", 9_000), ("KNOWN_WORDS", 50)):
        monkeypatch.setattr(al, name, n)
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    assert run(spark, []) == []
    prepare(spark)
    docs = spark.createDataFrame([(1, "a b", 9, 1), (1, "a b", 9, 2), (None, "a c", 9, 3)], "doc_id long, text string, part long, kind int")
    got = [tuple(r) for r in al.alignment(docs, *PATHS).collect()]
    assert sorted(got, key=str) == sorted(map(tuple, plain([(1, "a b"), (1, "a b"), (-1, "a c")])), key=str) or \
        sorted([(-1 if r[0] is None else r[0], *r[1:]) for r in got]) == plain([(1, "a b"), (1, "a b"), (-1, "a c")])


def test_merge_of_runs():
    r = np.random.default_rng(4)
    raw = []
    for _ in range(40):
        key = np.unique(np.where(r.random(300) < 0.4, r.integers(0, 50, 300), r.integers(0, 5_000, 300))).astype(np.uint64)
        raw.append((key, r.integers(1, 9, len(key))))
    total = Counter()
    for key, n in raw:
        total.update(dict(zip(key.tolist(), n.tolist(), strict=True)))
    for frame, pool in ((3, 10), (64, 100), (2048, 1 << 18)):
        al.FRAME, al.POOL, was = frame, pool, (al.FRAME, al.POOL)
        try:
            said = {}
            for run_no, place, n, best in al.merge_runs([al.Run(al.write_run(*x)) for x in raw], 100):
                said.update({(i, p): (c, m) for i, p, c, m in zip(run_no.tolist(), place.tolist(), n.tolist(), best.tolist(), strict=True)})
        finally:
            al.FRAME, al.POOL = was
        top = defaultdict(int)
        for k, n in total.items():
            top[k // 100] = max(top[k // 100], n)
        assert said == {(i, p): (total[k], total[k] == top[k // 100]) for i, (key, _) in enumerate(raw) for p, k in enumerate(key.tolist())}
