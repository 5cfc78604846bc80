"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how usual each link is.

Both tokenizers encode the same bytes; offsets where a token of either ends cut a text into groups, and every A-B pair of a group is a
link. The pairs' document counts come from external spill counting:

1. *Radix runs.* Documents are gathered to blocks of bounded size. A block's pair-document records are folded to one record per pair with
   its number of documents, radix-partitioned by the A id, sorted and written as zstd runs of short frames to the shared folder.
2. *Merge.* A k-way merge per partition keeps a heap of the runs' next frames and decodes a frame only when its first pair is next.
   Equal pairs of all runs are summed. Pairs come A-side major, so an A id's highest count is known when the next id begins, and
   each record's total and mark of the highest stream back to its run in the run's order, without the pair.
3. *Contributions.* Blocks read the answers to their runs and add them up per document.

A pair found in every document costs one record per block, not one per document. Texts are encoded once and never shuffled.

Where both vocabularies cut before a single blank between two non-blanks, a text is the sequence of its blank-delimited words, and each
distinct word is encoded and aligned once per worker; any other text is encoded whole."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_state

#: Pair-document records and documents of a block, pairs of a frame, and records that a merge works on at once.
BLOCK_RECORDS, BLOCK_DOCS, FRAME, POOL = 1_000_000, 100_000, 2048, 262_144
#: Bytes of text per radix partition, about.
PART_BYTES = 16 << 20
#: Words that a worker keeps aligned; beyond it the table starts anew (a bound on memory only).
KNOWN_WORDS = 300_000


def byte_alphabet() -> dict[str, int]:
    """Byte of each character by which a byte-level vocabulary writes it: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts ``n``: the number of the run of each entry, and its place in the run."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


class Aligned:
    """Groups and pairs of units encoded by both tokenizers: per unit the numbers of tokens, groups and links, the groups as text,
    and its distinct pairs ``a * width + b`` with how often each is linked. A unit whose tokens do not give back its bytes is ``None`` in ``text``."""

    def __init__(self, ok, a, na, b, nb, len_a, len_b, width):
        unit_a, unit_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        good_a, good_b = ok[unit_a], ok[unit_b]
        a, unit_a, b, unit_b = a[good_a], unit_a[good_a], b[good_b], unit_b[good_b]
        # units follow one another with the same length in both, so ends compare across all of them
        end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        per_a, per_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        unit = np.zeros(len(cut), np.int64)
        unit[group_a] = unit_a
        n = len(ok)
        self.n_a, self.n_b = (np.where(ok, x, 0).astype(np.int64) for x in (na, nb))
        self.n_groups = np.bincount(unit, minlength=n)
        self.n_links = np.bincount(unit, weights=(per_a * per_b).astype(float), minlength=n).astype(np.int64)
        one_a, one_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        ca, cb = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (per_a, per_b))
        groups = [f"{','.join(one_a[ca[g]:ca[g + 1]])}|{','.join(one_b[cb[g]:cb[g + 1]])}" for g in range(len(cut))]
        cg = np.concatenate([[0], np.cumsum(self.n_groups)]).tolist()
        self.text = [";".join(groups[cg[k]:cg[k + 1]]).encode() if good else None for k, good in enumerate(ok.tolist())]
        # distinct ids of a group with their counts, crossed: a long group without common ends costs its distinct pairs only
        (ga, ia, ma), (gb, ib, mb) = self._distinct(group_a, a), self._distinct(group_b, b)
        da, db = np.bincount(ga, minlength=len(cut)), np.bincount(gb, minlength=len(cut))
        first_a, first_b = np.cumsum(da) - da, np.cumsum(db) - db
        g, k = expand(da * db)
        x, y = first_a[g] + k // np.maximum(db[g], 1), first_b[g] + k % np.maximum(db[g], 1)
        key, mult, owner = ia[x].astype(np.uint64) * np.uint64(width) + ib[y].astype(np.uint64), ma[x] * mb[y], unit[g]
        order = np.lexsort((key, owner))
        key, mult, owner = key[order], mult[order], owner[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        self.key, self.mult = key[at], np.add.reduceat(mult, at) if len(at) else mult
        self.n_pairs = np.bincount(owner[at], minlength=n)

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, n = np.unique(group.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_counts=True)
        return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), n


class Pair:
    """Two tokenizers over the same texts, and a worker's table of aligned words."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # words stand alone only if no piece reaches over the blank between two
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.reset()

    @property
    def width(self) -> int:
        return len(self.bytes_b)

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes | None] = []
        self.n = np.zeros((4, 0), np.int64)
        self.key, self.mult, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def align(self, units: list[str]) -> Aligned:
        """``units`` without their leading blank."""
        marked = [" " + u for u in units]
        if len(units) > 1:  # one call for all; each is encoded independently
            e = self.a.encode(marked, is_pretokenized=True, add_special_tokens=False)
            a, na = np.array(e.ids, np.int64), np.bincount(np.array(e.word_ids, np.int64), minlength=len(units))
        else:
            a = np.array(self.a.encode(marked[0], add_special_tokens=False).ids, np.int64)
            na = np.array([len(a)])
        ids_b = self.b.encode(units, num_threads=1)
        nb = np.array([len(x) for x in ids_b], np.int64)
        b = np.array([i for x in ids_b for i in x], np.int64)
        want = [m.encode() for m in marked]
        ok = np.ones(len(units), bool)
        for ids, n, table in ((a, na, self.bytes_a), (b, nb, self.bytes_b)):
            got = [table[i] for i in ids.tolist()]
            if b"".join(got) != b"".join(want) or not np.array_equal(np.add.reduceat(np.append([len(x) for x in got], 0), np.cumsum(n) - n) * (n > 0), [len(w) for w in want]):
                at = np.concatenate([[0], np.cumsum(n)]).tolist()
                ok &= np.array([b"".join(got[at[k]:at[k + 1]]) == w for k, w in enumerate(want)], bool)
        return Aligned(ok, a, na, b, nb, self.len_a, self.len_b, self.width)

    def _add(self, units: list[str]) -> None:
        x = self.align(units)
        self.text += x.text
        self.n = np.concatenate([self.n, [x.n_a, x.n_b, x.n_groups, x.n_links]], axis=1)
        self.key, self.mult = np.concatenate([self.key, x.key]), np.concatenate([self.mult, x.mult])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(x.n_pairs)])

    def documents(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
        """Per text: the four counts, its groups as text, its pairs and how often each is linked (a pair may come several times)."""
        if len(self.text) > KNOWN_WORDS:
            self.reset()
        plans: list[list[str] | None] = []
        fresh: dict[str, None] = {}
        for x in texts:
            words = x.split(" ") if x and self.by_word else None
            if words is not None and (not all(words) or any(w[0].isspace() or w[-1].isspace() for w in words)):
                words = None
            plans.append(words)
            if words is not None:
                fresh.update((w, None) for w in words if w not in self.number)
        if fresh:
            units = list(fresh)
            base = len(self.text)
            self._add(units)
            self.number.update(zip(units, range(base, base + len(units)), strict=True))
        nothing = np.zeros(4, np.int64), b"", np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for x, words in zip(texts, plans, strict=True):
            if not x:
                yield nothing
                continue
            if words is not None:
                n = [self.number[w] for w in words]
                said = [self.text[k] for k in n]
                if None not in said:
                    used, times = np.unique(np.array(n, np.int64), return_counts=True)
                    unit, k = expand(self.at[used + 1] - self.at[used])
                    at = self.at[used][unit] + k
                    yield self.n[:, used] @ times, b";".join(said), self.key[at], self.mult[at] * times[unit]
                    continue
            whole = self.align([x])
            yield nothing if whole.text[0] is None else (np.array([whole.n_a[0], whole.n_b[0], whole.n_groups[0], whole.n_links[0]]), whole.text[0], whole.key, whole.mult)


def write_run(key: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted pairs with their counts: a head with every frame's first pair, pairs and bytes, then the frames, each compressed by itself."""
    frames, head = [], []
    c = zstandard.ZstdCompressor(level=1)
    for lo in range(0, len(key), FRAME):
        k, n = key[lo:lo + FRAME], count[lo:lo + FRAME]
        frames.append(c.compress(np.diff(k, prepend=k[:1]).astype("<u8").tobytes() + n.astype("<u4").tobytes()))
        head.append((int(k[0]), len(k), len(frames[-1])))
    return np.array([len(head)], "<u8").tobytes() + np.array(head, "<u8").tobytes() + b"".join(frames)


class Run:
    """Reads a run frame by frame."""

    def __init__(self, data: bytes):
        n = int(np.frombuffer(data, "<u8", 1)[0])
        self.head = np.frombuffer(data, "<u8", 3 * n, 8).reshape(n, 3)
        self.data, self.at, self.next, self.read = data, 8 + 24 * n, 0, 0
        self.size = int(self.head[:, 1].sum())

    def first(self) -> int | None:
        return int(self.head[self.next, 0]) if self.next < len(self.head) else None

    def frame(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs, counts and the place of the first in the run."""
        first, n, size = (int(x) for x in self.head[self.next])
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.at:self.at + size])
        place, self.at, self.next, self.read = self.read, self.at + size, self.next + 1, self.read + n
        return np.cumsum(np.frombuffer(raw, "<u8", n)) + np.uint64(first), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64), place


def merge_runs(runs: list[Run], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """K-way merge: chunks ``(run, place, total, best)`` of records whose A ids are complete. total: the pair's count over all runs; best:
    whether that is the highest of its A id."""
    heap = [(r.first(), i) for i, r in enumerate(runs) if r.first() is not None]
    heapq.heapify(heap)
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    while heap or held:
        while heap and size < POOL:
            _, i = heapq.heappop(heap)
            key, n, place = runs[i].frame()
            held.append((key, n, np.full(len(key), i), np.arange(place, place + len(key))))
            size += len(key)
            if runs[i].first() is not None:
                heapq.heappush(heap, (runs[i].first(), i))
        key, n, run, place = (np.concatenate(x) for x in zip(*held, strict=True))
        # all records below the first A id that may still come are complete
        ready = key < np.uint64(heap[0][0] // width * width) if heap else np.ones(len(key), bool)
        held, size = [(key[~ready], n[~ready], run[~ready], place[~ready])] if not ready.all() else [], 0
        if not ready.any():
            # one A id fills the pool: take more frames at once
            size = -sum(len(x[0]) for x in held)
            continue
        key, n, run, place = key[ready], n[ready], run[ready], place[ready]
        order = np.argsort(key, kind="stable")
        key, n, run, place = key[order], n[order], run[order], place[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(n, at)
        a = key[at] // np.uint64(width)
        side = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        most = np.repeat(np.maximum.reduceat(total, side), np.diff(np.append(side, len(total))))
        times = np.diff(np.append(at, len(key)))
        yield run, place, np.repeat(total, times), np.repeat(total == most, times)


_BLOCK = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int64()), ("run", pa.binary()), ("doc_id", pa.list_(pa.int64())),
                    ("counts", pa.binary()), ("sha", pa.list_(pa.string())), ("n_pairs", pa.binary()), ("places", pa.binary()), ("times", pa.binary())])
_BLOCK_SQL = "kind int, block bigint, part bigint, run binary, doc_id array<bigint>, counts binary, sha array<string>, n_pairs binary, places binary, times binary"


class Block:
    """Documents gathered until they hold enough records; ``rows`` writes them with the block's runs."""

    def __init__(self, parts: int, width: int):
        self.parts, self.width, self.records = parts, width, 0
        self.ids, self.counts, self.sha, self.keys, self.times, self.size = [], [], [], [], [], []

    def add(self, doc, counts: np.ndarray, groups: bytes, key: np.ndarray, times: np.ndarray) -> None:
        self.ids.append(doc)
        self.counts.append(counts)
        self.sha.append(hashlib.sha256(groups).hexdigest() if groups else "")
        self.keys.append(key)
        self.times.append(times)
        self.size.append(len(key))
        self.records += len(key)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        doc = np.repeat(np.arange(len(self.ids)), self.size)
        order = np.lexsort((key, doc))
        key, times, doc = key[order], times[order], doc[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        times = np.add.reduceat(times, at) if len(at) else times
        key, doc = key[at], doc[at]
        pair, of, n = np.unique(key, return_inverse=True, return_counts=True)
        part = (pair // np.uint64(self.width)) % np.uint64(self.parts)
        order = np.argsort(part, kind="stable")  # pairs are sorted already: by part, then A-side major
        place = np.empty(len(pair), np.int64)
        place[order] = np.arange(len(pair))
        pair, n, part = pair[order], n[order], part[order]
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
        where = place[of]
        order = np.lexsort((where, doc))
        where, doc, times = where[order], doc[order], times[order]
        n_pairs = np.bincount(doc, minlength=len(self.ids))
        step = np.diff(where, prepend=0).astype("<i4")
        z = zstandard.ZstdCompressor(level=3)
        none = [None] * 6
        rows = [(0, block, int(part[a]), write_run(pair[a:b], n[a:b]), *none) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        rows.append((1, block, None, None, self.ids, np.array(self.counts, "<i8").tobytes(), self.sha, n_pairs.astype("<u4").tobytes(),
                     z.compress(step.tobytes()), z.compress(times.astype("<u4").tobytes())))
        cols = list(zip(*rows, strict=True))
        t = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOCK, strict=True)], schema=_BLOCK)
        yield from t.to_batches(1024)


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a``: a byte-level vocabulary of ``tokenizers``, which encodes blank + text; ``path_b``: a ``sentencepiece`` model, which adds the
    blank itself. A NULL or empty text, and one whose tokens of either side do not give back blank + text, has zeros and ''. Every row is a
    document of its own, also when rows repeat an id; ids may be NULL. Ties for an A id's highest count are all best. Other columns
    of ``docs`` are not read. Memory: the blocks' size, and for a text the distinct pairs of its longest group."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = d.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]
    parts = max(1, math.ceil(n_bytes / PART_BYTES))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = worker_state(("pair", path_a, path_b), lambda: Pair(path_a, path_b))
        number = TaskContext.get().partitionId() << 32
        block = Block(parts, pair.width)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                for doc, x in zip(part.column(0).to_pylist(), pair.documents(part.column(1).to_pylist()), strict=True):
                    block.add(doc, *x)
                    if block.records >= BLOCK_RECORDS or len(block.ids) >= BLOCK_DOCS:
                        yield from block.rows(number)
                        number, block = number + 1, Block(parts, pair.width)
        if block.ids:
            yield from block.rows(number)

    blocks = materialize(d.mapInArrow(tokenize, _BLOCK_SQL), "aligned-blocks")

    def merge(t: pa.Table) -> pa.Table:
        runs = [Run(x) for x in t.column("run").to_pylist()]
        width = worker_state(("width", path_b), lambda: _pieces(path_b))
        first = np.concatenate([[0], np.cumsum([r.size for r in runs])])
        total = np.zeros(first[-1], np.int64)
        for run, place, n, best in merge_runs(runs, width):
            total[first[run] + place] = 2 * n + best
        z = zstandard.ZstdCompressor(level=1)
        back = [z.compress(total[a:b].astype("<u8").tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.table({"block": t.column("block"), "part": t.column("part"), "back": pa.array(back, pa.binary())})

    counted = blocks.filter("kind = 0").select("block", "part", "run").groupBy("part").applyInArrow(merge, "block bigint, part bigint, back binary")
    counted = materialize(counted, "pair-counts")

    def contributions(texts: pa.Table, found: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        found = found.sort_by("part")
        said = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(z.decompress(x), "<u8") for x in found.column("back").to_pylist())]).astype(np.int64)
        out = []
        for r in texts.to_pylist():
            n = np.frombuffer(r["n_pairs"], "<u4").astype(np.int64)
            where = np.cumsum(np.frombuffer(z.decompress(r["places"]), "<i4"), dtype=np.int64)
            times = np.frombuffer(z.decompress(r["times"]), "<u4").astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * (said[where] & 1), times * (said[where] >> 1))]
            best, count = (s[at[1:]] - s[at[:-1]] for s in sums)
            counts = np.frombuffer(r["counts"], "<i8").reshape(-1, 4)
            out.append(pa.Table.from_arrays([pa.array(r["doc_id"], pa.int64()), *(pa.array(counts[:, k]) for k in range(4)), pa.array(best), pa.array(count),
                                             pa.array(r["sha"], pa.string())], schema=_OUT))
        return pa.concat_tables(out) if out else _OUT.empty_table()

    schema = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in _OUT)
    own = blocks.filter("kind = 1").select("block", "doc_id", "counts", "sha", "n_pairs", "places", "times")
    return own.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(contributions, schema)


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
