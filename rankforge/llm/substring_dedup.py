"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted over all documents.

Each word covered by a window that also starts in a document with a smaller id is removed; covered words merge into
maximal intervals.

1. *Hash and count.* Every window's polynomial hash (over the hashes of its words) is dealt to a bucket as 32 further bits, and each
   bucket counts its names; a name seen once belongs to no repeated window. A task sends a name at most twice per block of
   documents, so a window found in a third of all texts does not fill a bucket.
2. *Name exactly.* The windows left are named by 96 bits from two polynomials of different bases, again once per block, with the
   smallest id of the block; each bucket reduces a name to the smallest id of all.
3. *Merge.* Names whose smallest id is smaller than the block's go back to the block, whose texts mark the windows
   and join them to intervals.

Texts are shuffled once to their blocks and those with candidates a second time; names travel packed, many to a row. Blocks and buckets
grow in number with the input, not in size. Two different windows share a name with a chance of about n^2 / 2^97 for n repeated windows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, utf8, worker_state

WIDTH = 13
#: Bytes of text in a block and windows counted in a bucket, about.
BLOCK_BYTES, BUCKET_NAMES = 8 << 20, 1_500_000
#: Bytes hashed at once in a task, and names held before they are sent.
SLICE_BYTES, HELD_NAMES = 4 << 20, 1_000_000
#: Odd multipliers: bytes of a word, and the two polynomials over words.
_BYTE_BASE, _BASES = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of a buffer of texts: where they start and end, and a hash of each from prefix sums over the bytes."""

    def __init__(self):
        self.table = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, b in (("power", _BYTE_BASE), ("inverse", pow(_BYTE_BASE, -1, 1 << 64))):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def split(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and where each row's words start among them (one entry more than rows)."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = ~SPACE[data]  # inside[i + 1]: byte i belongs to a word
        new_row = np.zeros(len(data) + 1, bool)
        new_row[off] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | new_row[:-1]))
        last = np.flatnonzero(inside[1:] & (np.concatenate([~inside[2:], [True]]) | new_row[1:]))
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=sums[1:])
        n = (last + 1 - start).astype(np.uint64)
        return _mix((sums[last + 1] - sums[start]) * self.inverse[start] + n), np.searchsorted(start, off)


def _words() -> Words:
    return worker_state(("words",), Words)


def window_hashes(words: np.ndarray, width: int, which: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` entries, by Horner's rule over all starts at once."""
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(_BASES[which]) + words[k:k + n]
    return _mix(h)


def _starts(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows inside each row, and their rows; ``at``: where rows begin among the words."""
    n = np.maximum(np.diff(at) - width + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[:-1][row], row


def _slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of some ``SLICE_BYTES`` together."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi
        lo = hi


def _coarse(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, the name's 32 bits in the lower."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Borders of the runs in which all keys stay the same."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]])


def _packed(cut: np.ndarray, **cols: np.ndarray) -> pa.Table:
    """One row per run: the first value of ``bucket`` and ``block``, the bytes of the other columns."""
    return pa.table({k: pa.array(v[cut[:-1]].astype(np.int64)) if k in ("bucket", "block")
                     else pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for k, v in cols.items()})


def _joined(t: pa.Table, col: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(col).to_pylist()), dtype)


_NAME = np.dtype([("hi", "<u8"), ("lo", "<u4")])


def _unpack(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw["hi"].astype(np.uint64), raw["lo"].astype(np.uint32)


def _pack_names(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    out = np.empty(len(hi), _NAME)
    out["hi"], out["lo"] = hi, lo
    return out


def removed_spans(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs ``(start, end)`` of marked words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_HELD = pa.schema([("block", pa.int64()), *_DONE, ("text", pa.binary()), ("at", pa.binary())])


def _result(text: bytes, doc, covered: np.ndarray | None) -> tuple:
    words = text.split()
    spans = [] if covered is None else removed_spans(covered)
    kept = words
    for a, b in reversed(spans):
        kept = kept[:a] + kept[b:] if len(spans) < 50 else kept
    if len(spans) >= 50:
        kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
    return doc, len(words), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b" ".join(kept)).hexdigest()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, n_spans (maximal removed intervals of words), kept_sha256.

    A NULL or empty text has no words; a text of fewer than ``width`` words loses nothing. Ids are compared as numbers: rows that repeat
    an id remove nothing from each other, a row without an id loses nothing and removes nothing. Windows repeated within one
    document only stay. Other columns of ``docs`` are not read."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = d.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]
    blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    # a word and its blank take two bytes at least; the count only sets how many buckets there are
    buckets = max(1, math.ceil(n_bytes / 6 / BUCKET_NAMES))
    dealt = d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, parts = _words(), 0, []

        def send():
            key, block = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            key, block = key[order], block[order]
            # of equal names of a block two are enough; only names met three times need a look
            many = np.zeros(len(key), bool)
            if len(key) > 2:
                same = key[2:] == key[:-2]
                many[2:] |= same
                many[1:-1] |= same
                many[:-2] |= same
            k, b = key[many], block[many]
            o = np.lexsort((b, k))
            k, b = k[o], b[o]
            third = np.zeros(len(k), bool)
            third[2:] = (k[2:] == k[:-2]) & (b[2:] == b[:-2])
            key, block = np.concatenate([key[~many], k[~third]]), np.concatenate([block[~many], b[~third]])
            order = np.argsort(key, kind="stable")
            key, block = key[order], block[order]
            bucket = key >> np.uint64(32)
            yield from _packed(_cuts(bucket), bucket=bucket, blocks=block, names=key.astype("<u4")).to_batches(512)

        for b in batches:
            data, off = utf8(b.column(1))
            block = b.column(0).to_numpy(zero_copy_only=False).astype("<u4")
            for lo, hi in _slices(off):
                w, at = words.split(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                where, row = _starts(at, width)
                parts.append((_coarse(window_hashes(w, width, 0)[where], buckets), block[lo:hi][row]))
                held += len(where)
                if held > HELD_NAMES:
                    yield from send()
                    held, parts = 0, []
        if parts:
            yield from send()

    def repeated(t: pa.Table) -> pa.Table:
        """Names that a bucket counts twice or more, per block."""
        bucket = t.column("bucket")[0].as_py()
        block, name = _joined(t, "blocks", "<u4"), _joined(t, "names", "<u4")
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        more = np.zeros(len(name), bool)
        more[1:] |= same
        more[:-1] |= same
        at = order[more]
        key = np.unique(block[at].astype(np.uint64) << np.uint64(32) | name[at])
        block = key >> np.uint64(32)
        return _packed(_cuts(block), block=block, bucket=np.full(len(key), bucket), names=key.astype("<u4"))

    sent = dealt.select("block", "text").mapInArrow(count, "bucket bigint, blocks binary, names binary")
    hits = materialize(sent.groupBy("bucket").applyInArrow(repeated, "block bigint, bucket bigint, names binary"), "repeated-windows")

    def candidates(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        """Texts of a block that hold a repeated name, with the windows' places; the others are done."""
        words = _words()
        known = [np.frombuffer(n, "<u4").astype(np.uint64) | np.uint64(k) << np.uint64(32)
                 for k, n in zip(found.column("bucket").to_pylist(), found.column("names").to_pylist(), strict=True)]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        out = []
        if texts.num_rows:
            data, off = utf8(texts.column("text"))
            ids = texts.column("doc_id").to_pylist()
            for lo, hi in _slices(off):
                w, at = words.split(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                where, row = _starts(at, width)
                if len(known):
                    k = _coarse(window_hashes(w, width, 0)[where], buckets)
                    good = known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k
                    where, row = where[good], row[good]
                else:
                    where, row = where[:0], row[:0]
                border = np.searchsorted(row, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    text, mine = data[off[lo + r]:off[lo + r + 1]].tobytes(), where[border[r]:border[r + 1]]
                    if len(mine) and ids[lo + r] is not None:
                        out.append((key[0].as_py(), ids[lo + r], None, None, None, None, text, (mine - at[r]).astype("<u4").tobytes()))
                    else:
                        out.append((key[0].as_py(), *_result(text, ids[lo + r], None), None, None))
        return _rows(out, _HELD)

    schema = "block bigint, doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text binary, at binary"
    held = materialize(dealt.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(candidates, schema), "window-candidates")
    open_texts = held.filter("text is not null").select("block", "doc_id", "text", "at")

    def named(text: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the candidate windows of a text and their two names."""
        where = np.frombuffer(at, "<u4").astype(np.int64)
        w, _ = _words().split(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        return where, window_hashes(w, width, 0)[where], window_hashes(w, width, 1)[where].astype(np.uint32)

    name_buckets = max(1, math.ceil(n_bytes / 6 / BUCKET_NAMES))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, parts = 0, []

        def send():
            block, doc, hi, lo = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((doc, lo, hi, block))
            block, doc, hi, lo = block[order], doc[order], hi[order], lo[order]
            first = _cuts(block, hi, lo)[:-1]  # the smallest id of a block stands for the others
            block, doc, hi, lo = block[first], doc[first], hi[first], lo[first]
            bucket = (hi >> np.uint64(32)) % np.uint64(name_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, block, doc, hi, lo = (x[order] for x in (bucket, block, doc, hi, lo))
            yield from _packed(_cuts(bucket), bucket=bucket, blocks=block.astype("<u4"), docs=doc, names=_pack_names(hi, lo)).to_batches(512)

        for b in batches:
            for block, doc, text, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, hi, lo = named(text, at)
                parts.append((np.full(len(hi), block, np.int64), np.full(len(hi), doc, np.int64), hi, lo))
                size += len(hi)
                if size > HELD_NAMES:
                    yield from send()
                    size, parts = 0, []
        if parts:
            yield from send()

    def earlier(t: pa.Table) -> pa.Table:
        """Per block the names that start in a document with a smaller id than the block's own, and that id."""
        block, doc = _joined(t, "blocks", "<u4"), _joined(t, "docs", "<i8")
        hi, lo = _unpack(_joined(t, "names", _NAME))
        order = np.lexsort((doc, lo, hi))
        block, doc, hi, lo = block[order], doc[order], hi[order], lo[order]
        cut = _cuts(hi, lo)
        least = np.repeat(doc[cut[:-1]], np.diff(cut)) if len(doc) else doc
        late = np.flatnonzero(doc > least)
        late = late[np.argsort(block[late], kind="stable")]
        block = block[late]
        return _packed(_cuts(block), block=block, docs=least[late], names=_pack_names(hi[late], lo[late]))

    sent = open_texts.mapInArrow(name, "bucket bigint, blocks binary, docs binary, names binary")
    first = materialize(sent.groupBy("bucket").applyInArrow(earlier, "block bigint, docs binary, names binary"), "earlier-windows")

    def merge(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        rows = list(zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), texts.column("at").to_pylist(), strict=True))
        parts = [(*named(text, at), np.full(len(at) // 4, k), np.full(len(at) // 4, doc)) for k, (doc, text, at) in enumerate(rows)]
        if not parts:
            return _rows([], _DONE)
        where, hi, lo, row, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        far_hi, far_lo = _unpack(_joined(found, "names", _NAME))
        far_doc = _joined(found, "docs", "<i8")
        # the block's own windows and the answers from elsewhere are ordered by name; the smallest id of a name decides
        all_hi, all_lo, all_doc = (np.concatenate(x) for x in ((hi, far_hi), (lo, far_lo), (doc, far_doc)))
        order = np.lexsort((all_doc, all_lo, all_hi))
        cut = _cuts(all_hi[order], all_lo[order])
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(all_doc[order][cut[:-1]], np.diff(cut))
        gone = least[:len(doc)] < doc
        where, row = where[gone], row[gone]
        border = np.searchsorted(row, np.arange(len(rows) + 1))
        out = []
        for k, (i, text, _) in enumerate(rows):
            mine = where[border[k]:border[k + 1]]
            covered = None
            if len(mine):
                edge = np.zeros(len(text.split()) + 1, np.int32)
                edge[mine] += 1
                np.add.at(edge, mine + width, -1)
                covered = np.cumsum(edge[:-1]) > 0
            out.append(_result(text, i, covered))
        return _rows(out, _DONE)

    cols = [f.name for f in _DONE]
    merged = open_texts.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(merge, ", ".join(f"{c} {'string' if c == 'kept_sha256' else 'bigint'}" for c in cols))
    return held.filter("text is null").select(*cols).unionByName(merged)
