"""Repeated passages: distributed difference-cover matching of byte strings.

Marks every byte covered by a ``length``-byte string that also starts elsewhere, in the same or another text.

The difference-cover idea, bounded at the depth that matters: only whether two suffixes share ``length`` bytes counts, so
suffixes are ordered by the names of prefixes, not to their ends.

1. *Sample.* Positions whose offset modulo ``period`` lies in a perfect difference set. Of any two offsets there is exactly one shift
   below ``period`` that brings both into the sample, so two equal strings contain equal sampled prefixes of ``length - period + 1`` bytes.
2. *Sort and name the samples.* Names (hashes of the prefixes) are dealt to buckets and sorted there; a sample equal
   to its neighbour is repeated. Under 10 % of the positions take part, as 8 bytes each.
3. *Merge the rest.* Every start less than ``period`` before a repeated sample is named by its whole ``length`` bytes;
   all other starts cannot be repeated.
4. *Compare neighbours.* In each sorted bucket a start equal to its neighbour is repeated, the others go back to their texts.

Records travel packed, many to a row; buckets and blocks are numerous in proportion to the input. Within a task equal names of one block
are sent twice at most, so a string in a third of all texts does not fill a bucket. Equal texts are one text with a count.
Names are 64-bit hashes (with the bucket some 70 bits or more at scale), the samples' 32 bits may only add candidates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_shuffles, small, utf8, worker_state

#: Bytes of text in a block and names in a bucket, about.
BLOCK_BYTES, BUCKET_NAMES = 8 << 20, 600_000
#: Bytes hashed at once in a task, and names held before they are sent.
SLICE_BYTES, HELD_NAMES = 4 << 20, 2_000_000
ORDER = 11


def difference_set(q: int = ORDER) -> np.ndarray:
    """Singer's perfect difference set modulo q*q + q + 1 for a prime q: the powers of a generator of GF(q^3) over
    GF(q) that lie in a plane. Every non-zero residue is a difference of two members exactly once."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, members = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        members.append(i)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(members) == q + 1 and len({(s - t) % v for s in members for t in members if s != t}) == v - 1:
                    return np.array(members)
    raise ValueError(f"no difference set for {q}")


class Hasher:
    """Polynomial hashes modulo 2**64 of all windows of a buffer, from prefix sums."""

    def __init__(self):
        self.base = 0x9E3779B97F4A7C15
        self.table = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.zeros(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, b in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = (sums[at + n] - sums[at]) * self.inverse[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _hasher() -> Hasher:
    return worker_state(("window-hash",), Hasher)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    g = (h ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xBF58476D1CE4E5B9)
    return (g >> np.uint64(33)) % np.uint64(buckets)


class _Outbox:
    """Names of a task, sent per bucket as rows ``(bucket, blocks, names)``: of equal names of a block two at most."""

    def __init__(self, buckets: int, dtype: str):
        self.buckets, self.dtype, self.held, self.parts = buckets, dtype, 0, []

    def add(self, block: np.ndarray, h: np.ndarray) -> None:
        self.parts.append((block.astype(np.uint32), h))
        self.held += len(h)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            block, h = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            bucket = _bucket(h, self.buckets)
            name = h.astype(self.dtype)
            order = np.lexsort((name, block, bucket))
            bucket, block, name = bucket[order], block[order], name[order]
            same = (bucket[2:] == bucket[:-2]) & (block[2:] == block[:-2]) & (name[2:] == name[:-2])
            keep = np.concatenate([np.ones(min(2, len(name)), bool), ~same])
            bucket, block, name = bucket[keep], block[keep], name[keep]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for lo in range(0, len(cut) - 1, 256):
                c = cut[lo:lo + 257]
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[c[:-1]].astype(np.int64)), pa.array([block[a:b].tobytes() for a, b in zip(c[:-1], c[1:], strict=True)], pa.binary()),
                    pa.array([name[a:b].tobytes() for a, b in zip(c[:-1], c[1:], strict=True)], pa.binary())], ["bucket", "blocks", "names"])
        self.held, self.parts = 0, []


_SENT = "bucket bigint, blocks binary, names binary"


def _neighbours(rows: DataFrame, dtype: str, repeated: bool) -> DataFrame:
    """Sorts every bucket; names that equal a neighbour (or, with ``repeated`` off, those that do not) go
    back per block as rows ``(block, bucket, names)``."""
    def sort(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py() if t.num_rows else 0
        block = np.frombuffer(b"".join(t.column("blocks").to_pylist()), np.uint32)
        name = np.frombuffer(b"".join(t.column("names").to_pylist()), dtype)
        order = np.argsort(name, kind="stable")
        equal = name[order][1:] == name[order][:-1]
        twice = np.zeros(len(name), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        at = order[twice == repeated]
        block, name = block[at], name[at]
        order = np.lexsort((name, block))
        block, name = block[order], name[order]
        first = np.ones(len(name), bool)
        first[1:] = (block[1:] != block[:-1]) | (name[1:] != name[:-1])
        block, name = block[first], name[first]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
        return pa.table({"block": pa.array(block[cut[:-1]].astype(np.int64)), "bucket": pa.array(np.full(len(cut) - 1, bucket, np.int64)),
                         "names": pa.array([name[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})
    return rows.groupBy("bucket").applyInArrow(sort, "block bigint, bucket bigint, names binary")


def _slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of some ``SLICE_BYTES`` together."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi
        lo = hi


def _sampled(members: np.ndarray, period: int, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions that have ``window`` bytes left in their row, and their rows."""
    room = np.diff(off) - window + 1
    most = int(room.max(initial=0))
    if most <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_at = (np.arange(0, most, period)[:, None] + members[None, :]).ravel()
    n = np.searchsorted(all_at, np.maximum(room, 0))
    n[room <= 0] = 0
    row = np.repeat(np.arange(len(room)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return off[:-1][row] + all_at[k], row


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A NULL or empty text has 0 bytes and the hash of nothing; a text shorter than ``length`` loses nothing. Rows that repeat a text
    of at least ``length`` bytes lose all of it, also when they repeat the id."""
    members, period = difference_set(), ORDER * ORDER + ORDER + 1
    prefix = length - period + 1
    if prefix < 1:
        raise ValueError(f"length must be at least {period}")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "texts")
    sums = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b"), F.count("*").alias("n")).head()
    blocks = max(1, math.ceil(sums["b"] / BLOCK_BYTES))
    buckets = max(1, math.ceil(sums["b"] * len(members) / period / BUCKET_NAMES))

    # one row stands for all rows of a text
    text = rows.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    text = materialize(text, "distinct")
    again = materialize(rows.join(text.filter("copies > 1"), "sha").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(
        F.col("doc_id").alias("_id"), F.col("n_bytes").alias("_n"), F.col("sha").alias("_sha")).distinct(), "copies")
    long = d.filter(F.octet_length("text") >= length)
    once = long.join(small(again.select("_id", F.substring("_sha", 1, 8).alias("_s8"))), F.col("doc_id").eqNullSafe(F.col("_id"))
                     & (F.substring(F.unhex(F.sha2("text", 256)), 1, 8) == F.col("_s8")), "left_anti") \
        .select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).alias("block"), "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, out = _hasher(), _Outbox(buckets, "uint32")
        for b in batches:
            data, off = utf8(b.column(1))
            block = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in _slices(off):
                own = off[lo:hi + 1] - off[lo]
                at, row = _sampled(members, period, own, prefix)
                out.add(block[lo:hi][row], hasher.windows(hasher.sums(data[off[lo]:off[hi]]), at, prefix))
                if out.held > HELD_NAMES:
                    yield from out.flush()
        yield from out.flush()

    hits = materialize(_neighbours(once.mapInArrow(sample, _SENT), "uint32", True), "repeated-samples")
    release_shuffles(docs.sparkSession)

    def candidates(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        """Texts of a block with a repeated sample, and the offsets of those samples."""
        hasher = _hasher()
        keys = [np.frombuffer(n, np.uint32).astype(np.uint64) | np.uint64(k) << np.uint64(32)
                for k, n in zip(found.column("bucket").to_pylist(), found.column("names").to_pylist(), strict=True)]
        known = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        kept, where = [], []
        if len(known) and texts.num_rows:
            data, off = utf8(texts.column("text"))
            for lo, hi in _slices(off):
                own = off[lo:hi + 1] - off[lo]
                at, row = _sampled(members, period, own, prefix)
                h = hasher.windows(hasher.sums(data[off[lo]:off[hi]]), at, prefix)
                k = (h & np.uint64(0xFFFFFFFF)) | _bucket(h, buckets) << np.uint64(32)
                j = np.minimum(np.searchsorted(known, k), len(known) - 1)
                good = known[j] == k
                at, row = at[good], row[good]
                for r in np.unique(row):
                    kept.append(data[off[lo + r]:off[lo + r + 1]].tobytes())
                    mine = slice(np.searchsorted(row, r), np.searchsorted(row, r, "right"))
                    where.append((at[mine] - own[r]).astype(np.uint32).tobytes())
        return pa.table({"block": pa.array([key[0].as_py()] * len(kept), pa.int64()), "text": pa.array(kept, pa.binary()), "samples": pa.array(where, pa.binary())})

    cand = materialize(once.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(candidates, "block bigint, text binary, samples binary"), "candidates")
    release_shuffles(docs.sparkSession)

    def starts(text: bytes, samples: bytes) -> np.ndarray:
        """Starts that may be repeated: less than a period before a repeated sample, with ``length`` bytes left."""
        s = np.frombuffer(samples, np.uint32).astype(np.int64)
        n = len(text) - length + 1
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.minimum(np.maximum(s - period + 1, 0), n), 1)
        np.add.at(edge, np.minimum(s + 1, n), -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    n_starts = 4 * sums["b"] // 10  # only sets the number of buckets
    start_buckets = max(1, math.ceil(n_starts / BUCKET_NAMES / 2))

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, out = _hasher(), _Outbox(start_buckets, "uint64")
        for b in batches:
            for block, text, samples in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = starts(text, samples)
                out.add(np.full(len(at), block), hasher.windows(hasher.sums(np.frombuffer(text, np.uint8)), at, length))
                if out.held > HELD_NAMES:
                    yield from out.flush()
        yield from out.flush()

    alone = materialize(_neighbours(cand.mapInArrow(remaining, _SENT), "uint64", False), "single-starts")
    release_shuffles(docs.sparkSession)

    def cut(key, texts: pa.Table, single: pa.Table) -> pa.Table:
        hasher = _hasher()
        names = [np.frombuffer(n, np.uint64) for n in single.column("names").to_pylist()]
        unique = np.sort(np.concatenate(names)) if names else np.zeros(0, np.uint64)
        out = []
        for text, samples in zip(texts.column("text").to_pylist(), texts.column("samples").to_pylist(), strict=True):
            at = starts(text, samples)
            if len(at) and len(unique):
                h = hasher.windows(hasher.sums(np.frombuffer(text, np.uint8)), at, length)
                j = np.minimum(np.searchsorted(unique, h), len(unique) - 1)
                at = at[unique[j] != h]
            edge = np.zeros(len(text) + 1, np.int32)
            edge[at] += 1
            np.add.at(edge, at + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            data = np.frombuffer(text, np.uint8)
            out.append((hashlib.sha256(text).digest(), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("sha", "n_removed", "n_spans", "kept"), cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)})

    done = cand.groupBy("block").cogroup(alone.groupBy("block")).applyInArrow(cut, "sha binary, n_removed bigint, n_spans bigint, kept string")
    done = done.groupBy("sha").agg(F.max("n_removed").alias("n_removed"), F.max("n_spans").alias("n_spans"), F.max("kept").alias("kept"))
    result = materialize(text.join(done, "sha", "left").filter("copies > 1 or n_removed > 0"), "removed")
    whole = F.col("copies") > 1
    return rows.join(result, "sha", "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"))
