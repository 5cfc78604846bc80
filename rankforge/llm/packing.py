"""Best-fit packing with certified bin counts.

Texts become token ids, ids are cut into pieces of at most ``size``; full pieces are sequences of their own.
The others are dealt to partitions of bounded size, each packed by best-fit decreasing. Dual feasible functions
give a lower bound for the partition's bins: a partition that meets its bound is certified, a partition with a gap
gives up the pieces of its bins that are not full, every partition those of its emptiest bin, and these are dealt anew and packed again.
A round is taken only if it lowers the number of sequences.

Only lengths are shuffled, never texts or ids; rows are dealt by a row number, so equal ids do not meet."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_state

END = 2
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Entries of a worker's table of known words; beyond it, and with every task, the table starts anew (a bound on memory only).
KNOWN_WORDS = 400_000


class WordTable(dict):
    """Number of each word seen; new words wait in ``fresh`` to be encoded together. -1: not a unit by itself."""

    def __init__(self, prefix: str, owner: TextEncoder):
        super().__init__()
        self.prefix, self.owner = prefix, owner

    def __missing__(self, w: str) -> int:
        # blanks next to the separating blank would belong to one unit with it
        n = -1 if not w or w[0].isspace() or w[-1].isspace() else self.owner.reserve(self.prefix + w)
        self[w] = n
        return n


class TextEncoder:
    """Ids of whole texts. The tokenizer's own rule always cuts before a single blank between two non-blanks, so
    texts are split there and each distinct word is encoded once; any other text goes to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        # bytes of each id: a byte-level piece has a character for every byte
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        self.size[list(vocab.values())] = [len(p) for p in vocab]
        self.reset()

    def reset(self) -> None:
        self.first, self.rest = WordTable("", self), WordTable(" ", self)
        self.fresh: list[str] = []
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def reserve(self, unit: str) -> int:
        self.fresh.append(unit)
        return len(self.at) - 2 + len(self.fresh)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and how many each has. Units that begin with the separating blank are cut apart by the tokenizer's own
        rule, so they are encoded as one text and told apart by their bytes; the others go in a call of their own."""
        marked = np.array([u[:1] == " " for u in units], bool)
        ids, lens = np.zeros(0, np.uint32), np.zeros(len(units), np.int64)
        parts = []
        if marked.any():
            own = [u for u in units if u[:1] == " "]
            run = np.array(self.tok.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(u.encode()) for u in own])
            lens[marked] = np.diff(np.searchsorted(np.cumsum(self.size[run]), ends, "right"), prepend=0)
            parts.append((np.repeat(np.flatnonzero(marked), lens[marked]), run))
        if not marked.all():
            e = self.tok.encode([u for u in units if u[:1] != " "], is_pretokenized=True, add_special_tokens=False)
            lens[~marked] = np.bincount(np.array(e.word_ids, np.int64), minlength=int((~marked).sum()))
            parts.append((np.repeat(np.flatnonzero(~marked), lens[~marked]), np.array(e.ids, np.uint32)))
        if parts:
            owner, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids = ids[np.argsort(owner, kind="stable")]
        return ids, lens

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, without an end."""
        if len(self.at) > KNOWN_WORDS:
            self.reset()
        numbers: list[np.ndarray | None] = []
        for x in texts:
            words = x.split(" ")
            n = np.fromiter(map(self.rest.__getitem__, words), np.int64, len(words))
            n[0] = self.first[words[0]]
            numbers.append(n if x and n.min() >= 0 else None)
        if self.fresh:
            ids, lens = self._encode(self.fresh)
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lens)])
            self.fresh = []
        for x, n in zip(texts, numbers, strict=True):
            if n is None:
                yield np.array(self.tok.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.uint32) if x else np.zeros(0, np.uint32)
                continue
            lens = self.at[n + 1] - self.at[n]
            ends = np.cumsum(lens)
            yield self.flat[np.arange(ends[-1]) + np.repeat(self.at[n] - ends + lens, lens)]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens; only the first may be shorter when there are several."""
    if n <= size:
        return [(0, n)]
    head = n % size
    out = [(0, head)] if head else []
    return out + [(a, size) for a in range(head, n, size)]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024) -> DataFrame:
    """Rows ``PIECE``: the pieces of every document, ids ending in ``END``. A NULL text is empty (one token)."""
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_state(("encoder", tokenizer_path), lambda: TextEncoder(tokenizer_path))
        enc.reset()
        try:
            yield from cut_up(enc, batches)
        finally:
            enc.reset()  # the worker lives on, for other work

    def cut_up(enc: TextEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    raw = np.append(ids, np.uint32(END)).astype("<u4").tobytes()
                    rows += [(doc, k, a, n, zlib.crc32(raw[4 * a:4 * (a + n)])) for k, (a, n) in enumerate(cut(len(raw) // 4, size))]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenize, PIECE)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that any packing needs, for ``counts[n]`` items of length n: the best of two families of dual
    feasible functions (thresholds, and the roundings to multiples of 1/k)."""
    n = np.arange(len(counts))
    total = int((n * counts).sum())
    best = -(-total // size)
    for t in range(1, size // 2 + 1):
        w = np.where(n > size - t, size, np.where(n >= t, n, 0))
        best = max(best, -(-int((w * counts).sum()) // size))
    for k in range(2, 21):
        whole = (k + 1) * n % size == 0
        w = np.where(whole, n * k, (k + 1) * n // size * size)  # in units of 1 / (size * k)
        best = max(best, -(-int((w * counts).sum()) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item and the fill of every bin: longest first, each into the fullest bin it fits."""
    order = np.argsort(-lengths, kind="stable")
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    open_bits, fill = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        fits = open_bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_bits &= ~(1 << free)
        else:
            b, free = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = free - n
        if left:
            by_free[left].append(b)
            open_bits |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _pack_round(rows: DataFrame, parts: int, size: int, round_no: int) -> DataFrame:
    """Rows with ``sequence_id``, ``offset``, ``fill`` of the bin, the partition's bins ``part_bins`` and their lower bound ``part_bound``, and ``last``
    (the emptiest bin of the partition)."""
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid")
        lengths = part["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, size)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        return part.assign(sequence_id=(np.int64(round_no) << 56) + (part["part"].to_numpy().astype(np.int64) << 28) + bins, offset=offsets,
                           fill=fill[bins], part_bins=np.int64(len(fill)), part_bound=np.int64(bound), last=bins == int(np.argmin(fill)))
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(round_no)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, f"{cols}, part bigint, sequence_id bigint, offset bigint, fill bigint, part_bins bigint, part_bound bigint, last boolean")


def pack(rows: DataFrame, size: int = 1024, part_rows: int = 40_000, rounds: int = 3) -> DataFrame:
    """``rows`` (with ``length`` from 1 to ``size``) plus ``sequence_id``, ``offset``, ``part_bins`` and ``part_bound``: the sequences of the
    partition that packed the row last, and how many any packing of that partition needs. Equal numbers certify the partition; after ``rounds``
    rounds partitions may be left with a gap, which the two columns show. Empty input gives no rows."""
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    keep = rows.columns
    own = [*keep, "sequence_id", "offset", "part_bins", "part_bound"]
    done = [rows.filter(F.col("length") == size).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("long"))
            .withColumn("part_bins", F.lit(1).cast("long")).withColumn("part_bound", F.lit(1).cast("long")).select(*own)]
    pool = rows.filter(F.col("length") < size)
    before = None
    for k in range(rounds):
        n = pool.count()
        if n == 0:
            break
        now = materialize(_pack_round(pool, max(1, math.ceil(n / part_rows)), size, k + 1), f"packed-{k}")
        if before is not None:
            a, b = (x.agg(F.count_distinct("sequence_id")).head()[0] for x in (now, before))
            if a >= b:  # no gain: the earlier packing of these pieces stands
                done.append(before.select(*own))
                before = None
                break
        if k + 1 == rounds or now.select("part").distinct().count() == 1:
            done.append(now.select(*own))
            before = None
            break
        open_bin = (F.col("fill") < size) & ((F.col("part_bins") > F.col("part_bound")) | F.col("last"))
        done.append(now.filter(~open_bin).select(*own))
        before = now.filter(open_bin)
        pool = before.select(*keep)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("rid")


def packed_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, **params) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound.

    A NULL or empty text is one token, the end; long texts are cut whole, whatever their length. Rows that repeat an id or a text are documents of
    their own and packed by themselves. Lengths tie by row. Other columns of ``docs`` are not read; an empty table gives no rows."""
    return pack(pieces(docs, tokenizer_path, id_col, text_col, size), size, **params)


def certificate(packed: DataFrame, size: int = 1024) -> DataFrame:
    """One row: how many sequences ``packed`` has, how many any packing of its lengths needs at least, and the gap between the two."""
    counts = np.zeros(size + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # at most ``size`` rows
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts, size)
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))
