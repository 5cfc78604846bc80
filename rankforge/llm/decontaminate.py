"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces; a text that contains the item within k edits
contains one piece unchanged. Pieces are found with one automaton pass, every hit is verified with Myers'
bit-parallel distance on the window it implies.

Items and texts are compared as lower-cased words joined by one blank. Items go to the tasks in blocks of bounded
size (a stated query set against all rows); more items mean more passes, never a larger broadcast. Texts are
never shuffled or cut."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a piece at least, so the budget is ``len // PIECE - 1`` edits (none below two pieces).
PIECE = 16
#: Items of a block and their characters, the bound of what is sent to the tasks at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("budget", T.IntegerType()),
                    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def budget(item: str, piece: int = PIECE) -> int:
    return max(0, len(item) // piece - 1)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length as ``(offset, piece)``; they cover the item."""
    cut = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a substring of the text and the first end where it is reached."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & full) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j
    return best, end


def best_match(item: str, text: str) -> tuple[int, int, int]:
    """Distance, start and end of the best substring: ends from the left, then starts from the right."""
    d, end = myers(item, text)
    _, back = myers(item[::-1], text[:end][::-1])
    return d, end - back, end


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE):
        import ahocorasick

        self.items = [(i, t, budget(t, piece)) for i, t in items]
        uses: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for a, s in pieces(t, k):
                uses.setdefault(s, []).append((n, a))
        self.auto = ahocorasick.Automaton()
        for s, places in uses.items():
            self.auto.add_word(s, (len(s), places))
        self.empty = not uses
        if uses:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``(item_id, distance, budget, start, end)`` in code points of ``text``: the best place of each item
        that lies within its budget, the leftmost of equals."""
        norm = normal(text)
        if self.empty or not norm:
            return []
        windows: dict[int, list[list[int]]] = {}
        for at, (size, places) in self.auto.iter(norm):
            for n, a in places:
                _, t, k = self.items[n]
                lo = at + 1 - size - a - k
                hi = lo + len(t) + 2 * k
                w = windows.setdefault(n, [])
                if w and lo <= w[-1][1] and lo >= w[-1][0]:
                    w[-1][1] = max(w[-1][1], hi)
                else:
                    w.append([lo, hi])
        out = []
        for n, spans in windows.items():
            i, t, k = self.items[n]
            best = None
            for lo, hi in spans:
                lo = max(lo, 0)
                d, s, e = best_match(t, norm[lo:hi])
                if d <= k and (best is None or (d, lo + s) < best[:2]):
                    best = (d, lo + s, lo + e)
            if best:
                out.append((i, best[0], k, *best[1:]))
        if out:
            place = _places(text)
            out = [(i, d, k, place(s), place(e - 1) + 1) for i, d, k, s, e in out]
        return sorted(out)


def _places(text: str):
    """Maps a position of the normalised text to the original. ``lower`` may change the length of a word; such a
    position maps to the word's start."""
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    same = len(text.lower()) == len(text)
    starts, at = [], 0
    for a, z in spans:
        starts.append(at)
        at += z - a + 1

    def place(p: int) -> int:
        import bisect

        n = max(0, bisect.bisect_right(starts, p) - 1)
        return min(spans[n][0] + (p - starts[n] if same else 0), len(text))
    return place


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks within the bounds. NULL and empty items match nothing; an item with a NULL id is left out."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).head()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    # twice as many blocks as needed when there are several, as hashing does not fill them evenly
    blocks = blocks if blocks == 1 else 2 * blocks
    for b in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        yield sorted({(r["i"], t) for r in got if (t := normal(r["t"]))})


def hits_column(items: list[tuple[int, str]], piece: int = PIECE):
    """Column function: text -> array of ``HIT``."""
    state: dict = {}

    @F.arrow_udf(T.ArrayType(HIT))
    def find(texts: pa.Array) -> pa.Array:
        m = state.get("m") or state.setdefault("m", Matcher(items, piece))
        names = HIT.fieldNames()
        rows = [[dict(zip(names, h, strict=True)) for h in m.find(x)] if x else [] for x in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))
    return find


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per document and item within the budget: doc_id, item_id, distance, budget, start, end (code
    points of the text, end exclusive).

    NULL and empty texts and items match nothing, items with a NULL id are left out, repeated document rows are reported once each and
    repeated items once. Long texts are searched whole; empty tables give no row, other columns may have any name."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    out = None
    for block in item_blocks(items, item_id_col, item_text_col):
        h = d.select("doc_id", F.inline(hits_column(block, piece)("_t")))
        out = h if out is None else out.unionByName(h)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item within its budget."""
    out = docs
    for block in item_blocks(items, item_id_col, item_text_col):
        out = out.filter(F.size(hits_column(block, piece)(F.col(text_col))) == 0)
    return out
