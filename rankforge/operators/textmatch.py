"""Exact substring containment between a large text table and a pattern table, by an index of word windows.

``contains_matches`` returns every (doc, pattern) pair where the document's text contains the pattern verbatim -- the rows of the
theta join ``contains(doc, pattern)`` -- with equi joins only:

1. *Windows.* All words of a pattern but the first and the last (which may be parts of a document's words) stand in a matching text as whole words. Each
   pattern is cut to windows of three such words, of one word if it has fewer, or of characters if it has none.
2. *Rarity.* One pass over the documents counts the patterns' windows (partial aggregation: a window found everywhere costs a row per
   task). A pattern with a window that no document has cannot match; the others are keyed by their rarest window.
3. *Join.* A second pass joins the documents' windows to those keys by hash.
4. *Confirm.* ``contains`` decides on the texts of the joined pairs.

All of it runs in DataFrame operations; nothing is collected but which kinds of windows are needed, and AQE broadcasts a side by its measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Kinds of windows, the most selective first: what the text is split at, tokens of a window, and whether a pattern's end tokens may be parts of words.
KINDS = {"words3": (r"\s+", 3, True), "words1": (r"\s+", 1, True),
         **{f"chars{n}": ("", n, False) for n in (8, 4, 2, 1)}}


def _windows(tokens: str, width: int) -> Column:
    """Hashes of all runs of ``width`` entries of an array column."""
    t = F.col(tokens)
    if width == 1:
        return F.transform(t, lambda x: F.xxhash64(x))
    n = F.size(t) - (width - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(t, i + k) for k in range(width)]))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _kind(words: Column, text: Column) -> Column:
    inner, length = F.size(words) - 2, F.length(text)
    out = F.when(inner >= 3, "words3").when(inner >= 1, "words1")
    for n in (8, 4, 2, 1):
        out = out.when(length >= n, f"chars{n}")
    return out.otherwise("empty")


def _candidates(docs: DataFrame, pats: DataFrame, kind: str) -> DataFrame:
    """``(_d, _p)``: documents that hold the rarest window of a pattern of this kind."""
    at, width, parts = KINDS[kind]
    own = F.split("_s", at)
    own = F.slice(own, F.lit(2), F.size(own) - 2) if parts else own
    split = pats.filter(F.col("_kind") == kind).select("_p", own.alias("_w"))
    windows = materialize(split.select("_p", F.explode(F.array_distinct(_windows("_w", width))).alias("_h")), "pattern-windows")
    held = docs.select("_d", F.split("_t", at).alias("_w")).select("_d", F.explode(_windows("_w", width)).alias("_h"))
    seen = held.join(windows.select("_h").distinct(), "_h").groupBy("_h").agg(F.count("*").alias("_n"))
    key = windows.join(seen, "_h", "left").groupBy("_p").agg(F.min_by("_h", F.struct("_n", "_h")).alias("_h"), F.count_if(F.col("_n").isNull()).alias("_missing"))
    key = materialize(key.filter("_missing = 0").select("_p", "_h"), "pattern-keys")
    return held.join(key, "_h").select("_d", "_p").distinct()


def contains_matches(docs: DataFrame, doc_id: str, doc_text: str,
                     patterns: DataFrame, pat_id: str, pat_text: str,
                     out_doc: str = "doc_id", out_pat: str = "pattern_id") -> DataFrame:
    """All (doc, pattern) pairs with ``contains(doc_text, pat_text)``, one per pair of rows.

    NULL texts and NULL ids never match; an empty pattern is in every text. Rows that repeat an id match by their own texts."""
    src = docs.select(F.col(doc_id).cast("long").alias("_d"), F.col(doc_text).alias("_t")).filter("_d is not null and _t is not null")
    pats = patterns.select(F.col(pat_id).cast("long").alias("_p"), F.col(pat_text).alias("_s")).filter("_p is not null and _s is not null")
    pats = materialize(pats.withColumn("_kind", _kind(F.split("_s", r"\s+"), F.col("_s"))), "patterns")
    kinds = {r["_kind"] for r in pats.select("_kind").distinct().collect()}  # seven at most
    pairs = docs.sparkSession.createDataFrame([], "_d long, _p long")
    for kind in KINDS:
        if kind in kinds:
            pairs = pairs.unionByName(_candidates(src, pats, kind))
    found = src.join(pairs.distinct(), "_d").join(pats.select("_p", "_s"), "_p").filter(F.contains("_t", "_s")).select("_d", "_p")
    if "empty" in kinds:
        whole = pats.filter("_kind = 'empty'").select("_p", F.lit(0).alias("_k"))
        found = found.unionByName(src.select("_d", F.lit(0).alias("_k")).join(whole, "_k").select("_d", "_p"))
    return found.select(F.col("_d").alias(out_doc), F.col("_p").alias(out_pat))
