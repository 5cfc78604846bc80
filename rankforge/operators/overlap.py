"""Text-overlap metrics between a prediction and a reference text per row: ROUGE-1/2/L/Lsum, BLEU-4.

N-gram overlap is relational: explode n-grams with counts per (row, side), equi join on
(row, gram) and sum ``least(count_pred, count_ref)`` -- partial aggregation everywhere. ``rouge`` scores the texts of a key together instead.
The longest common subsequence (ROUGE-L / Lsum) is a per-row dynamic programme; it runs in an
Arrow-batched pandas UDF, bit-parallel: a table row is one integer of as many bits as the text has tokens.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bleu_tokens, ngrams, rouge_tokens


def _f1(p, r):
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def ngram_counts(df: DataFrame, key: str, tokens_col: str, n: int, side: str) -> DataFrame:
    """``(key, side, n, gram, cnt)``"""
    return df.select(key, F.explode(ngrams(F.col(tokens_col), n)).alias("gram")) \
        .groupBy(key, "gram").agg(F.count("*").alias("cnt")) \
        .select(key, F.lit(side).alias("side"), F.lit(n).alias("n"), "gram", "cnt")


def clipped_overlap(toks: DataFrame, key: str, n: int, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """``(key, overlap, pred_total, ref_total)`` for order ``n`` (totals = number of n-grams)."""
    a = ngram_counts(toks, key, pred, n, "pred").select(key, "gram", F.col("cnt").alias("ca"))
    b = ngram_counts(toks, key, ref, n, "ref").select(key, "gram", F.col("cnt").alias("cb"))
    ov = a.join(b, [key, "gram"]).groupBy(key).agg(F.sum(F.least("ca", "cb")).alias("overlap"))
    tot = toks.select(key, F.greatest(F.size(pred) - n + 1, F.lit(0)).alias("pred_total"),
                      F.greatest(F.size(ref) - n + 1, F.lit(0)).alias("ref_total"))
    return tot.join(ov, key, "left").select(key, F.coalesce("overlap", F.lit(0)).alias("overlap"), "pred_total", "ref_total")


def rouge_n(df: DataFrame, key: str, pred: str, ref: str, orders=(1, 2)) -> DataFrame:
    """ROUGE-N F1 per row (no stemming); precision / recall divide by max(total, 1)."""
    toks = df.select(key, rouge_tokens(F.col(pred)).alias("pred"), rouge_tokens(F.col(ref)).alias("ref"))
    out = toks.select(key)
    for n in orders:
        o = clipped_overlap(toks, key, n)
        p = F.col("overlap") / F.greatest(F.col("pred_total"), F.lit(1))
        r = F.col("overlap") / F.greatest(F.col("ref_total"), F.lit(1))
        out = out.join(o.select(key, _f1(p, r).alias(f"rouge{n}")), key)
    return out


# ---- per-row LCS helpers: bit-parallel rows in Python integers ----

def _masks(tokens) -> dict:
    """Bit j of a token's mask: it stands at place j."""
    out: dict = {}
    for j, t in enumerate(tokens):
        out[t] = out.get(t, 0) | 1 << j
    return out


def _next_row(row: int, mask: int, full: int) -> int:
    """One row of the LCS table, as bits: a zero at j where the length grows from j to j + 1."""
    both = row & mask
    return ((row + both) | (row - both)) & full


def lcs_len(a, b) -> int:
    """Length of the longest common subsequence: one row of ``len(b)`` bits per token of ``a``."""
    masks, full = _masks(b), (1 << len(b)) - 1
    row = full
    for t in a:
        m = masks.get(t)
        if m is not None:
            row = _next_row(row, m, full)
    return len(b) - row.bit_count()


def _lcs_indices(ref, cand):
    """Positions in ``ref`` of one LCS with ``cand``: going back through the table, a match is taken, else the row before if it has the
    greater length, else the column before.

    Only every s-th row of bits is kept, s about the root of the number of rows; rows between are made again from there, so memory is
    about 2 * s rows of bits."""
    n, m = len(ref), len(cand)
    masks, full = _masks(cand), (1 << m) - 1
    step = max(1, int(n ** 0.5))
    row, kept = full, [full]
    for i, t in enumerate(ref, 1):
        row = _next_row(row, masks.get(t, 0), full)
        if i % step == 0:
            kept.append(row)
    i, j, out, first, rows = n, m, [], n + 1, []
    while i > 0 and j > 0:
        if i < first:
            first = (i - 1) // step * step + 1  # rows first .. first + step - 1
            rows, row = [], kept[first // step]
            for t in ref[first - 1:min(n, first + step - 1)]:
                row = _next_row(row, masks.get(t, 0), full)
                rows.append(row)
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif not rows[i - first] >> (j - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _tok(s):
    import re

    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", (s or "").lower())) if t]


def _fscore(hits, n_pred, n_ref):
    if n_pred == 0 or n_ref == 0:
        return 0.0
    p, r = hits / n_pred, hits / n_ref
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def rouge_lsum_row(pred: str, ref: str) -> float:
    """Summary-level LCS over newline-separated sentences (union of per-sentence LCS hits)."""
    rs = [_tok(s) for s in (ref or "").split("\n")]
    cs = [_tok(s) for s in (pred or "").split("\n")]
    rs, cs = [s for s in rs if s], [s for s in cs if s]
    m, n = sum(map(len, rs)), sum(map(len, cs))
    if m == 0 or n == 0:
        return 0.0
    cnt_r = Counter(t for s in rs for t in s)
    cnt_c = Counter(t for s in cs for t in s)
    hits = 0
    for r in rs:
        union = sorted(set(i for c in cs for i in _lcs_indices(r, c)))
        for i in union:
            t = r[i]
            if cnt_c[t] > 0 and cnt_r[t] > 0:
                hits += 1
                cnt_c[t] -= 1
                cnt_r[t] -= 1
    return _fscore(hits, n, m)


@F.pandas_udf(T.LongType())
def lcs_length_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_len(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b)],
                     dtype="int64")


_ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n)), strict=False))


def _rouge_of_key(texts: list[dict]) -> list[dict]:
    """Scores of the rows of one key (mostly one); n-grams are counted over all of them, as ``clipped_overlap`` does."""
    out = [{} for _ in texts]
    for x in texts:
        x["p"], x["r"] = x["tp"].split(), x["tr"].split()
    for n in (1, 2):
        a, b = (sum((_grams(x[side], n) for x in texts[1:]), _grams(texts[0][side], n)) for side in ("p", "r"))
        both = sum((a & b).values())
        for x, o in zip(texts, out, strict=True):
            p, r = (both / max(len(x[side]) - n + 1, 1) for side in ("p", "r"))
            o[f"rouge{n}"] = 2.0 * p * r / (p + r) if p + r > 0 else 0.0
    for x, o in zip(texts, out, strict=True):
        lcs = lcs_len(x["p"], x["r"])
        p, r = lcs / max(len(x["p"]), 1), lcs / max(len(x["r"]), 1)
        o["rougeL"] = 2.0 * p * r / (p + r) if p + r > 0 else 0.0
        o["rougeLsum"] = rouge_lsum_row(x["pred"], x["ref"])
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in _ROUGE])))
def _rouge_udf(texts: pa.Array) -> pa.Array:
    return pa.array([_rouge_of_key(t) for t in texts.to_pylist()], pa.list_(pa.struct([(c, pa.float64()) for c in _ROUGE])))


def rouge(df: DataFrame, key: str, pred: str, ref: str) -> DataFrame:
    """rouge1, rouge2, rougeL, rougeLsum F1 per row.

    The texts go to their key once and are scored there, instead of a row an n-gram. Rows that repeat a key share their n-grams and
    meet each other, as in the joins of ``rouge_n``; rows without a key are dropped, as there."""
    text = lambda c: F.array_join(rouge_tokens(F.col(c)), " ")
    rows = df.filter(F.col(key).isNotNull()).select(key, F.struct(F.col(pred).alias("pred"), F.col(ref).alias("ref"), text(pred).alias("tp"), text(ref).alias("tr")).alias("_t"))
    s = rows.groupBy(key).agg(F.collect_list("_t").alias("_t")).select(key, _rouge_udf("_t").alias("_s"))
    for c in ("rouge1", "rouge2"):
        s = s.select("*", F.explode(f"_s.{c}").alias(c))
    s = s.select("*", F.explode("_s").alias("_l")).select("*", F.explode(F.sequence(F.lit(1), F.size("_s"))).alias("_again"))
    return s.select(key, "rouge1", "rouge2", F.col("_l.rougeL").alias("rougeL"), F.col("_l.rougeLsum").alias("rougeLsum"))


def bleu(df: DataFrame, key: str, pred: str, ref: str, max_order: int = 4) -> DataFrame:
    """Sentence BLEU-4 per row, no smoothing: geometric mean of clipped n-gram precisions (0 if
    any is 0) times the brevity penalty ``exp(1 - r/c)`` when ``c <= r``; empty -> 0."""
    toks = df.select(key, bleu_tokens(F.col(pred)).alias("pred"), bleu_tokens(F.col(ref)).alias("ref"))
    out = toks.select(key, F.size("pred").alias("c"), F.size("ref").alias("r"))
    logs = []
    for n in range(1, max_order + 1):
        o = clipped_overlap(toks, key, n).select(
            key, F.when(F.col("pred_total") > 0, F.col("overlap") / F.col("pred_total")).otherwise(F.lit(0.0)).alias(f"p{n}"))
        out = out.join(o, key)
        logs.append(f"p{n}")
    minp = F.least(*[F.col(c) for c in logs])
    geo = F.when(minp > 0, F.exp(sum(F.log(F.col(c)) for c in logs) / F.lit(float(max_order)))).otherwise(F.lit(0.0))
    bp = F.when(F.col("c") > F.col("r"), F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - F.col("r") / F.nullif(F.col("c"), F.lit(0))))
    return out.select(key, F.when((F.col("c") == 0) | (F.col("r") == 0), F.lit(0.0)).otherwise(geo * bp).alias("bleu"))
