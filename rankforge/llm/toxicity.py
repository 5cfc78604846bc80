"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities: of a lexicon and its word stems learned from the labelled training rows, of
lexicon words near a second-person word, of capitals, exclamation and question marks, and of obfuscated
words (digits or signs inside letters, also those that read as a lexicon word when undone). The fit reads
at most ``common.FIT_ROWS`` labelled training rows for the lexicon and ``max_rows`` of these for the trees and the calibration, both
drawn by a hash of the id (documented bounds: the model does not grow with the data). Scores cover every whole text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_remainder, labelled_sample, materialize

#: Second-person words of the four languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tuyo tus su".split())
#: Signs read as letters when a word is obfuscated (fixed values).
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
FEATURES = ("lexicon", "lexicon_rate", "stems", "stem_rate", "near_you", "strongest", "obfuscated", "undone", "capitals", "shouting", "marks", "log_words", "distinct_hits")
#: Lengths of the word stems.
STEMS = (4, 5)
_WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*|[^\W_]*[@$*][^\s]*", re.UNICODE)
_MASKED = re.compile(r"(?=.*[a-z])(?=.*[0-9@$!*])")


def words_of(text: str) -> list[str]:
    return [w.strip("!*$@") or w for w in _WORD.findall(text)]


def lexicon_counts(rows: DataFrame) -> DataFrame:
    """``(term, _y, n)``: in how many labelled training texts a word or stem occurs (stems end in ``~``)."""
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def terms(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            w = {y.lower() for y in words_of(x or "")}
            out.append(sorted(w | {y[:k] + "~" for k in STEMS for y in w if len(y) > k}))
        return pa.array(out, pa.list_(pa.string()))

    return rows.select("_y", F.explode(terms("text")).alias("term")).groupBy("term").agg(
        F.sum("_y").alias("n1"), F.sum(1 - F.col("_y")).alias("n0"))


def learn_lexicon(rows: DataFrame, size: int = 2000, least: int = 5, odds: float = 3.0) -> dict[str, float]:
    """Terms whose smoothed log odds for label 1 are at least ``odds``, the ``size`` heaviest by evidence. Only
    these leave the cluster."""
    total = rows.groupBy("_y").count().collect()
    n = {r["_y"]: r["count"] for r in total}
    n1, n0 = n.get(1, 0) + 1, n.get(0, 0) + 1
    w = F.log((F.col("n1") + 0.1) / n1) - F.log((F.col("n0") + 0.1) / n0)
    top = lexicon_counts(rows).filter(F.col("n1") >= least).withColumn("w", w).filter(F.col("w") >= odds) \
        .orderBy((F.col("n1") * F.col("w")).desc(), "term").limit(size).collect()
    return {r["term"]: float(r["w"]) for r in top}


def feature_rows(texts: list[str | None], lexicon: dict[str, float]) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    own = {k for k in lexicon if not k.endswith("~")}
    stems = {k[:-1] for k in lexicon if k.endswith("~")}
    for i, x in enumerate(texts):
        if not x:
            continue
        raw = _WORD.findall(x)
        low = [w.lower() for w in raw]
        n = max(len(low), 1)
        distinct = set(low)
        hits = [k for k, w in enumerate(low) if w in own or w.strip("!*$@") in own] if not own.isdisjoint(distinct) or "*" in x or "!" in x else []
        stem = sum(w[:4] in stems or w[:5] in stems for w in low)
        masked = [w for w in distinct if _MASKED.match(w)]
        undone = sum(w.translate(UNMASK) in own for w in masked)
        near = 0
        if hits and not SECOND_PERSON.isdisjoint(distinct):
            near = sum(any(w in SECOND_PERSON for w in low[max(0, k - 4):k + 5]) for k in hits)
        caps = sum(map(str.isupper, x)) if x.lower() != x else 0
        shout = sum(len(w) > 2 and w.isupper() for w in raw) if caps > 2 else 0
        out[i] = (len(hits), 100 * len(hits) / n, stem, 100 * stem / n, near, max((lexicon.get(low[k].strip("!*$@"), 0.0) for k in hits), default=0.0),
                  100 * len(masked) / n, undone, 100 * caps / max(len(x), 1), 100 * shout / n, 100 * (x.count("!") + x.count("?")) / n, np.log1p(len(low)),
                  len({low[k] for k in hits}))
    return out


@dataclass
class BoostedTrees:
    """Regression trees of depth ``depth`` as heap arrays, plus the knots of the isotonic calibration."""
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rate: float
    knots: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        m = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            m += self.rate * leaf[node - len(feature)]
        return m

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        m = self.margin(x)
        return np.clip(np.interp(m, self.knots, self.values), 0, 1) if len(self.knots) else 1 / (1 + np.exp(-m))


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: float):
    """One tree on histogram bins: at every node the feature and cut with the largest gain."""
    inner = 2 ** depth - 1
    feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2 ** depth)
    node = np.zeros(len(x), np.int64)
    for k in range(inner):
        own = np.flatnonzero(node == k)
        best = 1e-9
        for f in range(x.shape[1]):
            if len(cuts[f]) == 0 or len(own) == 0:
                continue
            gs, hs = (np.bincount(bins[own, f], w[own], len(cuts[f]) + 1) for w in (g, h))
            gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
            gr, hr = gs.sum() - gl, hs.sum() - hl
            gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - gs.sum() ** 2 / (hs.sum() + l2)
            gain[(hl < least) | (hr < least)] = 0
            j = int(np.argmax(gain))
            if gain[j] > best:
                best, feature[k], cut[k] = gain[j], f, cuts[f][j]
        node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
    for j in range(len(leaf)):
        own = node == inner + j
        leaf[j] = -g[own].sum() / (h[own].sum() + l2) if own.any() else 0.0
    return feature, cut, leaf


def isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of label on margin; equal margins are pooled first."""
    blocks: list[list[float]] = []
    for m, k, s in zip(*np.unique(margin, return_counts=True), np.bincount(np.unique(margin, return_inverse=True)[1], y), strict=True):
        blocks.append([s, k, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s2, k2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + k2, blocks[-1][2], hi]
    mean = y.mean() if len(y) else 0.5
    knots = [v for b in blocks for v in (b[2], b[3])]
    values = [(b[0] + prior * mean) / (b[1] + prior) for b in blocks for _ in (0, 1)]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, l2: float = 1.0, n_bins: int = 64, least: float = 4.0) -> BoostedTrees:
    """Logistic boosting; both sides of a split carry a weight of ``least``, so that a few wrong labels make no leaf. Every fifth row is kept back for the calibration. Without rows of both labels the score is
    the smoothed share of label 1."""
    n1 = float(y.sum())
    share = (n1 + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) < 10 or n1 in (0, len(y)):
        return BoostedTrees(base, [], rate, np.zeros(0), np.zeros(0))
    back = np.arange(len(y)) % 5 == 4
    tx, ty = x[~back], y[~back]
    cuts = [np.unique(np.quantile(tx[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.quantile(p, [0.25, 0.5, 0.75])])) if len(p := tx[tx[:, f] > 0, f]) else c for f, c in enumerate(cuts)]
    cuts = [np.unique(np.concatenate([[0.0], c])) for c in cuts]
    bins = np.column_stack([np.searchsorted(c, tx[:, f], "left") for f, c in enumerate(cuts)])
    m, trees = np.full(len(ty), base), []
    model = BoostedTrees(base, trees, rate, np.zeros(0), np.zeros(0))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        t = _tree(tx, bins, cuts, p - ty, np.maximum(p * (1 - p), 1e-6), depth, l2, least)
        trees.append(t)
        m += BoostedTrees(0.0, [t], rate, np.zeros(0), np.zeros(0)).margin(tx)
    model.knots, model.values = isotonic(model.margin(x[back]), y[back])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, mod: int, held: int, max_rows: int, **params):
    """Lexicon and model from the labelled rows whose id remainder is not the held-out one."""
    y = labelled_sample(labels, id_col, label, mod, held)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(y, F.col("doc_id") == F.col("_lid")).select("doc_id", "text", "_y")
    rows = materialize(rows, "toxicity-rows")
    lexicon = learn_lexicon(rows)
    feats = rows.select("doc_id", "_y", features(lexicon)("text").alias("f"))
    got = feats.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("_y", "f").toPandas()
    x = np.array(got["f"].tolist(), float).reshape(len(got), len(FEATURES))
    return lexicon, boost(x, got["_y"].to_numpy(float), **params)


def features(lexicon: dict[str, float]):
    """Column function: text -> array of features."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def compute(texts: pa.Array) -> pa.Array:
        x = feature_rows(texts.to_pylist(), lexicon)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
    return compute


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
                    mod: int = 5, held: int = 0, max_rows: int = 20_000, threshold: float = 0.5, **params) -> DataFrame:
    """Per document: id, ``held_out``, ``score`` (calibrated probability), ``predicted``.

    One row per input row: repeated rows have equal scores; a NULL text counts as an empty one, a NULL id has the remainder of
    the empty text and no label. Very long texts are read whole. A repeated id with a label trains once per row; of
    conflicting labels the larger counts, NULL labels and ids are left out. Without labels every score is 0.5. An empty table gives no row;
    only the id and the text are read, so other columns may have any name."""
    lexicon, model = fit(docs, labels, id_col, text_col, label, mod, held, max_rows, **params)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(feature_rows(texts.to_pylist(), lexicon)))

    d = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("score"))
    return d.select("doc_id", (id_remainder("doc_id", mod) == held).alias("held_out"), "score").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
