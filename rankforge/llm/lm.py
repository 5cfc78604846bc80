"""Gated recurrent language model: truncated backpropagation and scoring in numpy inside Spark tasks.

* Token counts cover all training documents. The most frequent words are the model's vocabulary, every other word is one
  class whose members share its probability by their smoothed counts, so the score is a probability over all texts.
  The vocabulary and the hidden units grow with the training tokens (``vocabulary_size``, ``width``).
* The output softmax is factored: the class of the next word, then the word within the class. Classes are runs of the
  words by falling count, short for frequent words and longer for rare ones.
* Training is data-parallel: documents are dealt by a hash to teams of some ``TEAM_TOKENS`` tokens. Every team of a round starts
  from the same weights, runs truncated backpropagation over its documents and returns its weights; these are averaged by
  tokens. Every training document is used exactly once, in one of ``rounds`` rounds. Teams depend on the rows alone, so the
  weights do not depend on partitions or the cluster's size, and a task that is run again returns the same.
* Documents run in lanes, one after the other. The state is carried from window to window and reset only where a
  document begins, so a score is the log-likelihood of the complete document and does not depend on its neighbours.

Words beyond the table that is sent to the tasks (``TABLE`` words, a bound) get their counts by a join."""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, materialize, one_thread_blas, release_shuffles

#: Words whose counts are sent to the tasks (more words get theirs by a join).
TABLE = 400_000
WINDOW, SCORE_LANES = 32, 512
#: Training tokens of a team, and tokens of an optimiser step at least.
TEAM_TOKENS, STEP_TOKENS = 2_000_000, 2048
#: Tokens of a training lane, about, between 64 and 256 lanes.
LANE_TOKENS = 8192
#: Tokens that a task holds before it runs them, and distinct words it counts before it sends them.
HELD_TOKENS, HELD_WORDS = 1_500_000, 400_000
END = b""


def vocabulary_size(n: int) -> int:
    """Words of the model for ``n`` training tokens."""
    return max(256, math.ceil(2 * n ** 0.4))


def width(n: int) -> int:
    """Hidden units for ``n`` training tokens."""
    return 3 + round(1.25 * n ** 0.125)


@functools.lru_cache(maxsize=8)
def class_cuts(own: int) -> np.ndarray:
    """First words of the classes, and ``own``: a class that begins at word n holds some 4 * sqrt(n) words."""
    cuts = [0]
    while cuts[-1] < own:
        cuts.append(min(own, cuts[-1] + max(16, math.ceil(4 * math.sqrt(cuts[-1])))))
    return np.array(cuts)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; the end is not included."""
    return text.encode().lower().split() if text else []


def token_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all documents ``(doc_id, text)``; the end is the empty word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def send():
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])
        for b in batches:
            for x in b.column(0).to_pylist():
                c.update(tokens(x))
                c[END] += 1
                if len(c) > HELD_WORDS:
                    yield send()
                    c.clear()
        yield send()

    return docs.select("text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts that leave the cluster: totals and the ``TABLE`` most frequent words; the first ``size`` are the model's."""
    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    size: int

    @property
    def rest(self) -> tuple[int, int]:
        """Tokens and distinct words outside the model's vocabulary."""
        own = min(self.size, len(self.words))
        return self.n - int(self.counts[:own].sum()), self.v - own


def vocabulary(counts: DataFrame, table: int = TABLE, size: int | None = None) -> Vocabulary:
    t = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    size = vocabulary_size(t["n"]) if size is None else size
    top = counts.orderBy(F.desc("c"), "word").limit(max(table, size)).toArrow()
    return Vocabulary([bytes(w) for w in top.column("word").to_pylist()], top.column("c").to_numpy().astype(np.int64), t["n"], t["v"], size)


def id_type(vocab: Vocabulary) -> str:
    return "<u2" if min(vocab.size, len(vocab.words)) < 1 << 16 else "<u4"


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per document: ids of the model (2 or 4 bytes a token, see ``id_type``, end included) and the sums that need counts; ``tail`` holds
    the words that are not in the table, with their number."""
    n, v = vocab.n, vocab.v
    rest_n, rest_v = vocab.rest
    table, ids_as = vocab, id_type(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = dict(zip(table.words, range(len(table.words)), strict=True))
        base = np.log10((table.counts + 1.0) / (n + v + 1))
        inner = np.log10((table.counts + 1.0) / (rest_n + rest_v + 1))
        own = min(table.size, len(index))
        inner[:own] = 0.0
        get = index.get
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for x in b.column(2).to_pylist():
                words = tokens(x)
                words.append(END)
                at = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
                known = at >= 0
                tail = Counter(words[i] for i in np.flatnonzero(~known)) if not known.all() else {}
                ids = np.where(known & (at < own), at, own).astype(ids_as)
                k = at[known]
                for c, y in zip(cols, (ids.tobytes(), len(words), int(known.sum()), float(base[k].sum()), float(inner[k].sum()),
                                       list(tail.keys()), list(tail.values())), strict=True):
                    c.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.list_(pa.binary())), pa.array(cols[6], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "ids", "n_tokens", "known", "base", "inner", "tail", "times"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        encode, "doc_id bigint, held_out boolean, ids binary, n_tokens bigint, known bigint, base double, inner double, tail array<binary>, times array<bigint>")


@dataclass
class Weights:
    x: np.ndarray    # input table, vocabulary x 3 hidden (update, reset, candidate), projection and bias included
    u: np.ndarray    # recurrent, hidden x 3 hidden
    wc: np.ndarray   # classes
    bc: np.ndarray
    wo: np.ndarray   # words
    bo: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.x, self.u, self.wc, self.bc, self.wo, self.bo]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Weights(*out)


def initial(vocab: Vocabulary, hidden: int | None = None, seed: int = 5) -> Weights:
    """Small random weights; the output biases are the log counts, so that training starts at the unigram model."""
    own = min(vocab.size, len(vocab.words))
    hidden = width(vocab.n) if hidden is None else hidden
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    c = vocab.counts[:own].astype(float)
    cuts = class_cuts(own)
    classes = len(cuts) - 1
    mass = [c[a:b].sum() + 1 for a, b in itertools.pairwise(cuts)] + [vocab.rest[0] + vocab.rest[1] + 1]
    x = small(own + 1, 3 * hidden)
    x[:, :hidden] += 1.0  # keep the state at first
    return Weights(x, small(hidden, 3 * hidden), small(hidden, classes + 1) * 0.1, np.log(np.array(mass, np.float32)),
                   small(own, hidden) * 0.1, np.log(c + 1).astype(np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(w: Weights, h: np.ndarray, before: np.ndarray, reset: np.ndarray, keep: bool):
    """States of a window. ``before`` (steps x lanes): the previous token; ``reset``: a document begins."""
    k = h.shape[1]
    states, kept, x, begins = np.empty((*before.shape, k), np.float32), [], w.x[before], reset.any(1)
    for t in range(len(before)):
        if begins[t]:
            h = h * ~reset[t][:, None]
        a, g = x[t], h @ w.u
        zr = _sigmoid(a[:, :2 * k] + g[:, :2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(a[:, 2 * k:] + r * g[:, 2 * k:])
        new = n + z * (h - n)
        if keep:
            kept.append((h, z, r, n, g[:, 2 * k:]))
        h = states[t] = new
    return states, h, kept


def _softmax(s: np.ndarray):
    """Logits, held within +-60 so that no sum overflows or is 0, their exponentials and the sums of these."""
    np.clip(s, -60, 60, out=s)
    e = np.exp(s)
    return s, e, e @ np.ones(e.shape[1], e.dtype)


def output(w: Weights, h: np.ndarray, y: np.ndarray, grad: Weights | None = None):
    """Log probabilities of the targets ``y`` given states ``h``; with ``grad`` also the gradient of minus their
    sum, added there, and the one of the states, returned."""
    own = len(w.wo)
    cuts = class_cuts(own)
    cls = np.searchsorted(cuts, y, "right") - 1  # what is no word of the model is past the last class
    s, e, total = _softmax(h @ w.wc + w.bc)
    rows = np.arange(len(y))
    logp = s[rows, cls] - np.log(total)
    dh = None
    if grad is not None:
        d = np.divide(e, total[:, None], out=e)
        d[rows, cls] -= 1
        grad.wc += h.T @ d
        grad.bc += d.sum(0)
        dh = d @ w.wc.T
    order = np.argsort(cls, kind="stable")
    cut = np.searchsorted(cls[order], np.arange(w.wc.shape[1]))
    for c in range(w.wc.shape[1] - 1):
        at = order[cut[c]:cut[c + 1]]
        if not len(at):
            continue
        lo, hi = cuts[c], cuts[c + 1]
        own_h, pick = h[at], y[at] - lo
        s, e, total = _softmax(own_h @ w.wo[lo:hi].T + w.bo[lo:hi])
        r = np.arange(len(at))
        logp[at] += s[r, pick] - np.log(total)
        if grad is not None:
            d = np.divide(e, total[:, None], out=e)
            d[r, pick] -= 1
            grad.wo[lo:hi] += d.T @ own_h
            grad.bo[lo:hi] += d.sum(0)
            dh[at] += d @ w.wo[lo:hi]
    return logp, dh


def backward(w: Weights, dstates: np.ndarray, before: np.ndarray, reset: np.ndarray, kept: list, grad: Weights) -> None:
    """Truncated backpropagation through the window."""
    k = w.u.shape[0]
    das = np.empty((*before.shape, 3 * k), np.float32)
    dh = np.zeros_like(dstates[0])
    for t in range(len(before) - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        d = dstates[t] + dh
        dn = d * (1 - z) * (1 - n * n)
        da = das[t]
        da[:, :k] = d * (h - n) * z * (1 - z)
        da[:, k:2 * k] = dn * gn * r * (1 - r)
        da[:, 2 * k:] = dn
        dg = da.copy()
        dg[:, 2 * k:] *= r
        grad.u += h.T @ dg
        dh = (d * z + dg @ w.u.T) * ~reset[t][:, None]
    flat, rows = before.ravel(), das.reshape(-1, 3 * k)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
    grad.x[flat[order[first]]] += np.add.reduceat(rows[order], first, axis=0)


def lanes(texts: list[np.ndarray], most: int) -> list[list[int]]:
    """Documents dealt to lanes of nearly equal length, longest first; lanes by falling length."""
    import heapq

    n = max(1, min(most, len(texts)))
    heap = [(0, i) for i in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for k in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, lane = heapq.heappop(heap)
        out[lane].append(k)
        heapq.heappush(heap, (size + len(texts[k]), lane))
    return sorted((x for x in out if x), key=lambda x: -sum(len(texts[i]) for i in x))


def windows(texts: list[np.ndarray], most: int, end: int):
    """``(targets, previous, reset, document)`` as steps x lanes; the lanes of a window are the first of those
    before, lanes that have ended are left out. A target of -1 fills up a lane's last window. Lanes are laid one after the
    other and windows cut from them as they are asked for, so one very long text costs its own length only."""
    own = lanes(texts, most)
    order = [i for x in own for i in x]
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    length = np.array([sum(len(texts[i]) for i in x) for x in own], np.int64)
    if not length.sum():
        return
    first = np.cumsum(length) - length
    y = np.concatenate([texts[i] for i in order]).astype(np.int32)
    doc = np.repeat(np.array(order, np.int32), sizes)
    start = np.zeros(len(y), bool)
    start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.concatenate([[end], y[:-1]]).astype(np.int32)
    before[start] = end
    step = np.arange(WINDOW)[:, None]
    for t in range(0, int(length.max()), WINDOW):
        n = int((length > t).sum())
        at = first[:n] + t + step
        real = at < (first + length)[:n]
        at = np.where(real, at, 0)
        yield np.where(real, y[at], -1), np.where(real, before[at], end), start[at] & real, doc[at]


def score_documents(w: Weights, texts: list[np.ndarray], end: int, most: int = SCORE_LANES) -> np.ndarray:
    """Natural log-likelihood of each whole document."""
    out = np.zeros(len(texts))
    h = np.zeros((min(most, max(len(texts), 1)), w.u.shape[0]), np.float32)
    for y, before, reset, doc in windows(texts, most, end):
        states, h, _ = forward(w, h[:y.shape[1]], before, reset, False)
        real = y.ravel() >= 0
        logp, _ = output(w, states.reshape(-1, h.shape[1])[real], y.ravel()[real])
        out += np.bincount(doc.ravel()[real], logp, len(texts))
    return out


def train_documents(w: Weights, texts: list[np.ndarray], end: int, moment: list | None, rate: float, most: int | None = None,
                    step: int = STEP_TOKENS):
    """One pass of truncated backpropagation with Adam; returns the weights and the optimiser's state. Gradients of windows
    add up to ``step`` tokens, so that the few lanes of long texts make no steps of their own; the rest at the end makes a
    step by its share."""
    most = max(64, min(256, sum(map(len, texts)) // LANE_TOKENS)) if most is None else most
    moment = moment or [0, np.zeros_like(w.flat()), np.zeros_like(w.flat())]
    h = np.zeros((min(most, max(len(texts), 1)), w.u.shape[0]), np.float32)
    zero = lambda: Weights(*(np.zeros_like(a) for a in w.arrays()))
    grad, n = zero(), 0

    def update(share: float) -> Weights:
        g = grad.flat() / n
        g *= min(1.0, 1.0 / (float(np.sqrt((g * g).sum())) + 1e-12))
        moment[0] += 1
        moment[1] += 0.1 * (g - moment[1])
        moment[2] += 0.01 * (g * g - moment[2])
        return w.like(w.flat() - share * rate * (moment[1] / (1 - 0.9 ** moment[0])) / (np.sqrt(moment[2] / (1 - 0.99 ** moment[0])) + 1e-6))

    for y, before, reset, _ in windows(texts, most, end):
        states, h, kept = forward(w, h[:y.shape[1]], before, reset, True)
        real = y.ravel() >= 0
        _, dh = output(w, states.reshape(-1, h.shape[1])[real], y.ravel()[real], grad)
        dstates = np.zeros((y.size, h.shape[1]), np.float32)
        dstates[real] = dh
        backward(w, dstates.reshape(states.shape), before, reset, kept, grad)
        n += int(real.sum())
        if n >= step:
            w = update(1.0)
            grad, n = zero(), 0
    return (update(n / step) if n else w), moment


def _chunks(batches: Iterator[pa.RecordBatch], column: int):
    """Batches of a task gathered to some ``HELD_TOKENS`` tokens."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes // 2
        if n >= HELD_TOKENS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


PART = 4096
_PARTS = "part int, team bigint, w binary"


def weight_rows(own: Weights, n: int, team: int) -> pa.Table:
    """A team's weights times its tokens, in parts of ``PART`` doubles. The last position is the tokens themselves, so that a
    weight and its divisor are sums over the same rows."""
    flat = np.append(own.flat().astype(np.float64) * n, n)
    parts = [flat[i:i + PART].tobytes() for i in range(0, len(flat), PART)]
    return pa.table({"part": pa.array(range(len(parts)), pa.int32()), "team": pa.array([team] * len(parts), pa.int64()), "w": pa.array(parts, pa.binary())})


def _summed(rows: DataFrame, teams: int) -> DataFrame:
    """Element-wise sums of ``w`` per part and ``team % teams``, added in the order of the teams."""
    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("team").to_numpy(), kind="stable")
        w = t.column("w").to_pylist()
        total = np.frombuffer(w[order[0]]).copy()
        for i in order[1:]:
            total += np.frombuffer(w[i])
        return pa.table({"part": t.column("part")[:1], "team": pa.array([t.column("team")[0].as_py() % teams], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy("part", (F.col("team") % teams).alias("_sum")).applyInArrow(add, _PARTS)


def team_weights(rows: DataFrame, now: Weights, end: int, rate: float, ids_as: str) -> DataFrame:
    """Trains every team of ``rows(team, doc_id, ids)`` from the weights ``now``; its documents in the order of id and words."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        one_thread_blas()
        t = t.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        texts = [np.frombuffer(x, ids_as).astype(np.int32) for x in t.column("ids").to_pylist()]
        own, _ = train_documents(now, texts, end, None, rate)
        return weight_rows(own, sum(map(len, texts)), key[0].as_py())

    return rows.groupBy("team").applyInArrow(run, _PARTS)


def train(rows: DataFrame, start: Weights, end: int, rounds: int, rate: float, teams: int, ids_as: str = "<u2") -> Weights:
    """Weights after ``rounds`` rounds over the training rows ``(doc_id, ids, turn, team)``, with ``teams`` teams a round."""
    w = start
    for k in range(rounds):
        sent = team_weights(rows.filter(F.col("turn") == k).select("team", "doc_id", "ids"), replace(w), end, rate, ids_as)
        got = _summed(_summed(sent, math.isqrt(teams) + 1), 1).orderBy("part").select("w").toArrow().column(0).to_pylist()
        if got:
            total = np.frombuffer(b"".join(got))
            w = start.like(total[:-1] / total[-1])
    return w


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2, rounds: int = 3, rate: float = 0.02,
              size: int | None = None, table: int = TABLE) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from documents whose id remainder is not ``held``; a NULL or empty text is its end alone. Without
    training documents every word has the probability of an unseen one. Repeated rows count as often as they occur, NULL ids have the
    remainder of the empty text; words with equal counts are ordered by their bytes; a long text is scored whole. Only the id and the text are
    read, so other columns may have any name. The vocabulary and the width follow the training tokens unless ``size`` is given."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", id_remainder("doc_id", mod) == held)
    counts = materialize(token_counts(d.filter(~F.col("held_out"))), "counts")
    release_shuffles(docs.sparkSession)
    vocab = vocabulary(counts, table, size)
    teams = max(1, math.ceil(vocab.n / rounds / TEAM_TOKENS))
    dealt = F.xxhash64(F.lit(0x5EED), "doc_id", "ids")  # repeated ids and repeated texts are dealt too
    rows = encoded(d, vocab).withColumn("rid", F.monotonically_increasing_id()).withColumn("turn", F.pmod(dealt, F.lit(rounds)).cast("int")) \
        .withColumn("team", F.pmod(F.xxhash64(dealt), F.lit(teams)))
    rows = materialize(rows, "encoded")
    own, ids_as = min(vocab.size, len(vocab.words)), id_type(vocab)
    end = vocab.words.index(END) if END in vocab.words[:own] else own
    weights = train(rows.filter(~F.col("held_out")), initial(vocab), end, rounds, rate, teams, ids_as)
    n, v = vocab.n, vocab.v
    rest_n, rest_v = vocab.rest

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread_blas()
        for t in _chunks(batches, 0):
            texts = [np.frombuffer(x, ids_as).astype(np.int32) for x in t.column(0).to_pylist()]
            t = t.drop_columns("ids").append_column("own", pa.array(score_documents(weights, texts, end) / math.log(10)))
            yield from t.combine_chunks().to_batches()

    model = rows.select("ids", "rid", "doc_id", "held_out", "n_tokens", "known", "base", "inner").mapInArrow(
        score, "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, inner double, own double")
    tail = rows.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("rid", F.col("t.tail").alias("word"), F.col("t.times").alias("k")) \
        .join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = tail.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known"),
                                   F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("tail_base"),
                                   F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(float(rest_n + rest_v + 1)))).alias("tail_inner"))
    out = model.join(tail, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("tail_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("own") + F.col("inner") + zero("tail_inner")).alias("score"))


