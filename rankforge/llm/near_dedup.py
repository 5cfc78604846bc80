"""Near duplicates: banded MinHash with sequential Bayesian verification.

* Every text becomes its set of distinct shingles of ``words`` words (64-bit hashes; two unless the caller says otherwise). Equal sets are one class; only
  classes are compared.
* Candidates: classes that agree in all rows of one of the bands. In a bucket every class is first paired with one hub (the class
  that shares most buckets), which is linear in the bucket; links already connect most of a group. Classes
  of a bucket that are still in different components are then paired by an exact prefix filter, so that no link between
  components is lost and a group of copies is never expanded into all pairs.
* Verification of a pair reads its signatures in batches: after each batch the posterior probability that the
  similarity reaches the threshold (uniform prior) prunes the pair once it falls below ``miss``. Survivors are
  confirmed on their full sets.

A pair at the threshold shares no band with probability (1 - t^rows)^bands: 5e-6 for the defaults."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, materialize, small, utf8, worker_state
from .graph import components
from .substring_dedup import Words

THRESHOLD = 80
ROWS, BANDS = 6, 40
#: Rows of the signature that verification reads, 16 bits each, and rows of a batch.
VERIFY, BATCH = 128, 16
MISS = 1e-6
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


#: Bytes of text hashed at once.
SLICE_BYTES = 1 << 20


def _lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def shingle_sets(texts: pa.Array, width: int = 2) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``width`` words; all words of a shorter text are its only shingle."""
    words, out = worker_state(("set-words",), Words), []

    def combined(h: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(h) - k + 1)
        g = h[:n]
        for j in range(1, k):
            g = _mix(g * np.uint64(_MIX[0]) + h[j:j + n])
        return g

    data, off = utf8(texts)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        h, at = words.split(_lowered(data[off[lo]:off[hi]]), off[lo:hi + 1] - off[lo])
        shingle = combined(h, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out.append(np.unique(shingle[a:b - width + 1] if b - a >= width else _mix(combined(h[a:b], max(b - a, 1)) + np.uint64(1))))
        lo = hi
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """``k`` minima of each non-empty set under fixed random hash functions."""
    lens = np.array([len(s) for s in sets])
    rng = np.random.default_rng(20240229)
    mult = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    out = np.empty((len(sets), k), np.uint32)
    lo = 0
    while lo < len(sets):  # blocks that stay in the processor's cache
        hi = lo + 1
        n = lens[lo]
        while hi < len(sets) and n + lens[hi] <= 16_384:
            n += lens[hi]
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        at = np.concatenate([[0], np.cumsum(lens[lo:hi])[:-1]])
        for j in range(k):
            out[lo:hi, j] = np.minimum.reduceat(((flat * mult[j] + add[j]) >> np.uint64(32)).astype(np.uint32), at)
        lo = hi
    return out


def _sets_of(texts: pa.Array, width: pa.Array) -> list[np.ndarray]:
    """The sets of a batch; ``width`` is the same in all rows."""
    return shingle_sets(texts, width[0].as_py()) if len(texts) else []


_PROFILE = T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
                         T.StructField("sig", T.BinaryType())])


@F.arrow_udf(_PROFILE)
def profile(texts: pa.Array, width: pa.Array) -> pa.Array:
    """Size of the shingle set, a 128-bit key of the set, the band hashes and the signature for verification."""
    import xxhash

    sets = _sets_of(texts, width)
    full = [i for i, s in enumerate(sets) if len(s)]
    sig = signatures([sets[i] for i in full], max(ROWS * BANDS, VERIFY))
    bands = np.zeros((len(full), BANDS), np.uint64)
    for r in range(ROWS):
        bands = _mix(bands * np.uint64(_MIX[0]) + sig[:, r:ROWS * BANDS:ROWS].astype(np.uint64) + np.uint64(1))
    bands = _mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    size = np.array([len(x) for x in sets], np.int64)
    key, short = [None] * len(sets), [None] * len(sets)
    for k, i in enumerate(full):
        key[i], short[i] = xxhash.xxh128_digest(sets[i].tobytes()), sig[k, :VERIFY].astype("<u2").tobytes()
    at = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(size), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel())), pa.array(short, pa.binary())],
                                      ["n", "key", "bands", "sig"])


def least_agreements(threshold: float, miss: float, rows: int = VERIFY, batch: int = BATCH) -> np.ndarray:
    """For each batch boundary the fewest agreeing rows with which a pair goes on: with a uniform prior,
    P(similarity >= t | a of m agree) = P(Binomial(m + 1, t) <= a), and the pair goes on while that is at least ``miss``."""
    out = []
    for m in range(batch, rows + 1, batch):
        total, a = 0.0, -1
        while total < miss:
            a += 1
            total += math.comb(m + 1, a) * threshold ** a * (1 - threshold) ** (m + 1 - a)
        out.append(a)
    return np.array(out)


@F.arrow_udf(T.BooleanType())
def _plausible(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.bool_())
    x, y = (np.frombuffer(b"".join(v.to_pylist()), "<u2").reshape(len(v), VERIFY) for v in (a, b))
    least = least_agreements(THRESHOLD / 100, MISS)
    alive = np.arange(len(x))
    hits = np.zeros(len(x), np.int64)
    for k, need in enumerate(least):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        hits[alive] += (x[alive, cols] == y[alive, cols]).sum(1)
        alive = alive[hits[alive] >= need]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return pa.array(out)


@F.arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


@F.arrow_udf(T.BinaryType())
def _set_bytes(texts: pa.Array, keys: pa.Array, width: pa.Array) -> pa.Array:
    """The set of each text, NULL if it is not the one with the key."""
    import xxhash

    sets = [s.tobytes() for s in _sets_of(texts, width)]
    return pa.array([s if xxhash.xxh128_digest(s) == k else None for s, k in zip(sets, keys.to_pylist(), strict=True)], pa.binary())


@F.arrow_udf(T.BinaryType())
def _set_key(texts: pa.Array, width: pa.Array) -> pa.Array:
    """The key of each text's set as in ``profile``, NULL for the empty set."""
    import xxhash

    return pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in _sets_of(texts, width)], pa.binary())


def _size_ok(a: str, b: str):
    """Sizes that allow the threshold at all."""
    return (100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b))


def _sets(need: DataFrame, classes: DataFrame, docs: DataFrame, words: int, unique: bool, name: str) -> DataFrame:
    """``(c, set)`` of the classes ``need``, from the texts of their documents."""
    reps = materialize(classes.join(need, "c", "left_semi").select("c", F.col("doc_id").alias("_id"), "key"), f"compared-{name}")
    sets = docs.join(small(reps), F.col("doc_id").eqNullSafe(F.col("_id"))).select("c", _set_bytes("text", "key", F.lit(words)).alias("set")).filter("set is not null")
    # rows that repeat an id and a text give one set each; the first stands for them
    return materialize(sets if unique else sets.groupBy("c").agg(F.first("set").alias("set")), f"sets-{name}")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _members(sets: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(s, np.int64) for s in sets.to_pylist()], pa.list_(pa.int64()))


#: Ratio of neighbouring size bands, and how many bands apart two sizes may be for the threshold.
SIZE_STEP, SIZE_REACH = 1.04, 6


def _needed(a, b):
    """Shingles that sets of these sizes share at least when they reach the threshold."""
    return F.ceil(THRESHOLD * (a + b) / F.lit(100.0 + THRESHOLD) - F.lit(1e-9))


def prefix_pairs(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of classes ``(c, label, n)`` in different components that can reach the threshold.

    Exact prefix and position filter: with the shingles of every set ordered by rarity, the first shared
    one stands at most ``n - needed`` places from the start in both sets. A copy with so many edits of its own that it is near
    nothing has only shingles that no other set has in its prefix and meets no one, however large its group is."""
    member = sets.select("c", F.explode(_members("set")).alias("h"))
    often = member.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    shared = member.join(often, "h").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("m", "h"))).alias("e")).join(classes, "c")
    alone = F.col("n") - F.size("e")  # shingles of its own stand first
    room = F.floor(F.col("n") * (100 - THRESHOLD) / 100.0 + F.lit(1e-9)) + 1 - alone
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP))
    first = shared.filter(room > 0).select("c", "label", "n", alone.alias("alone"), band.alias("own"), F.posexplode(F.slice("e", F.lit(1), room.cast("int"))).alias("k", "x"))
    first = first.select("c", "label", "n", "own", (F.col("alone") + F.col("k")).alias("at"), F.col("x.h").alias("h"))
    first = first.withColumn("other", F.explode(F.sequence(F.col("own") - SIZE_REACH, F.col("own") + SIZE_REACH)))
    least = F.floor(F.pow(F.lit(SIZE_STEP), F.col("other")))  # the smallest size of the other band
    first = materialize(first.filter(F.col("n") - F.col("at") >= _needed(F.col("n"), least)), "prefixes")
    x = first.select("h", "own", "other", F.col("c").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("ia"))
    y = first.select("h", F.col("own").alias("other"), F.col("other").alias("own"), F.col("c").alias("b"), F.col("label").alias("lb"),
                     F.col("n").alias("nb"), F.col("at").alias("ib"))
    need = _needed(F.col("na"), F.col("nb"))
    return x.join(y, ["h", "own", "other"]).filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.col("na") - F.col("ia") >= need)
                                                  & (F.col("nb") - F.col("ib") >= need)).select("a", "b").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, unique: bool, name: str) -> DataFrame:
    """Of candidate pairs ``(a, b)`` the links: pruned on signatures, confirmed on the full sets."""
    sig = classes.select("c", "n", "sig")
    p = pairs.join(sig.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a") \
        .join(sig.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b") \
        .filter(_size_ok("na", "nb")).filter(_plausible("sa", "sb")).select("a", "b")
    p = materialize(p, f"plausible-{name}")
    need = p.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    sets = _sets(need, classes, docs, words, unique, name)
    links = p.join(sets.select(F.col("c").alias("a"), F.col("set").alias("x")), "a") \
        .join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b").filter(_similar("x", "y")).select("a", "b")
    return materialize(links, f"links-{name}")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame, bool]:
    """``(doc_id, n, key)`` of every row, ``(key, label, component_id)`` of every set, and whether no id repeats."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prof = materialize(d.select("doc_id", profile("text", F.lit(words)).alias("p")).select("doc_id", "p.*").withColumn("rid", F.monotonically_increasing_id()), "profiles")
    unique = prof.groupBy("doc_id").count().filter("count > 1").isEmpty()
    # classes of equal sets, named by a row number; one of the rows stands for the class
    cls = materialize(prof.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("rid").alias("c"), F.count("*").alias("copies")), "classes")
    rows = materialize(prof.join(cls.select("c"), prof["rid"] == F.col("c"), "left_semi").select(
        F.col("rid").alias("c"), "doc_id", "n", "sig", "bands", "key"), "class-rows")
    member = rows.select("c", F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    member = materialize(member.join(sizes, "bucket"), "members")
    # hub of a bucket: the class with the largest buckets in all
    weight = member.groupBy("c").agg(F.sum("m").alias("w"))
    weighted = materialize(member.select("c", "bucket").join(weight, "c"), "weighted")
    hubs = weighted.groupBy("bucket").agg(F.min(F.struct(-F.col("w"), "c"))["c"].alias("hub"))
    stars = weighted.join(hubs, "bucket").filter("c != hub").select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()
    stars = materialize(stars, "stars")
    links = _verified(stars, rows, d, words, unique, "stars")
    label = materialize(components(links), "star-labels")
    # what is left: classes of a bucket in different components that were not compared yet
    left = weighted.select("c", "bucket").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    open_buckets = left.groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 < l2").select("bucket")
    left = materialize(left.join(open_buckets, "bucket").select("c", "label").distinct().join(rows.select("c", "n"), "c"), "open")
    rest = prefix_pairs(left, _sets(left.select("c"), rows, d, words, unique, "open")).join(stars, ["a", "b"], "left_anti")
    more = _verified(materialize(rest, "rest"), rows, d, words, unique, "rest")
    label = components(links.unionByName(more))
    named = cls.select("key", "c", "least").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return prof, materialize(named.join(ids, "label").select("key", "label", "component_id"), "component-of-set"), unique


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable, itself included), kept
    (doc_id = component_id). A shingle has ``words`` words.

    Texts without words have an empty set, are linked with nothing and kept. A NULL id takes part, but cannot be a component's
    id unless all its members have none; then component_id is NULL and the document is kept."""
    prof, by_key, _ = _grouped(docs, id_col, text_col, words)
    out = prof.select("doc_id", "n", "key").join(by_key, "key", "left").withColumn(
        "component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, without those that do not stand for their component.

    A component's text is that of its smallest id (of several texts with this id, the one with the smallest key). Rows are told apart by
    id and set: of two rows with one id, one may go and the other stay. Rows without an id stay, as do rows that repeat the
    kept row."""
    prof, by_key, unique = _grouped(docs, id_col, text_col, words)
    of = prof.select("doc_id", "key").join(by_key, "key")
    stands = of.filter("doc_id = component_id").groupBy("label").agg(F.min("key").alias("stands"))
    gone = of.filter("doc_id is not null").join(stands, "label").filter("doc_id != component_id or key != stands")
    # names that no column of the caller's rows has
    g, k, m, o = fresh_names(docs, "gone_id", "gone_key", "mixed_id", "own_key")
    gone = materialize(gone.select(F.col("doc_id").alias(g), F.col("key").alias(k)).distinct(), "duplicates")
    if unique:
        return docs.join(small(gone.select(g)), F.col(id_col) == F.col(g), "left_anti")
    # ids of which only some rows go: their texts' keys decide
    stay = prof.join(gone, prof["doc_id"].eqNullSafe(F.col(g)) & prof["key"].eqNullSafe(F.col(k)), "left_anti")
    mixed = materialize(gone.select(g).distinct().join(stay.select(F.col("doc_id").alias(g)), g, "left_semi"), "part-duplicates")
    whole = materialize(gone.select(g).distinct().join(mixed, g, "left_anti"), "whole-duplicates")
    rows = docs.join(small(whole), F.col(id_col) == F.col(g), "left_anti")
    some = materialize(gone.join(mixed, g, "left_semi"), "part-keys")
    marked = rows.join(small(mixed.withColumnRenamed(g, m)), F.col(id_col) == F.col(m), "left")
    marked = marked.withColumn(o, _set_key(F.when(F.col(m).isNotNull(), F.col(text_col)), F.lit(words)))
    return marked.join(small(some), (F.col(m) == F.col(g)) & (F.col(o) == F.col(k)), "left_anti").select(*docs.columns)
