"""Vector operators on keyed tables (row-wise maths stays in native higher-order functions; the scores of many pairs are computed by blocks)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors as V

#: Ids of a block on either side; a group holds the vectors of one query and one product block and the pairs between them.
BLOCK = 4096
#: Pairs whose vectors a task gathers at a time.
SLICE = 32_768
#: Pairs that are packed together, and partitions of the groups at most.
CHUNK, PARTITIONS = 2_000_000, 10_000


class _Side:
    """Vectors of one side of a block, ordered by id. ``state``: 0 a NULL vector, 1 one with a NULL component, 2 a whole one."""

    def __init__(self, table):
        import numpy as np
        import pyarrow.compute as pc

        t = table.sort_by("_id")
        v = t.column("_v").combine_chunks()
        self.ids = t.column("_id").to_numpy()
        self.n = np.nan_to_num(pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        flat = v.flatten()  # a NULL list has no entries here
        holes = np.asarray(flat.is_null())
        row, ends = np.repeat(np.arange(len(self.n)), self.n), np.cumsum(self.n)
        self.x = np.zeros((len(self.n), int(self.n.max(initial=0))))
        self.x[row, np.arange(len(flat)) - np.repeat(ends - self.n, self.n)] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        self.state = np.where(np.asarray(v.is_null()), 0, np.where(np.bincount(row[holes], minlength=len(self.n)) > 0, 1, 2))
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))

    def at(self, keys):
        """First place and number of the rows with each key."""
        import numpy as np

        lo = np.searchsorted(self.ids, keys, "left")
        return lo, np.searchsorted(self.ids, keys, "right") - lo

    def unit(self):
        """As ``V.l2_normalize``: zeros for a zero vector and for one with a NULL component."""
        import numpy as np

        fit = (self.state == 2) & (self.norm != 0)
        return np.divide(self.x, self.norm[:, None], out=np.zeros_like(self.x), where=fit[:, None])


def _kernel(name: str):
    """``(q, p, i, j) -> (scores, valid)`` of the rows ``i`` of side ``q`` and ``j`` of side ``p``, as the Column function of that name has them."""
    def run(q, p, i, j):
        import numpy as np

        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            both = (q.n[i] == p.n[j]) & (q.state[i] == 2) & (p.state[j] == 2)
            a, b = (q.unit(), p.unit()) if name == "dot_score" else (q.x, p.x)
            w = min(a.shape[1], b.shape[1])  # a pair of equal lengths has no entry beyond
            s = np.empty(len(i))
            for lo in range(0, len(i), SLICE):
                x, y = a[i[lo:lo + SLICE], :w], b[j[lo:lo + SLICE], :w]
                if name == "l2_distance":
                    x = y = x - y
                s[lo:lo + SLICE] = np.einsum("ij,ij->i", x, y)
            if name == "l2_distance":
                return np.sqrt(s), both
            if name == "dot_score":
                return s * 100.0, (q.n[i] == p.n[j]) & (q.state[i] > 0) & (p.state[j] > 0)
            if name == "dot":
                return s, both
            den = q.norm[i] * p.norm[j]
            return np.where(both & (den != 0), s / den, 0.0), np.ones(len(i), bool)
    return run


KERNELS = {V.cosine: "cosine", V.dot: "dot", V.dot_score: "dot_score", V.l2_distance: "l2_distance"}


def _packed(batches, kept: list[str], chunk: int):
    """Pairs ``(_block, *kept)`` as rows ``(_block, _data)``: those of a block among some ``chunk`` pairs are one compressed Arrow stream. Ids that follow the
    same order in many queries take next to nothing, any others a few bytes."""
    import numpy as np
    import pyarrow as pa

    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def rows(held):
        t = pa.Table.from_batches(held).combine_chunks()
        block = t.column("_block").to_numpy()
        names, code = np.unique(block, return_inverse=True)
        order = np.argsort(code.astype(np.uint16) if len(names) <= 1 << 16 else code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(names)))
        t, out = t.select(kept).take(pa.array(order)).combine_chunks(), []
        for lo, hi in zip([0, *ends], ends, strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=options) as writer:
                writer.write_table(t.slice(lo, hi - lo))
            out.append(sink.getvalue().to_pybytes())
        for lo in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(names[lo:lo + 64], pa.int64()), pa.array(out[lo:lo + 64], pa.binary())], ["_block", "_data"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= chunk:
            yield from rows(held)
            held, n = [], 0
    if held:
        yield from rows(held)


def _unpacked(data):
    import pyarrow as pa

    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in data]).combine_chunks()


def _size(df: DataFrame, vec: str) -> tuple[int, bool, int]:
    """Rows, whether single precision holds all of the vectors exactly, and the longest vector."""
    v = V.as_double(vec)
    fits = F.coalesce(v == v.cast("array<float>").cast("array<double>"), F.lit(True))
    n, single, width = df.agg(F.count("*"), F.coalesce(F.bool_and(fits), F.lit(True)), F.coalesce(F.max(F.size(v)), F.lit(0))).first()
    return n, single, max(0, width)


def _blocks(pairs: DataFrame, queries: DataFrame, products: DataFrame, fn, out: str, q_vec: str, p_vec: str, nq: int, np_: int, single: bool,
            finish=None, schema=None) -> DataFrame:
    """Scores of the pairs in ``nq * np_`` groups; vectors travel in single precision if that holds them exactly. ``finish`` takes a group's pairs
    ``(docid, qid, .., out)`` to rows of ``schema``."""
    as_sent = lambda v: V.as_double(v).cast("array<float>") if single else V.as_double(v)
    qb, pb = F.pmod(F.xxhash64(F.col("qid").cast("long")), F.lit(nq)), F.pmod(F.xxhash64(F.col("docid").cast("long")), F.lit(np_))
    kept = ["docid", "qid", *[c for c in pairs.columns if c not in ("qid", "docid")]]
    # a partition holds about one group, whatever the sizes
    parts = min(PARTITIONS, max(nq * np_, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    left = pairs.filter("qid is not null and docid is not null").withColumn("_block", qb * np_ + pb)
    left = left.mapInArrow(lambda b: _packed(b, kept, CHUNK), "_block long, _data binary").repartition(parts, "_block")
    own_q = queries.select(F.lit(False).alias("_p"), F.col("qid").cast("long").alias("_id"), as_sent(q_vec).alias("_v"), qb.alias("_b")) \
        .select("_p", "_id", "_v", F.explode(F.expr(f"sequence(_b * {np_}L, _b * {np_}L + {np_ - 1}L)")).alias("_block"))
    own_p = products.withColumnRenamed("id", "docid").select(F.lit(True).alias("_p"), F.col("docid").cast("long").alias("_id"), as_sent(p_vec).alias("_v"), pb.alias("_b")) \
        .select("_p", "_id", "_v", F.explode(F.expr(f"sequence(_b, _b + {(nq - 1) * np_}L, {np_}L)")).alias("_block"))
    right = own_q.unionByName(own_p).filter("_id is not null").repartition(parts, "_block")
    scored_schema = T.StructType([*[T.StructField(c, pairs.schema[c].dataType) for c in kept], T.StructField(out, T.DoubleType())])
    score = _kernel(KERNELS[fn])

    def scored(packed, vecs):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        some = _unpacked(packed.column("_data"))
        q, p = _Side(vecs.filter(pc.invert(vecs.column("_p")))), _Side(vecs.filter(vecs.column("_p")))
        (qa, qn), (pa_, pn) = q.at(some.column("qid").to_numpy()), p.at(some.column("docid").to_numpy())
        n = qn * pn
        if (n == 1).all():
            i, j = qa, pa_
        else:
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            i, j, some = qa[row] + k // pn[row], pa_[row] + k % pn[row], some.take(pa.array(row))
        s, valid = score(q, p, i, j)
        some = some.append_column(out, pa.array(s, pa.float64(), mask=~valid))
        return some if finish is None else finish(some)

    schema = schema or scored_schema
    none = to_arrow_schema(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).empty_table()
    return left.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(lambda x, v: scored(x, v) if x.num_rows else none, schema)


def pair_scores(pairs: DataFrame, queries: DataFrame, products: DataFrame, fn=V.cosine,
                out: str = "score", q_vec: str = "query_embedding", p_vec: str = "product_embedding", block: int = BLOCK) -> DataFrame:
    """Attach both vectors to ``pairs(qid, docid, ..)`` by their keys, then a row-wise score.

    No pair travels with a vector: queries and products are dealt by a hash into blocks of bounded size, a vector is copied to every block of the other
    side, a pair goes once, by its ids and packed with others, to the group of its two blocks, and scores are computed there. Rows that repeat a key join each, NULL
    keys none, and NULL vectors score as ``fn`` has them. Other Column functions than ``KERNELS`` are projected after two equi joins."""
    if fn not in KERNELS:
        q = queries.select("qid", q_vec)
        p = products.select(F.col("id").alias("docid"), p_vec)
        j = pairs.join(q, "qid").join(p, "docid")
        return j.withColumn(out, fn(F.col(q_vec), F.col(p_vec))).drop(q_vec, p_vec)
    (n_q, q_single, _), (n_p, p_single, _) = _size(queries, q_vec), _size(products, p_vec)
    nq, np_ = (max(1, math.ceil(n / block)) for n in (n_q, n_p))
    # several groups a core, whatever the sizes
    np_ = max(np_, math.ceil(4 * pairs.sparkSession.sparkContext.defaultParallelism / nq))
    return _blocks(pairs, queries, products, fn, out, q_vec, p_vec, nq, np_, q_single and p_single)


def attach(pairs: DataFrame, rows: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner join of ``pairs``, whose number grows with the square of the vectors, with ``rows``, which grow as the vectors do.

    A task holds its share of ``rows`` in a hash table and lets the pairs pass; they are neither sorted nor held."""
    return pairs.join(rows.hint("shuffle_hash"), on)


def _lists(t):
    """Scored pairs of whole products to a row a product."""
    import numpy as np
    import pyarrow as pa

    docid, qid, score = (t.column(c).to_numpy() for c in ("docid", "qid", "score"))
    order = np.lexsort((score, qid, docid))
    docid, score = docid[order], score[order]
    first = np.flatnonzero(np.append(True, docid[1:] != docid[:-1])) if len(docid) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(docid)))
    mean = np.add.reduceat(score, first) / n if len(docid) else np.zeros(0)
    cosines = pa.ListArray.from_arrays(pa.array(np.append(first, len(docid)), pa.int32()), pa.array(score))
    return pa.table({"docid": pa.array(docid[first], t.schema.field("docid").type), "mean_cosine": mean, "n_queries": pa.array(n, pa.int64()), "cosines": cosines})


#: Pairs of a group of whole products, and bytes of the queries' vectors that every such group has at most.
GROUP_PAIRS, QUERY_BYTES = 6_000_000, 256 << 20


def semantic_similarity(pairs: DataFrame, queries: DataFrame, products: DataFrame) -> DataFrame:
    """Per product: mean cosine with its (relevant) queries, their count, and the list of cosines in the order of the query ids.

    A group has whole products with all of their pairs and every query's vector, and makes its lists itself: no score is shuffled. If the queries' vectors
    have more than ``QUERY_BYTES``, pairs are scored by blocks and their scores meet by product."""
    (n_q, q_single, width), (n_p, p_single, _) = _size(queries, "query_embedding"), _size(products, "product_embedding")
    if n_q * width * 8 <= QUERY_BYTES:
        pairs = pairs.select("qid", "docid")
        cores = pairs.sparkSession.sparkContext.defaultParallelism
        groups = max(4 * cores, math.ceil(n_p / BLOCK), math.ceil(pairs.count() / GROUP_PAIRS))
        schema = f"docid {pairs.schema['docid'].dataType.simpleString()}, mean_cosine double, n_queries long, cosines array<double>"
        return _blocks(pairs, queries, products, V.cosine, "score", "query_embedding", "product_embedding", 1, groups, q_single and p_single, _lists, schema)
    s = pair_scores(pairs, queries, products)
    # two lists in the same order (a cosine is never NULL): half the bytes of a list of structs
    s = s.groupBy("docid").agg(F.avg("score").alias("mean_cosine"), F.count("*").alias("n_queries"),
                               F.collect_list("qid").alias("_q"), F.collect_list("score").alias("_s"))
    return s.select("docid", "mean_cosine", "n_queries", F.transform(F.array_sort(F.arrays_zip("_q", "_s")), lambda x: x["_s"]).alias("cosines"))


def vector_sum(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Element-wise vector sum per group: posexplode -> groupBy(group, pos) (partial aggregation,
    so a hot group costs one row per dimension per partition) -> ``(group, pos, s)``."""
    return df.select(group, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x")) \
        .groupBy(group, "pos").agg(F.sum("x").alias("s"))


def pairwise_diversity(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean cosine distance over all unordered pairs of a group, without building pairs:
    for unit vectors ``sum_{i<j} cos = (||sum u||^2 - n) / 2``; fewer than 2 members -> 0.0."""
    unit = df.select(group, V.l2_normalize(F.col(vec)).alias("u"),
                     (V.norm(F.col(vec)) > 0).alias("nz"))
    n = unit.groupBy(group).agg(F.count("*").alias("n"), F.count_if("nz").alias("nnz"))
    sq = vector_sum(unit, group, "u").groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    j = n.join(sq, group, "left")
    mean_cos = (F.col("ss") - F.col("nnz")) / (F.col("n") * (F.col("n") - 1))
    return j.select(group, "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.lit(1.0) - mean_cos).alias("diversity"))


def first_per_group(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Deterministic ``first``: the non-null value with the smallest ``order`` per group."""
    return df.filter(F.col(value).isNotNull()).groupBy(group).agg(
        F.min_by(F.struct(F.col(order).alias(order), F.col(value).alias(value)), F.col(order)).alias("_f")) \
        .select(group, F.col(f"_f.{order}").alias(order), F.col(f"_f.{value}").alias(value))
