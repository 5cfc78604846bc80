"""Helpers shared by the operators: materialised intermediates, hash splits, UTF-8 batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path

#: Rows and bytes of one Arrow batch; bounds what a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> SparkSession:
    """Runtime settings that the operators rely on, for the caller's session; ``rows`` and ``size`` (bytes) of an Arrow batch."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*(cols or ("doc_id", "text")))


def id_remainder(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a NULL id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string batch and the offset of each row in them; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return data[off[0]:off[-1]], off - off[0]


def counts_per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def byte_class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SPACE = byte_class(b" \t\n\v\f\r")
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
SYMBOL = byte_class(b"#*$%&|<>")


def label_rows(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """One row ``(id, y)`` per id with a label; of conflicting labels the larger counts."""
    return labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()) \
        .groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.col(label).cast("int")).alias("_y"))


def worker_state(key: tuple, make: Callable):
    """An object that a Python worker keeps from task to task (a loaded vocabulary, a table of known words). It is
    a cache only: a new worker makes it anew."""
    kept = sys.modules.setdefault("_rankforge_worker_state", types.ModuleType("_rankforge_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def one_thread_blas() -> None:
    """Lets numpy's bundled OpenBLAS use the calling task's core alone: products are small here, and its idle threads spin. Where numpy
    has another BLAS this does nothing (there set OMP_NUM_THREADS for the executors). Results are the same."""
    def limit() -> bool:
        for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
            lib = ctypes.CDLL(str(path))
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
                    return True
        return False

    worker_state(("one-thread-blas",), limit)


#: Rows of ids up to which a table is broadcast (some 30 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table of ids, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def release_shuffles(spark: SparkSession) -> None:
    """After a materialised step: lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more,
    which it does only when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Labelled rows that a classifier is fitted on at most, a bound that holds at every size; drawn by a hash of the id.
FIT_ROWS = 200_000


def labelled_sample(labels: DataFrame, id_col: str, label: str, mod: int, held: int, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labels ``(_lid, _y)`` outside the held-out remainder, marked for broadcast: documents are
    matched where they are read and never shuffled for a fit."""
    y = label_rows(labels, id_col, label).filter("_y in (0, 1)").filter(id_remainder("_lid", mod) != held)
    return F.broadcast(materialize(y.orderBy(F.xxhash64("_lid"), "_lid").limit(rows), "labels"))
