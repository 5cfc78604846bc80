"""From raw documents to packed training sequences: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``; the last one row per piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import decontaminate, near_dedup, packing, quality_classifier, secrets
from rankforge.llm.common import documents, materialize, prepare
from rankforge.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows and bytes of an Arrow batch: stages run one after another in the same executors, so each keeps its batches small.
BATCH = (500, 2 << 20)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier scores at its threshold or above. NULL and empty texts are scored like any other; rows that repeat an id or a
    text are scored alike; without labels every score is 0.5."""
    return quality_classifier.keep_good(docs, prepare(spark, *BATCH).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: five-word shingles at 0.8. The smallest id stays; texts without words, and rows
    without an id, all stay."""
    prepare(spark, *BATCH)
    return near_dedup.one_of_each(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that contain no benchmark item within its error budget. NULL and empty texts contain none and stay; an empty benchmark
    keeps all."""
    return decontaminate.without_leaks(docs, prepare(spark, *BATCH).read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced and ``n_chars`` counted anew. NULL and empty texts stay as they are."""
    prepare(spark, *BATCH)
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset. A NULL or empty text is one token; rows that repeat an id are packed by themselves."""
    prepare(spark, *BATCH)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", pack)]
#: SQL cannot express the classifier, MinHash, edit matching or packing; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sf_dir = sf_dir.rstrip("/")
    docs = documents(prepare(spark, *BATCH), sf_dir, *COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
