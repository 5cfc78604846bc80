"""Collection cleaning: boilerplate, null handling, phrase stripping, text assembly, dedup.

All operators are narrow (map-only) except ``dedupe_text``, which groups on a fixed-width hash of
the text: partial aggregation collapses copies on the map side, so a text repeated in a third
of all rows costs one row per partition in the shuffle, not a third of the data in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Whole-cell boilerplate strings (trailing spaces matter) and stripped phrases.
BOILERPLATE = [
    "From the manufacturer Previous page Next page Previous page Next page Previous page Next page  ",
    "Product Description Read more ",
    "Product Description ",
    "From the manufacturer Read more Read more Read more Read more  ",
    "Product Description 1 Product Description 1",
    "Product Description Read more Read more ",
    "",
]
STRIP_PHRASES = ["Read more", "Product Description"]


def null_boilerplate(df: DataFrame, cols: Sequence[str] = ("title", "description")) -> DataFrame:
    """Cells that are exactly one of the boilerplate strings become NULL."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.col(c).isin(BOILERPLATE), F.lit(None).cast("string")).otherwise(F.col(c)))
    return out


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop(how="any")


def drop_all_null(df: DataFrame, subset: Sequence[str] = ("description", "title")) -> DataFrame:
    return df.na.drop(how="all", subset=list(subset))


def drop_null_subset(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset))


def strip_phrases(df: DataFrame, col: str = "description") -> DataFrame:
    """Delete the literal phrases (plain text, no trimming) in the given column only."""
    c: Column = F.col(col)
    for p in STRIP_PHRASES:
        c = F.replace(c, F.lit(p), F.lit(""))
    return df.withColumn(col, c)


def product_text(df: DataFrame, title: str = "title", description: str = "description",
                 out: str = "product_text") -> DataFrame:
    """``coalesce(title,'') || ' ' || coalesce(description,'')`` -- the separator is always kept."""
    return df.withColumn(out, F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "),
                                       F.coalesce(F.col(description), F.lit(""))))


def text_key(cols: Sequence[str]) -> Column:
    """SHA-256 of the tuple (NULL distinct from any string, lengths before the strings): a fixed-width grouping key."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(F.col(c).cast("string")) for c in cols]), 256)


def dedupe_text(df: DataFrame, subset: Sequence[str] = ("description", "title"),
                order_by: Sequence[str] = ("id",)) -> DataFrame:
    """Keep the first row (smallest ``order_by``) of each distinct ``subset`` tuple; NULLs group
    together. Plan: ``groupBy(sha256(subset)).agg(min(order))`` -- a hash aggregate with
    map-side partial aggregation over fixed-width keys, so a text copied into a third of all rows
    shuffles one row per partition. Only groups that lose a row (several rows, or no order) are written; the rows meet
    that table by key, and if it is small no text is shuffled."""
    keyed = df.withColumn("_k", text_key(subset))
    first = F.min(order_by[0]) if len(order_by) == 1 else F.min(F.struct(*[F.col(c) for c in order_by]))
    groups = keyed.groupBy("_k").agg(first.alias("_m"), F.count("*").alias("_n"))
    low = [F.col("_m")] if len(order_by) == 1 else [F.col("_m")[c] for c in order_by]
    groups = groups.select("_k", "_n", *[c.alias(f"_o{i}") for i, c in enumerate(low)])
    unordered = functools.reduce(lambda a, b: a | b, [F.col(f"_o{i}").isNull() for i in range(len(low))])
    losing = materialize(groups.filter((F.col("_n") > 1) | unordered).drop("_n").withColumn("_loses", F.lit(True)), "copies")
    stays = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_o{i}") for i, c in enumerate(order_by)])
    return keyed.join(losing, "_k", "left").filter(F.col("_loses").isNull() | stays).select(*df.columns)


def clean_collection(df: DataFrame, d: str = "description", t: str = "title") -> DataFrame:
    """dedupe -> null boilerplate -> drop rows with both NULL -> strip phrases -> product_text.
    The order matters: dedup sees the raw text."""
    out = dedupe_text(df, subset=(d, t), order_by=("id",) if "id" in df.columns else (df.columns[0],))
    out = null_boilerplate(out, (d, t))
    out = drop_all_null(out, (d, t))
    out = strip_phrases(out, d)
    return product_text(out, title=t, description=d)
