"""Which labelled rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SALTS = 8


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the checksum of the id, as decimal text, is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_by(rows: DataFrame, label: str, n: int, key: str) -> DataFrame:
    """label and key of at most n different keys (long) of each label, the smallest of them; rows that repeat count once.

    Keys are ranked within SALTS parts of a label first, so that a label which most rows have isn't one task's work.
    """
    each = rows.select(label, key).where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(label, key).agg(F.lit(1).alias("_one")).drop("_one")
    parts = Window.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(SALTS))).orderBy(key)
    few = each.withColumn("_n", F.row_number().over(parts)).where(F.col("_n") <= n)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("_n") <= n).drop("_n")
