"""What the trained operators share: labels, folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string")) % folds


def agreed_labels(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """``(id, y)`` with one row per id; ids with a null label or labels that differ are left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col)
    return one.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("y2")).where("y = y2").select(id_col, "y")


def chosen(key: Column, share: float | Column, seed: int) -> Column:
    """Whether the seeded hash of ``key``, as a fraction of its 63 bits, falls below ``share``, however small that is."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return (share >= 1) | (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1) < (share * float(1 << 63)).cast("long"))


def hash_sample(rows: DataFrame, id_col: str, share: float, seed: int) -> DataFrame:
    """The rows whose seeded id hash falls below ``share``: the same rows on any cluster."""
    return rows if share >= 1 else rows.where(chosen(F.col(id_col), share, seed))
