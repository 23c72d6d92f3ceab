"""Seeded shuffles, splits and samples by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairing import with_row_index


def shuffled(df: DataFrame, key: str, seed: int = 7, name: str = "row_idx") -> DataFrame:
    """Row numbers in a seeded hash order: the same on every run and cluster."""
    return with_row_index(df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), "_h", key, name=name).drop("_h")


def split(df: DataFrame, total: int | str | None = None, share: float = 0.05, index: str = "row_idx") -> DataFrame:
    """Column split by position: the first floor(share * total) rows test, as many valid, the rest train. total is the raw
    row count, before rows without an oracle were dropped, or a column that holds it (with_row_index() can add it); by default
    df is counted."""
    n = F.col(total) if isinstance(total, str) else F.lit(df.count() if total is None else total)
    k = F.floor(n * F.lit(share)).cast("bigint")
    return df.withColumn("split", F.when(F.col(index) < k, "test").when(F.col(index) < 2 * k, "valid").otherwise("train"))
