"""Checks of keys and references, as rows and not as exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, with how many; null keys count as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of `child` with a key that `parent` lacks; a null key refers to nothing and is no orphan."""
    p = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(p, F.col(child_key) == F.col("_k"), "left_anti")
