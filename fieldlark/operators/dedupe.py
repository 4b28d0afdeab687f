"""Keep-first and keep-last, upserts, top-k, set operations and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first by ``order``; a grouped minimum, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the last by ``order``: what insert-or-replace leaves."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def with_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``duplicate``: whether an earlier row has the key."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with ``changes`` put in: the row with the largest ``order`` of each key."""
    return keep_last(table.unionByName(changes), keys, [order])


def top_in_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def preview(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def linked(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both have, once."""
    return a.select(key).intersect(b.select(key))


def missing(required: Column, present: Column) -> Column:
    """Required names that are not present, sorted."""
    return F.sort_array(F.array_except(required, present))


def update(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` replaced where ``changes`` (one row a key) has a value."""
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return df.join(new, keys, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))
