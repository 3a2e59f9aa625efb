"""Upserts and incremental writes as relational plans: each returns the table's new content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_old_if_empty(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both by ``key``; a new value replaces the old one unless it is null or empty. New keys come as they
    are. ``new`` has one row per key."""
    n = new.select(F.col(key).alias("k_"), *[F.col(c).alias(f"n_{c}") for c in columns])
    both = old.select(key, *columns).join(n, F.col(key) == F.col("k_"), "full")

    def value(c: str) -> Column:
        return F.when(F.col(key).isNull(), F.col(f"n_{c}")).when(F.coalesce(f"n_{c}", F.lit("")) != "", F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(F.coalesce(key, "k_").alias(key), *[value(c) for c in columns])


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, that with the greatest ``order``; the rank is cut to one row a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows of ``new`` whose key (nulls equal nulls) ``old`` lacks, the first by ``order`` of each key."""
    firsts = new.groupBy(*key).agg(F.min(order).alias(order))
    known = old.select(*[F.col(k).alias(f"o_{k}") for k in key]).distinct()
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    return firsts.join(known, condition, "left_anti")


def append(df: DataFrame, path: str) -> None:
    """Add rows to a stored table."""
    df.write.mode("append").parquet(path)
