"""Keep-first rows, counts, samples, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.ids import running_before
from nearfield.schema import require_columns


def keep_first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order.

    ``row_number() = 1`` is planned as a window group limit, which drops all but one row per key
    in each task before the shuffle: a key that holds a third of the table costs one row per task.
    """
    require_columns(df, *keys, *order)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def distinct_count(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys in one aggregate."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_unique")
    )


def sample_seeded(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded random order that does not depend on partitions.

    The order is the digest of seed and key; the limit keeps n rows per task before the merge.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(digest, key).limit(int(n))


def head_limit(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """First ``n`` rows; no limit when n is null, no rows when it is not positive."""
    if n is None:
        return df
    return df.limit(0) if n <= 0 else df.orderBy(*order).limit(int(n))


def caption_limit(df: DataFrame, order: Sequence[str], images: int | None) -> DataFrame:
    """The first five captions' worth of rows per allowed image."""
    return df if images is None or images <= 0 else head_limit(df, order, 5 * images)


def running_limit(shards: DataFrame, budget: int | None) -> DataFrame:
    """Rows each shard may write under one budget, in shard order.

    ``shards`` holds one row per shard (``shard, n_rows, skipped``); skipped shards use none of the
    budget. The running total is taken in two levels, so any number of shards will do.
    """
    used = F.when(F.col("skipped"), F.lit(0)).otherwise(F.col("n_rows"))
    if budget is None:
        return shards.withColumn("n_write", used)
    totals = running_before(shards.withColumn("_used", used), ["shard"], "_used", "_before")
    left = F.lit(int(budget)) - F.col("_before")
    return totals.withColumn("n_write", F.greatest(F.lit(0), F.least("_used", left))).drop("_used", "_before")


def lookup(df: DataFrame, keys: DataFrame | Sequence, key: str = "id") -> DataFrame:
    """Rows by key: a pushed-down filter for a few keys, a semi join for a table of keys."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(list(keys)))


def lookup_one(df: DataFrame, value, key: str = "id") -> DataFrame:
    """One row by key; an absent key is a KeyError."""
    found = lookup(df, [value], key)
    if not found.head(1):
        raise KeyError(value)
    return found


def missing_one_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that has them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(
        b.join(a, key, "left_anti").withColumn("only_in", F.lit("right"))
    )


def zip_positional(left: DataFrame, right: DataFrame, position: Sequence[str]) -> DataFrame:
    """Row i with row i by explicit position; sides of different length are an error."""
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"Shard size mismatch: {n_left} rows against {n_right}")
    return left.join(right, list(position))
