"""Identifier rules: captions, image files, prompts, row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import materialise

# Prompt prefixes of the text encoders.
PROMPTS = {"query": "Query: ", "passage": "Passage: "}

# Identifier columns of the hosted image table, in order of preference.
IMAGE_ID_COLUMNS = ("inat24_file_name", "inat24_image_id")


def basename(path: Column) -> Column:
    """Last path segment; closing slashes and ``.`` segments do not count."""
    return F.regexp_extract(F.regexp_replace(path, r"(/\.?)+\z", ""), r"([^/]*)\z", 1)


def file_stem(path: Column) -> Column:
    """Basename without its last suffix (a leading or closing dot is no suffix)."""
    name = basename(path)
    return F.when(name == ".", F.lit("")).otherwise(
        F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")
    )


def image_id_of(path: Column) -> Column:
    stem = file_stem(F.coalesce(path, F.lit("")))
    return F.when(stem == "", F.lit("unknown")).otherwise(stem)


def name_before_first_dot(filename: Column) -> Column:
    return F.substring_index(filename, ".", 1)


def caption_id(image_id: Column, position: Column) -> Column:
    return F.concat(image_id, F.lit("#"), position.cast("string"))


def image_path(root: str, pattern: str, image_id: Column) -> Column:
    """``root/pattern`` with ``{id}`` filled in."""
    prefix = F.lit(root.rstrip("/") + "/")
    return F.concat(prefix, F.replace(F.lit(pattern), F.lit("{id}"), image_id))


def prompt_prefix(text: Column, prompt: str) -> Column:
    if prompt not in PROMPTS:
        raise ValueError(f"Prompt name {prompt} not found; choose from {sorted(PROMPTS)}")
    return F.concat(F.lit(PROMPTS[prompt]), text)


def row_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """0-based position of every row in the given total order, without a single-task sort.

    Rows are range partitioned and sorted; the sorted table is written once, partitions are
    counted, and each row adds its partition's offset. Ties must be broken by ``order``.
    """
    ordered = materialise(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # One row per partition: the running total is over partitions, not over rows.
    counts = ordered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("low"))
    starts, total = [], 0
    for row in counts.orderBy("_part").collect():
        starts.append((row["_part"], total - row["low"]))
        total += row["n"]
    if not starts:
        return ordered.withColumn(name, F.col("_at")).drop("_part", "_at")
    shift = df.sparkSession.createDataFrame(starts, "_part int, _shift long")
    return (
        ordered.join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_part", "_at", "_shift")
    )


def running_before(df: DataFrame, order: Sequence[str], value: str, name: str = "before") -> DataFrame:
    """Sum of ``value`` over all rows before a row in the given total order, in two levels.

    Rows are range partitioned, sorted and written once. The blocks are summed, a block starts with
    the sum of the blocks before it, and only rows of one block are summed one by one.
    """
    ordered = materialise(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # One row per block of the shuffle, whatever the number of rows.
    totals = ordered.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("n"))
    starts, total = [], 0
    for row in totals.orderBy("_part").collect():
        starts.append((row["_part"], total))
        total += row["n"]
    shift = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long")
    return (
        ordered.join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_start") + inside)
        .drop("_part", "_at", "_start")
    )


def resolve_image_id(
    df: DataFrame,
    id_column: str | None = IMAGE_ID_COLUMNS[0],
    *,
    fallback_order: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``id`` from the first identifier column present, else the row number."""
    for name in (id_column, *IMAGE_ID_COLUMNS):
        if name and name in df.columns:
            return df.withColumn("id", F.col(name).cast("string"))
    if fallback_order is None:
        raise KeyError(f"Identifier column '{id_column}' not found; columns are {df.columns}")
    return row_index(df, fallback_order, "_row").withColumn(
        "id", F.col("_row").cast("string")
    ).drop("_row")
