"""Image tables, and the registry of named readers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.encoders import collect_kwargs
from nearfield.functions.ids import name_before_first_dot, resolve_image_id
from nearfield.schema import require_columns
from nearfield.sources.captions import read_captions_jsonl


def image_rows(
    table: DataFrame,
    *,
    id_column: str | None = "inat24_file_name",
    image_column: str = "image",
    fallback_order: Sequence[str] | None = None,
) -> DataFrame:
    """``id, image`` of a hosted image table; the row number is the last resort for the id."""
    require_columns(table, image_column)
    return resolve_image_id(table, id_column, fallback_order=fallback_order).select(
        "id", F.col(image_column).alias("image")
    )


def image_rows_by_name(
    table: DataFrame, *, filename_column: str = "filename", image_column: str = "image"
) -> DataFrame:
    """``id, image`` where the id is the file name up to its first dot."""
    require_columns(table, filename_column, image_column)
    return table.select(
        name_before_first_dot(F.col(filename_column)).alias("id"),
        F.col(image_column).alias("image"),
    )


def read_image_rows(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return image_rows(spark.read.parquet(path), **options)


def read_image_rows_by_name(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return image_rows_by_name(spark.read.parquet(path), **options)


def read_image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image files of a folder tree as ``id, image``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    table = files.option("recursiveFileLookup", "true").load(path)
    return table.select(
        name_before_first_dot(F.substring_index("path", "/", -1)).alias("id"),
        F.col("content").alias("image"),
    )


Reader = Callable[..., DataFrame]

# The names under which configurations ask for a reader.
DATASETS: dict[str, Reader] = {
    "inquire": read_image_rows,
    "flickr30k": read_image_rows_by_name,
    "image_files": read_image_files,
}
TEXT_DATASETS: dict[str, Reader] = {"flickr30k_captions": read_captions_jsonl}


def _read(registry: Mapping[str, Reader], spark: SparkSession, config: Mapping[str, Any], kind):
    name = config.get("dataset")
    if name not in registry:
        raise ValueError(f"{kind} {name} not found")
    return registry[name](spark, **collect_kwargs(config, "dataset"))


def get_dataset(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    return _read(DATASETS, spark, config, "Dataset")


def get_text_dataset(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    return _read(TEXT_DATASETS, spark, config, "Text dataset")
