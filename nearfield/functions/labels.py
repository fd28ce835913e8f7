"""Relevance labels: whitespace, image suffixes, label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The image suffixes that labels and ids may carry.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")

_EDGE_SPACE = r"(?U)^\s+|\s+$"
_ONE_SUFFIX = r"(?i)\.(" + "|".join(s.removeprefix(".") for s in IMAGE_SUFFIXES) + r")\z"


def strip(text: Column) -> Column:
    """Trim every kind of white space (Spark's ``trim`` removes blanks only)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def normalize_label(label: Column) -> Column:
    """Trim and drop one image suffix in any case; the stem keeps its case."""
    return F.regexp_replace(strip(label), _ONE_SUFFIX, "")


def label_set(df: DataFrame, column: str) -> Column:
    """Trimmed, distinct labels; null is empty and a plain string is a set of one."""
    kind = df.schema[column].dataType
    values = F.col(column)
    if not isinstance(kind, T.ArrayType):
        values = F.when(values.isNotNull(), F.array(values.cast("string")))
    values = F.coalesce(values.cast("array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.transform(values, strip))


def normalized_set(labels: Column) -> Column:
    return F.array_distinct(F.transform(labels, normalize_label))


def joined_labels(labels: Column) -> Column:
    """Sorted labels as one text; null when there are none."""
    return F.when(F.size(labels) > 0, F.array_join(F.array_sort(labels), "; "))


def truth_info(df: DataFrame, relevance: str) -> DataFrame:
    """Add ``labels``, ``normalised`` and ``joined`` for a relevance column."""
    return (
        df.withColumn("labels", label_set(df, relevance))
        .withColumn("normalised", normalized_set(F.col("labels")))
        .withColumn("joined", joined_labels(F.col("labels")))
    )


def serialize_metadata(df: DataFrame, column: str) -> Column:
    """Lists become ``", "`` joined text, maps and structs JSON, the rest is unchanged."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.col(column).cast("array<string>"), ", ", "None")
    if isinstance(kind, T.MapType | T.StructType):
        return F.to_json(column)
    return F.col(column)
