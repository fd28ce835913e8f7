"""Table schemas and the checks every corpus passes before it is searched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

CAPTION_ROW = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("caption_id", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("image_id", T.StringType()),
    ]
)

IMAGE_EMBEDDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("embedding", VECTOR),
    ]
)

CAPTION_EMBEDDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("image", T.StringType()),
        T.StructField("image_id", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("embedding", VECTOR),
    ]
)


def require_columns(df: DataFrame, *names: str) -> None:
    """A named column that is absent is a KeyError on the driver, before any job."""
    for name in names:
        if name not in df.columns:
            raise KeyError(f"Column '{name}' not found; columns are {df.columns}")


def require_positive(**values: int) -> None:
    for name, value in values.items():
        if int(value) <= 0:
            raise ValueError(f"{name} must be a positive integer")


def as_vector(df: DataFrame, column: str) -> Column:
    """Vector column as ARRAY<FLOAT>; a numeric column becomes vectors of width 1."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.array(F.col(column).cast("float"))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.col(column).cast("array<float>")
    raise ValueError(f"Column '{column}' must hold numeric vectors, not {kind.simpleString()}")


def checked_vector(vector: Column, dim: int) -> Column:
    """Fail the job on a row whose vector has another width than the table declares."""
    return F.when(F.size(vector) == dim, vector).otherwise(
        F.raise_error(
            F.concat(
                F.lit(f"Embedding dimension mismatch: expected {dim}, received "),
                F.coalesce(F.size(vector).cast("string"), F.lit("null")),
            )
        ).cast("array<float>")
    )


def vector_stats(df: DataFrame, embedding: str = "embedding") -> tuple[int, int]:
    """Rows and width of a corpus in one aggregate; mixed widths are an error."""
    row = df.agg(
        F.count("*").alias("n"),
        F.min(F.size(embedding)).alias("low"),
        F.max(F.size(embedding)).alias("high"),
    ).first()
    if row["n"] and row["low"] != row["high"]:
        raise ValueError(f"Expected one vector width, found {row['low']} to {row['high']}")
    return row["n"], row["high"] or 0


def duplicate_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Ids that occur more than once (partial counts run before the shuffle)."""
    return df.groupBy(*ids).agg(F.count("*").alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, *ids: str) -> None:
    found = duplicate_ids(df, ids).head(1)
    if found:
        raise ValueError(f"Duplicate identifier detected: {found[0].asDict()}")
