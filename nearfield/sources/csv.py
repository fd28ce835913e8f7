"""CSV tables and what the query preparation reads from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.labels import strip
from nearfield.operators.dedup import keep_first_row

# Text columns a query file may carry besides id and text.
OPTIONAL_TEXT = ("supercategory", "category", "iconic_group")


def read_csv_drop_index(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with header; an unnamed first column (a saved index) is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    table = reader.schema(schema).csv(path) if schema else reader.csv(path)
    first = table.columns[0]
    return table.drop(first) if first in ("", "_c0", "Unnamed: 0") else table


def relevant_ids_by_query(annotations: DataFrame) -> DataFrame:
    """``query_id, relevant_ids``: sorted distinct paths per query, as the query table stores them.

    The list is one cell of the result. To score against more annotations than a row should hold,
    use the long form (``plans.scoring.pairs_of_annotations``).
    """
    missing = {"query_id", "image_path"} - set(annotations.columns)
    if missing:
        raise ValueError(f"Annotation columns missing: {', '.join(sorted(missing))}")
    # Distinct pairs first: a query annotated many times shrinks before it is gathered.
    pairs = annotations.select(
        F.col("query_id").cast("int").alias("query_id"),
        F.col("image_path").cast("string").alias("path"),
    ).distinct()
    return pairs.groupBy("query_id").agg(F.array_sort(F.collect_list("path")).alias("relevant_ids"))


def clean_queries(queries: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """First row per ``query_id``, integer id, trimmed text."""
    if not {"query_id", "query_text"} <= set(queries.columns):
        raise ValueError("Query CSV must include 'query_id' and 'query_text'.")
    return dedup_queries(queries, order).withColumns(
        {
            "query_id": F.col("query_id").cast("int"),
            "query_text": strip(F.col("query_text").cast("string")),
        }
    )


def dedup_queries(queries: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    return keep_first_row(queries, ["query_id"], order or ["query_text"])


def fill_optional(df: DataFrame, columns: Sequence[str] = OPTIONAL_TEXT) -> DataFrame:
    """Null to empty text in the optional columns that are present."""
    present = {
        name: F.coalesce(F.col(name).cast("string"), F.lit(""))
        for name in columns
        if name in df.columns
    }
    return df.withColumns(present) if present else df


def join_annotations(queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """Every query with its labels; a query without annotations gets an empty list."""
    none = F.array().cast("array<string>")
    return queries.join(relevant, "query_id", "left").withColumn(
        "relevant_ids", F.coalesce("relevant_ids", none)
    )
