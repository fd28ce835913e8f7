"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import broadcast

from nearfield.session import shared_dir

# A word: a run of characters other than space and the five ASCII controls that break lines.
WORD = r"[^\x20\x09-\x0D]+"

# Estimated bytes of a table that is still sent to every executor.
BROADCAST_BYTES = 96 << 20

# The test tables as declared; a declared schema spares the scan of file footers.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the scratch space that the driver and all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a table in the shared folder: nothing upstream is computed twice."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_name(taken: list[str], stem: str) -> str:
    """A column name that no column of the input has (names compare without case)."""
    used = {name.lower() for name in taken}
    name = stem
    while name.lower() in used:
        name = f"_{name}"
    return name


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where counted rows and bytes stay within bounds; else a shuffled join.

    ``df`` should be a written table, as it is counted here and read again by the join.
    """
    width = F.lit(16 + 8 * len(df.columns))
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(F.struct(column))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        width = width + F.coalesce(F.octet_length(column), F.lit(0))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("bytes")).first()
    return broadcast(df) if size["n"] <= rows and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def picked(docs: DataFrame, ids: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows whose key is in ``ids`` (distinct, written): in place where the ids are few."""
    return docs.join(small(ids, rows), key, "left_semi")


def words_in(text: Column) -> Column:
    """Number of words; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lowered(text: Column) -> Column:
    """A-Z to lower case and nothing else, unlike ``lower``."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
