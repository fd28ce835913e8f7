"""Query preparation as one job: clean, limit, annotate, encode, normalise, write per split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.encoders import Encoder, encode_column
from nearfield.functions.vectors import l2_normalize
from nearfield.operators.dedup import head_limit
from nearfield.sources.csv import (
    OPTIONAL_TEXT,
    clean_queries,
    fill_optional,
    join_annotations,
    relevant_ids_by_query,
)
from nearfield.sources.sinks import union_all, write_split_shards


def prepare_split(
    queries: DataFrame,
    annotations: DataFrame,
    encoder: Encoder,
    *,
    split: str,
    dataset_name: str,
    limit: int | None = None,
    order: Sequence[str] = ("query_id",),
) -> DataFrame:
    """One split's queries as shards hold them: ids, text, labels and unit vectors.

    ``queries`` holds ``query_id, query_text`` and optional text columns, ``annotations``
    ``query_id, image_path``. The first row of a query id by ``order`` stays.
    """
    first = head_limit(clean_queries(queries, order), order, limit)
    full = fill_optional(join_annotations(first, relevant_ids_by_query(annotations)))
    optional = [name for name in OPTIONAL_TEXT if name in full.columns]
    encoded = encode_column(full, "query_text", encoder)
    return encoded.select(
        F.col("query_id").cast("string").alias("id"),
        F.col("query_id").cast("bigint").alias("query_id"),
        "query_text",
        F.lit(encoder.name).alias("model_name"),
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(split).alias("split"),
        F.col("relevant_ids").alias("image_id"),
        *optional,
        l2_normalize(F.col("embedding")).cast("array<float>").alias("embedding"),
    )


def prepare_queries(
    splits: Mapping[str, tuple[DataFrame, DataFrame]],
    encoder: Encoder,
    path: str,
    *,
    dataset_name: str,
    limit: int | None = None,
    chunk_size: int = 10_000,
    overwrite: bool = False,
) -> None:
    """Prepare every split (queries, annotations) and write folders of bounded files."""
    parts = [
        prepare_split(
            queries, annotations, encoder, split=split, dataset_name=dataset_name, limit=limit
        )
        for split, (queries, annotations) in splits.items()
    ]
    write_split_shards(union_all(parts), path, chunk_size=chunk_size, overwrite=overwrite)
