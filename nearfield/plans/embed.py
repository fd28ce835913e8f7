"""Embedding jobs: every model over every dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.encoders import Encoder, encode_column
from nearfield.schema import CAPTION_EMBEDDING, IMAGE_EMBEDDING
from nearfield.sources.sinks import union_all


def embed_images(
    models: Sequence[Encoder], datasets: Mapping[str, DataFrame], *, tasks: int | None = None
) -> DataFrame:
    """``id, model_name, dataset_name, embedding`` for ``id, image`` tables.

    One narrow pass per model and dataset. ``tasks`` spreads a source that arrives in few splits
    over more encoder workers.
    """
    parts = []
    for model in models:
        for name, table in datasets.items():
            rows = table.select("id", "image")
            encoded = encode_column(rows.repartition(tasks) if tasks else rows, "image", model)
            parts.append(
                encoded.select(
                    F.col("id").cast("string").alias("id"),
                    F.lit(model.name).alias("model_name"),
                    F.lit(name).alias("dataset_name"),
                    "embedding",
                )
            )
    return union_all(parts).select(*IMAGE_EMBEDDING.fieldNames())


def embed_texts(
    models: Sequence[Encoder], captions: DataFrame, dataset_name: str, *, tasks: int | None = None
) -> DataFrame:
    """Caption rows with their vectors; the metadata travels with the row."""
    parts = []
    for model in models:
        rows = captions.repartition(tasks) if tasks else captions
        encoded = encode_column(rows, "caption", model)
        parts.append(
            encoded.withColumnRenamed("caption_id", "id").withColumns(
                {"model_name": F.lit(model.name), "dataset_name": F.lit(dataset_name)}
            )
        )
    return union_all(parts).select(*CAPTION_EMBEDDING.fieldNames())
