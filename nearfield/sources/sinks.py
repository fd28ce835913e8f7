"""Where results go: embedding tables, split shards, reports, published layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.schema import CAPTION_EMBEDDING, IMAGE_EMBEDDING, require_columns, require_positive


def _write_embeddings(df: DataFrame, columns: Sequence[str], path: str, mode: str) -> None:
    require_columns(df, *columns)
    (
        df.select(*columns)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("model_name", "dataset_name")
        .parquet(path)
    )


def write_image_embeddings(df: DataFrame, path: str, mode: str = "append") -> None:
    _write_embeddings(df, IMAGE_EMBEDDING.fieldNames(), path, mode)


def write_caption_embeddings(df: DataFrame, path: str, mode: str = "append") -> None:
    _write_embeddings(df, CAPTION_EMBEDDING.fieldNames(), path, mode)


def write_split_shards(
    df: DataFrame, path: str, *, chunk_size: int, overwrite: bool = False
) -> None:
    """``split=<name>/`` folders of files with at most ``chunk_size`` rows.

    A split without rows writes no file; an existing target is an error unless ``overwrite``.
    """
    require_positive(chunk_size=chunk_size)
    require_columns(df, "split")
    (
        df.write.mode("overwrite" if overwrite else "errorifexists")
        .option("maxRecordsPerFile", int(chunk_size))
        .partitionBy("split")
        .parquet(path)
    )


def write_summary_csv(rows: Sequence[DataFrame], path: str, mode: str = "overwrite") -> None:
    """One CSV whose columns are the union of the parts, in first-seen order."""
    table = union_all(rows)
    # One row per method: a single file is the point of the report.
    table.coalesce(1).write.mode(mode).option("header", True).csv(path)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def write_detail_tables(
    summary: DataFrame, details: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    """Two tables side by side: ``summary`` and ``details`` (headers stay when empty)."""
    from nearfield.plans.scoring import order_detail_columns

    summary.write.mode(mode).parquet(f"{path}/summary")
    details.select(*order_detail_columns(details.columns)).write.mode(mode).parquet(
        f"{path}/details"
    )


def publish_configs(
    spark: SparkSession, configs: dict[str, DataFrame], root: str, overwrite: bool = False
) -> DataFrame:
    """Write ``<root>/<config>/split=.../`` and read it back: ``config, split, written, found``."""
    checks = []
    for name, table in configs.items():
        whole = table if "split" in table.columns else table.withColumn("split", F.lit("train"))
        whole.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(
            "split"
        ).parquet(f"{root}/{name}")
        back = spark.read.parquet(f"{root}/{name}")
        sides = [
            table_.groupBy("split").agg(
                F.count("*").alias("n"), F.lit(side).alias("side")
            )
            for side, table_ in (("written", whole), ("found", back))
        ]
        checks.append(
            union_all(sides)
            .groupBy("split")
            .agg(*[F.sum(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in ("written", "found")])
            .select(F.lit(name).alias("config"), "split", "written", "found")
        )
    return union_all(checks)
