"""Hits against relevance labels: flags, accuracy, recall, audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.labels import normalize_label, serialize_metadata, truth_info

# Query columns carried into audit rows, and the order of the audit columns.
QUERY_METADATA = ("query_id", "query_text", "split", "supercategory", "category", "iconic_group")
DETAIL_ORDER = (
    "query_index",
    "query_embedding_id",
    "query_id",
    "query_text",
    "split",
    "supercategory",
    "category",
    "iconic_group",
    "backend",
    "method",
    "method_label",
    "metric",
    "use_gpu",
    "top_k",
    "rank",
    "image_id",
    "distance",
    "is_relevant",
    "relevant_ids",
    "relevant_count",
)


def recall_points(points: Sequence[int] | None) -> list[int]:
    return sorted({int(p) for p in points or () if int(p) > 0})


def effective_k(top_k: int, recall_at: Sequence[int]) -> int:
    return max(int(top_k), max((int(p) for p in recall_at), default=0))


def truth_pairs(queries: DataFrame, relevance: str) -> DataFrame:
    """Normalised labels in long form, ``qid, label``, each pair once."""
    return truth_info(queries, relevance).select("qid", F.explode("normalised").alias("label"))


def pairs_of_annotations(annotations: DataFrame) -> DataFrame:
    """The same long form straight from ``query_id, image_path`` rows.

    No list per query is built, so a query that owns most of the annotations stays spread out.
    """
    label = normalize_label(F.col("image_path").cast("string"))
    named = annotations.select(F.col("query_id").cast("string").alias("qid"), label.alias("label"))
    return named.distinct()


def join_truth(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Flag hits whose normalised id is one of the query's labels.

    The join key is (qid, label): a query with very many labels is spread out instead of being
    searched row by row. An equal raw label always has an equal normalised form, so one equi join
    covers both tests.
    """
    wanted = pairs.select("qid", "label").withColumn("_hit", F.lit(True))
    return (
        hits.withColumn("label", normalize_label(F.col("id").cast("string")))
        .join(wanted, ["qid", "label"], "left")
        .withColumn("is_relevant", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def score_queries(
    flagged: DataFrame, asked: DataFrame, pairs: DataFrame, points: Sequence[int]
) -> DataFrame:
    """Per query: any relevant hit, and found / relevant labels at every recall point.

    A label counts from its best rank on, so one pass serves all points.
    """
    points = recall_points(points)
    best = (
        flagged.where("is_relevant").groupBy("qid", "label").agg(F.min("rank").alias("first_rank"))
    )
    found = best.groupBy("qid").agg(
        F.lit(True).alias("any_hit"),
        *[F.count(F.when(F.col("first_rank") <= p, 1)).alias(f"found@{p}") for p in points],
    )
    labels = pairs.groupBy("qid").agg(F.count("*").alias("n_labels"))
    per_query = asked.select("qid").join(labels, "qid", "left").join(found, "qid", "left")
    return per_query.select(
        "qid",
        F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        F.coalesce("any_hit", F.lit(False)).alias("any_hit"),
        *[
            F.when(
                F.col("n_labels") > 0,
                F.coalesce(F.col(f"`found@{p}`"), F.lit(0)) / F.col("n_labels"),
            ).alias(f"recall@{p}")
            for p in points
        ],
    )


def summarise(per_query: DataFrame, points: Sequence[int]) -> DataFrame:
    """Accuracy over all queries; recall over the queries that have labels."""
    return per_query.agg(
        F.avg(F.col("any_hit").cast("double")).alias("accuracy"),
        *[F.avg(F.col(f"`recall@{p}`")).alias(f"recall@{p}") for p in recall_points(points)],
        F.count("*").alias("num_queries"),
    )


def score_hits(
    hits: DataFrame,
    queries: DataFrame,
    relevance: str | None,
    points: Sequence[int],
    pairs: DataFrame | None = None,
) -> DataFrame:
    """One row: ``accuracy, recall@p..., num_queries``; null scores when there is no truth.

    Truth is a column of ``queries`` or, in long form, ``pairs`` of ``qid, label``.
    """
    points = recall_points(points)
    if relevance is None and pairs is None:
        nothing = F.lit(None).cast("double")
        return queries.agg(
            nothing.alias("accuracy"),
            *[nothing.alias(f"recall@{p}") for p in points],
            F.count("*").alias("num_queries"),
        )
    if pairs is None:
        pairs = truth_pairs(queries, relevance)
    return summarise(score_queries(join_truth(hits, pairs), queries, pairs, points), points)


def metadata_columns(columns: Sequence[str], exclude: Sequence[str]) -> list[str]:
    """Preferred query columns that are present and not id, vector or labels."""
    return [name for name in QUERY_METADATA if name in columns and name not in exclude]


def query_metadata(queries: DataFrame, exclude: Sequence[str], key: str = "qid") -> DataFrame:
    wanted = [name for name in metadata_columns(queries.columns, exclude) if name != key]
    return queries.select(key, *[serialize_metadata(queries, n).alias(n) for n in wanted])


def detail_rows(
    hits: DataFrame,
    queries: DataFrame,
    *,
    backend: str,
    method: str,
    metric: str,
    top_k: int,
    label: Column | None = None,
    relevance: str | None = None,
    exclude: Sequence[str] = ("embedding",),
) -> DataFrame:
    """One audit row per hit; a query without hits keeps one row with a null rank.

    ``queries`` holds ``qid, query_index`` and optionally metadata and a truth column.
    """
    skip = [*exclude, *([relevance] if relevance else [])]
    wanted = metadata_columns(queries.columns, skip)
    base = queries if relevance is None else truth_info(queries, relevance)
    if relevance is None:
        flagged = hits.withColumn("is_relevant", F.lit(None).cast("boolean"))
        info = [
            F.lit(None).cast("string").alias("relevant_ids"),
            F.lit(None).cast("int").alias("relevant_count"),
        ]
        missing = F.lit(None).cast("boolean")
    else:
        labels = base.select("qid", F.explode("normalised").alias("label"))
        flagged = join_truth(hits, labels)
        info = [F.col("joined").alias("relevant_ids"), F.size("labels").alias("relevant_count")]
        missing = F.lit(False)
    asked = base.select(
        "qid",
        "query_index",
        *[serialize_metadata(base, name).alias(name) for name in wanted],
        *info,
    )
    found = flagged.select("qid", "rank", F.col("id").alias("image_id"), "score", "is_relevant")
    rows = asked.join(found, "qid", "left").select(
        "*",
        F.col("qid").cast("string").alias("query_embedding_id"),
        F.lit(backend).alias("backend"),
        F.lit(method).alias("method"),
        (label if label is not None else method_label(backend, method, metric)).alias(
            "method_label"
        ),
        F.lit(metric).alias("metric"),
        F.lit(False).alias("use_gpu"),
        F.lit(int(top_k)).alias("top_k"),
        F.col("score").alias("distance"),
        F.coalesce("is_relevant", missing).alias("_relevant"),
    )
    rows = rows.drop("qid", "score", "is_relevant").withColumnRenamed("_relevant", "is_relevant")
    rows = rows.withColumn("image_id", F.col("image_id").cast("string"))
    return rows.select(*order_detail_columns(rows.columns))


def method_label(backend: str, method: str, metric: str) -> Column:
    return F.lit(f"{backend}/{method} ({metric})")


def order_detail_columns(columns: Sequence[str]) -> list[str]:
    first = [name for name in DETAIL_ORDER if name in columns]
    return first + sorted(set(columns) - set(first))
