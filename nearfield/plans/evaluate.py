"""Compare search methods on one corpus: timings, accuracy, recall, audit rows."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearfield.functions.ids import row_index
from nearfield.operators.knn import Limits, nearest
from nearfield.plans.methods import (
    Prepared,
    distinct_metrics,
    expand_methods,
    method_name,
    settings_of,
)
from nearfield.plans.scoring import (
    detail_rows,
    effective_k,
    metadata_columns,
    recall_points,
    score_hits,
)
from nearfield.schema import require_unique, vector_stats
from nearfield.session import materialise
from nearfield.sources.embeddings import (
    CorpusSpec,
    QuerySpec,
    project_embeddings,
    read_embeddings,
    relevance_labels,
)
from nearfield.sources.sinks import union_all, write_detail_tables, write_summary_csv


@dataclass(frozen=True)
class Evaluation:
    methods: Sequence[Mapping[str, Any]] = field(default_factory=lambda: [{"method": "flat"}])
    top_k: int = 10
    recall_at: Sequence[int] = (1, 5)
    output_path: str | None = None
    details_path: str | None = None


@dataclass(frozen=True)
class Outcome:
    summary: DataFrame
    details: DataFrame


def summary_schema(points: Sequence[int]) -> T.StructType:
    """Columns of the summary table, recall columns in increasing order."""
    kinds = {
        "backend": T.StringType(),
        "method": T.StringType(),
        "metric": T.StringType(),
        "use_gpu": T.BooleanType(),
        "index_time": T.DoubleType(),
        "search_time": T.DoubleType(),
        "avg_query_time": T.DoubleType(),
        "accuracy": T.DoubleType(),
        "ntotal": T.LongType(),
        **{f"recall@{p}": T.DoubleType() for p in recall_points(points)},
        "num_queries": T.LongType(),
        "top_k": T.IntegerType(),
    }
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def evaluate_methods(
    gallery: DataFrame,
    queries: DataFrame,
    methods: Sequence[Mapping[str, Any]],
    *,
    top_k: int,
    recall_at: Sequence[int] = (),
    relevance: str | None = None,
    bruteforce: Sequence[str] = (),
    limits: Limits | None = None,
) -> Outcome:
    """Build, search and score each method; ``bruteforce`` adds an exact run per metric.

    ``queries`` holds ``qid, query_index, embedding`` and optionally metadata and labels. Each
    method's hits are written once to the shared folder: scores and audit rows read them back.
    """
    spark = gallery.sparkSession
    points = recall_points(recall_at)
    # Every method reads the queries several times, and they may be derived: computed once.
    queries = materialise(queries)
    total, dim = vector_stats(gallery)
    _, q_dim = vector_stats(queries)
    if total and q_dim and dim != q_dim:
        raise ValueError(f"Expected vectors of dimension {dim}, received {q_dim}")
    rows, details = [], []

    def record(backend: str, name: str, metric: str, build, search) -> None:
        started = time.perf_counter()
        prepared = build()
        built = time.perf_counter()
        hits = materialise(search(prepared))
        searched = time.perf_counter()
        scores = score_hits(hits, queries, relevance, points).first().asDict()
        asked = scores["num_queries"]
        rows.append(
            {
                "backend": backend,
                "method": name,
                "metric": metric,
                "use_gpu": False,
                "index_time": built - started,
                "search_time": searched - built,
                "avg_query_time": (searched - built) / asked if asked else None,
                "ntotal": total,
                "top_k": int(top_k),
                **scores,
            }
        )
        details.append(
            detail_rows(
                hits,
                queries,
                backend=backend,
                method=name,
                metric=metric,
                top_k=top_k,
                relevance=relevance,
            )
        )

    asked = queries.select("qid", "embedding")
    for method in expand_methods(methods):
        settings = settings_of(method)
        record(
            settings.backend,
            method_name(method, settings),
            settings.metric,
            lambda settings=settings: Prepared(settings, gallery, limits),
            lambda prepared: prepared.search(asked, top_k),
        )
    for metric in bruteforce:
        record(
            "bruteforce",
            "bruteforce",
            metric,
            lambda: None,
            lambda _, metric=metric: nearest(gallery, asked, top_k, metric, limits=limits),
        )
    schema = summary_schema(points)
    # As an Arrow table: rows of plain Python would start workers of their own beside the searches'.
    listed = pa.Table.from_pylist(rows, to_arrow_schema(schema))
    return Outcome(spark.createDataFrame(listed, schema), union_all(details) if details else None)


def load_gallery(spark: SparkSession, spec: CorpusSpec) -> DataFrame:
    return project_embeddings(
        read_embeddings(spark, spec), spec.id_column, spec.embedding_column
    )


def load_queries(spark: SparkSession, spec: QuerySpec) -> DataFrame:
    """``qid, query_index, embedding``, the preferred metadata and ``relevant_labels``."""
    table = read_embeddings(spark, spec)
    skip = [spec.id_column, spec.embedding_column, spec.relevance_column]
    keep = metadata_columns(table.columns, skip)
    if spec.relevance_column:
        labels = relevance_labels(table, spec.relevance_column)
        table = table.withColumn("relevant_labels", labels)
        keep.append("relevant_labels")
    # The index of a query is the position of its row: files by name, rows inside a file.
    place = ["_file", "_row"]
    table = table.withColumns(
        {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
    )
    vectors = project_embeddings(table, spec.id_column, spec.embedding_column, [*keep, *place])
    numbered = row_index(vectors.withColumnRenamed("id", "qid"), place, "query_index")
    return numbered.drop(*place)


def evaluate_run(
    spark: SparkSession, gallery: CorpusSpec, queries: QuerySpec, evaluation: Evaluation
) -> Outcome:
    """The whole run: read both corpora, evaluate, add exact baselines, write the reports."""
    rows = load_gallery(spark, gallery)
    require_unique(rows, "id")
    asked = load_queries(spark, queries)
    methods = expand_methods(evaluation.methods)
    outcome = evaluate_methods(
        rows,
        asked,
        methods,
        top_k=effective_k(evaluation.top_k, evaluation.recall_at),
        recall_at=evaluation.recall_at,
        relevance="relevant_labels" if queries.relevance_column else None,
        bruteforce=distinct_metrics(methods),
    )
    if evaluation.output_path:
        write_summary_csv([outcome.summary], evaluation.output_path)
    if evaluation.details_path:
        write_detail_tables(outcome.summary, outcome.details, evaluation.details_path)
    return outcome


def report_table(summary: DataFrame, recall_at: Sequence[int]) -> DataFrame:
    """Summary as text: four decimals, "-" for missing, accuracy only where it was measured."""
    columns = [
        "backend",
        "method",
        "metric",
        "use_gpu",
        "index_time",
        "search_time",
        "avg_query_time",
    ]
    if summary.where("accuracy is not null").head(1):
        columns.append("accuracy")
    columns += [f"recall@{p}" for p in sorted({int(p) for p in recall_at})]
    columns += ["top_k", "num_queries"]

    def shown(name: str):
        if name not in summary.columns:
            return F.lit("-").alias(name)
        column = F.col(f"`{name}`")
        if isinstance(summary.schema[name].dataType, T.DoubleType):
            column = F.format_string("%.4f", column)
            return F.when(F.col(f"`{name}`").isNull(), "-").otherwise(column).alias(name)
        return F.coalesce(column.cast("string"), F.lit("-")).alias(name)

    return summary.select(*[shown(name) for name in columns])
