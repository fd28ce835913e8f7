"""Method settings, comparisons, whole runs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.plans.evaluate import Evaluation, evaluate_methods, evaluate_run, report_table
from nearfield.plans.methods import (
    METHOD_PRESETS,
    FlatOrLists,
    GraphSettings,
    TreeSettings,
    distinct_metrics,
    expand_methods,
    hash_tables,
    settings_of,
)
from nearfield.sources.embeddings import CorpusSpec, QuerySpec


def test_settings_are_checked():
    for bad in (
        {"method": "tree"},
        {"metric": "dot"},
        {"nlist": 0},
        {"nprobe": -1},
        {"nlist": 4, "nprobe": 5},
        {"m": 0},
        {"nbits": 0},
        {"backend": "scann", "num_leaves": 0},
        {"backend": "scann", "num_leaves_to_search": 3},
        {"backend": "scann", "reorder_k": 0},
        {"backend": "scann", "num_neighbors": 0},
        {"backend": "hnswlib", "ef_search": 0},
        {"backend": "hnswlib", "m": 0},
        {"backend": "other"},
    ):
        with pytest.raises(ValueError):
            settings_of(bad)
    assert settings_of({"unknown": 1, "metric": "COSINE"}).normalize is True
    assert FlatOrLists().normalize is False and FlatOrLists(method="IVF_Flat").method == "ivf_flat"
    assert FlatOrLists(nlist="64", nprobe="8").nlist == 64
    tree = TreeSettings(num_leaves=10, num_leaves_to_search=50)
    assert tree.num_leaves_to_search == 10
    assert GraphSettings.from_mapping({"normalise": True}).normalize is True
    assert hash_tables(32, 128, 1000).tables > hash_tables(16, 50, 1000).tables


def test_expansion():
    assert expand_methods([{"method": "flat", "use_gpu": True}, {"backend": "ScaNN"}]) == [
        {"backend": "faiss", "method": "flat", "use_gpu": False},
        {"backend": "scann", "use_gpu": False},
    ]
    assert distinct_metrics([{"metric": "IP"}, {}, {"metric": "l2"}]) == ["ip", "l2"]
    assert distinct_metrics([]) == ["l2"]
    for methods in METHOD_PRESETS.values():
        assert all(settings_of(method).metric == "cosine" for method in methods)
    assert len(METHOD_PRESETS["default"]) == 5


@pytest.fixture(scope="module")
def labelled(spark, vectors):
    queries = vectors(np.eye(3), "qid", "q-").withColumns(
        {
            "query_index": F.substring("qid", 3, 9).cast("long"),
            "relevant": F.array(F.concat(F.lit("img-"), F.substring("qid", 3, 9), F.lit(".JPG"))),
            "query_text": F.col("qid"),
        }
    )
    return vectors(np.eye(3), prefix="img-"), queries


def test_every_backend_gives_a_row(labelled):
    gallery, queries = labelled
    outcome = evaluate_methods(
        gallery,
        queries,
        [
            {"method": "flat", "metric": "l2"},
            {"method": "ivf_flat", "metric": "cosine", "nlist": 2, "nprobe": 2},
            {"method": "ivf_pq", "metric": "l2", "nlist": 1, "nprobe": 1, "m": 3, "nbits": 2},
            {"method": "hnsw", "metric": "l2", "ef_search": 128},
            {"backend": "scann", "name": "tree", "num_leaves": 2, "metric": "l2"},
            {"backend": "hnswlib", "metric": "cosine", "ef_search": 128},
        ],
        top_k=1,
        recall_at=[1],
        relevance="relevant",
        bruteforce=["l2"],
    )
    rows = outcome.summary.collect()
    assert [(r["backend"], r["method"]) for r in rows] == [
        ("faiss", "flat"),
        ("faiss", "ivf_flat"),
        ("faiss", "ivf_pq"),
        ("faiss", "hnsw"),
        ("scann", "tree"),
        ("hnswlib", "hnswlib"),
        ("bruteforce", "bruteforce"),
    ]
    for row in rows:
        assert row["accuracy"] == 1.0 and row["recall@1"] == 1.0, row
        assert row["ntotal"] == 3 and row["num_queries"] == 3 and row["top_k"] == 1
        assert row["avg_query_time"] == pytest.approx(row["search_time"] / 3)
    details = outcome.details.collect()
    assert len(details) == 21 and all(r["is_relevant"] for r in details)
    assert {r["query_text"] for r in details} == {"q-0", "q-1", "q-2"}
    text = report_table(outcome.summary, [1, 7]).collect()
    assert text[0]["accuracy"] == "1.0000" and text[0]["recall@7"] == "-"
    unscored = outcome.summary.withColumn("accuracy", F.lit(None).cast("double"))
    assert "accuracy" not in report_table(unscored, []).columns


def test_dimension_mismatch(labelled, vectors):
    gallery, _ = labelled
    queries = vectors(np.eye(2), "qid").withColumn("query_index", F.lit(0))
    with pytest.raises(ValueError, match="dimension 3, received 2"):
        evaluate_methods(gallery, queries, [{"method": "flat"}], top_k=1)


def test_whole_run(spark, labelled, tmp_path):
    gallery, queries = labelled
    gallery.withColumnRenamed("id", "image_id").write.parquet(str(tmp_path / "g"))
    queries.select(F.col("qid").alias("query_id"), "embedding", "relevant").write.parquet(
        str(tmp_path / "q")
    )
    outcome = evaluate_run(
        spark,
        CorpusSpec(load_from_disk=str(tmp_path / "g"), id_column="image_id"),
        QuerySpec(
            load_from_disk=str(tmp_path / "q"), id_column="query_id", relevance_column="relevant"
        ),
        Evaluation(
            methods=[{"method": "flat", "metric": "l2"}],
            top_k=1,
            recall_at=[1],
            output_path=str(tmp_path / "summary"),
            details_path=str(tmp_path / "tables"),
        ),
    )
    rows = outcome.summary.collect()
    assert [r["method"] for r in rows] == ["flat", "bruteforce"]
    assert {(r["num_queries"], r["top_k"], r["recall@1"], r["accuracy"]) for r in rows} == {
        (3, 1, 1.0, 1.0)
    }
    back = spark.read.option("header", True).csv(str(tmp_path / "summary"))
    assert back.columns == outcome.summary.columns and back.count() == 2
    details = spark.read.parquet(str(tmp_path / "tables" / "details"))
    assert details.count() == 6 and details.columns[0] == "query_index"
    assert sorted({r["query_index"] for r in details.collect()}) == [0, 1, 2]


def test_the_summary_starts_no_python_workers(spark, vectors):
    """its few rows came through Python workers that stayed beside those of the searches."""
    gallery = vectors(np.eye(4))
    asked = vectors(np.eye(4), "qid").withColumn("query_index", F.lit(0))
    found = evaluate_methods(gallery, asked, [{"method": "flat", "metric": "l2"}], top_k=1).summary
    assert "Python" not in found._jdf.queryExecution().toRdd().toDebugString()
    assert [(r["method"], r["ntotal"], r["accuracy"]) for r in found.collect()] == [("flat", 4, None)]
    assert evaluate_methods(gallery, asked, [], top_k=1).summary.collect() == []


def test_derived_queries_are_computed_once(vectors, spark):
    """F1: every method and score computed the query table again."""
    matrix = np.random.default_rng(8).normal(size=(40, 4))
    seen = spark.sparkContext.accumulator(0)

    def derive(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    asked = vectors(matrix, "qid").withColumn("query_index", F.lit(0).cast("long"))
    derived = asked.mapInArrow(derive, asked.schema)
    methods = [{"method": "flat", "metric": "l2"}, {"method": "flat", "metric": "ip"}]
    found = evaluate_methods(vectors(matrix), derived, methods, top_k=3)
    assert found.summary.count() == 2 and found.details.count() == 2 * 40 * 3
    assert seen.value == 40
