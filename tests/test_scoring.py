"""Labels, accuracy, recall and audit rows on worked cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from nearfield.functions.ids import caption_id, file_stem, image_id_of
from nearfield.functions.labels import label_set, normalize_label, serialize_metadata, truth_info
from nearfield.plans.scoring import (
    DETAIL_ORDER,
    detail_rows,
    effective_k,
    join_truth,
    order_detail_columns,
    pairs_of_annotations,
    query_metadata,
    recall_points,
    score_hits,
)

HITS = "qid string, rank int, id string, score double"
TRUTH = "qid string, query_index long, relevant array<string>"


def score(spark, retrieved, truth, points=(1, 2, 5)):
    """Scores of one query."""
    hits = spark.createDataFrame(
        [("q", rank, name, 0.5) for rank, name in enumerate(retrieved, 1)], HITS
    )
    queries = spark.createDataFrame([("q", 0, truth)], TRUTH)
    return score_hits(hits, queries, "relevant", points).first().asDict()


@pytest.mark.parametrize(
    ("retrieved", "truth", "accuracy", "recall"),
    [
        (["img-0"], ["img-0.jpg"], 1.0, {1: 1.0}),
        (["a"], ["A"], 0.0, {1: 0.0}),
        (["a"], None, 0.0, {1: None}),
        (["a"], [], 0.0, {1: None}),
        (["a.jpg", "a.png"], ["a", "b"], 1.0, {2: 0.5}),
        (["a"], ["a.jpg", "a.png"], 1.0, {1: 1.0}),
        (["x", "y", "a"], ["a"], 1.0, {1: 0.0, 5: 1.0}),
        ([], ["a"], 0.0, {1: 0.0, 2: 0.0}),
        (["d"], ["d.jpg.png"], 0.0, {1: 0.0}),
        (["a"], [" a "], 1.0, {1: 1.0}),
    ],
)
def test_worked_cases(spark, retrieved, truth, accuracy, recall):
    got = score(spark, retrieved, truth)
    assert got["accuracy"] == accuracy
    for point, value in recall.items():
        assert got[f"recall@{point}"] == value


def test_plain_string_truth(spark):
    hits = spark.createDataFrame([("q", 1, "a", 0.5)], HITS)
    queries = spark.createDataFrame([("q", " a ")], "qid string, relevant string")
    got = score_hits(hits, queries, "relevant", [1]).first()
    assert (got["accuracy"], got["recall@1"]) == (1.0, 1.0)


def test_no_truth_column(spark):
    hits = spark.createDataFrame([("q", 1, "a", 0.5)], HITS)
    queries = spark.createDataFrame([("q", 0)], "qid string, query_index long")
    got = score_hits(hits, queries, None, [1]).first()
    assert (got["accuracy"], got["recall@1"], got["num_queries"]) == (None, None, 1)
    row = detail_rows(
        hits, queries, backend="b", method="m", metric="l2", top_k=1
    ).first()
    assert (row["is_relevant"], row["relevant_ids"], row["relevant_count"]) == (None, None, None)


def test_denominators_differ(spark):
    """Accuracy counts every query, recall only those with labels."""
    hits = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 1, "x", 1.0)], HITS)
    queries = spark.createDataFrame([("a", 0, ["x"]), ("b", 1, []), ("c", 2, None)], TRUTH)
    got = score_hits(hits, queries, "relevant", [1]).first()
    assert got["accuracy"] == pytest.approx(1 / 3)
    assert got["recall@1"] == 1.0


def test_hit_ids_are_stripped_and_a_hot_query_keeps_all_labels(spark):
    labels = [f"n{i}.png" for i in range(5000)]
    hits = spark.createDataFrame([("q", i + 1, f" n{i}\t", 1.0) for i in range(100)], HITS)
    queries = spark.createDataFrame([("q", 0, labels)], TRUTH)
    got = score_hits(hits, queries, "relevant", [10, 100]).first()
    assert got["recall@10"] == pytest.approx(10 / 5000)
    assert got["recall@100"] == pytest.approx(100 / 5000)


def test_detail_rows(spark):
    hits = spark.createDataFrame(
        [("q-0", 1, "img-0", 0.0), ("q-0", 2, "img-1", 1.0), ("q-1", 1, "img-1", 0.0)], HITS
    )
    queries = spark.createDataFrame(
        [
            ("q-0", 0, ["img-0.jpg", "img-0.png"], "zero", ["a", "b"]),
            ("q-1", 1, ["img-1"], "one", None),
            ("q-2", 2, [], "two", []),
        ],
        TRUTH + ", query_text string, category array<string>",
    )
    details = detail_rows(
        hits, queries, backend="faiss", method="flat", metric="l2", top_k=2, relevance="relevant"
    )
    rows = {(r["query_embedding_id"], r["rank"]): r for r in details.collect()}
    assert len(rows) == 4
    first = rows["q-0", 1]
    assert first["is_relevant"] and first["relevant_count"] == 2
    assert first["relevant_ids"] == "img-0.jpg; img-0.png"
    assert first["query_text"] == "zero" and first["category"] == "a, b"
    assert first["method_label"] == "faiss/flat (l2)" and first["use_gpu"] is False
    assert not rows["q-0", 2]["is_relevant"]
    empty = rows["q-2", None]
    assert (empty["image_id"], empty["is_relevant"], empty["relevant_ids"]) == (None, False, None)
    assert empty["relevant_count"] == 0
    assert details.columns == [c for c in DETAIL_ORDER if c in details.columns]


def test_small_rules():
    assert recall_points([5, 1, 5, 0, -2]) == [1, 5]
    assert recall_points(None) == []
    assert effective_k(3, [1, 10]) == 10 and effective_k(3, []) == 3
    assert order_detail_columns(["zeta", "rank", "alpha", "query_index"]) == [
        "query_index",
        "rank",
        "alpha",
        "zeta",
    ]


def test_normalised_labels(spark):
    cases = {
        " img.JPG\n": "img",
        "img.jpeg": "img",
        "a.b.webp": "a.b",
        "img.gif": "img.gif",
        " x.png\t": "x",
        "x.png.jpg": "x.png",
        ".png": "",
        "x.png ": "x",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r[0]: r[1] for r in rows.select("raw", normalize_label(F.col("raw"))).collect()}
    assert got == cases


def test_label_sets_and_truth(spark):
    rows = spark.createDataFrame(
        [([" b", "a", "a "],), ([],), (None,), ([""],)], "labels_in array<string>"
    )
    got = [r for r in truth_info(rows, "labels_in").collect()]
    assert [sorted(r["labels"]) for r in got] == [["a", "b"], [], [], [""]]
    assert [r["joined"] for r in got] == ["a; b", None, None, ""]
    plain = spark.createDataFrame([("x ",), (None,)], "l string")
    assert [r[0] for r in plain.select(label_set(plain, "l")).collect()] == [["x"], []]


def test_metadata(spark):
    rows = spark.createDataFrame(
        [("q", ["a", None], {"k": "é"}, 3, 1)],
        "qid string, category array<string>, query_text map<string,string>, split int, other int",
    )
    assert query_metadata(rows, ["split"]).first().asDict() == {
        "qid": "q",
        "query_text": '{"k":"é"}',
        "category": "a, None",
    }
    assert rows.select(serialize_metadata(rows, "other")).first()[0] == 1


def test_stems_follow_path_rules(spark):
    from pathlib import PurePosixPath

    names = [
        "a/b/c.jpg", "c.tar.gz", ".hidden", "a/.hidden.png", "plain", "dir/", "a/./", "..", ".",
        "", "x.", "/", "a/b..jpg", "ü.ö.png", "two\nlines.jpg",
    ]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r[0]: r[1] for r in rows.select("p", file_stem(F.col("p"))).collect()}
    assert got == {n: PurePosixPath(n).stem for n in names}
    ids = {r[0]: r[1] for r in rows.select("p", image_id_of(F.col("p"))).collect()}
    assert ids[""] == "unknown" and ids["a/b/c.jpg"] == "c"
    assert rows.select(caption_id(F.lit("c"), F.lit(2))).first()[0] == "c#2"


def test_flags_match_a_plain_loop(spark):
    hits = spark.createDataFrame(
        [("q", i, name, 1.0) for i, name in enumerate(["a.png", "b", " c.JPEG ", "d"], 1)], HITS
    )
    truth = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "D")], "qid string, label string")
    flags = {r["rank"]: r["is_relevant"] for r in join_truth(hits, truth).collect()}
    assert flags == {1: True, 2: False, 3: True, 4: False}


def test_truth_in_long_form(spark):
    """A query that owns nearly all annotations is never gathered into one list."""
    marks = spark.range(4000).select(
        F.when(F.col("id") < 3999, "hot").otherwise("q2").alias("query_id"),
        F.concat(F.col("id") % 2000, F.lit(".jpg")).alias("image_path"),
    )
    pairs = pairs_of_annotations(marks)
    hits = spark.createDataFrame([("hot", i + 1, str(i), 1.0) for i in range(50)], HITS)
    queries = spark.createDataFrame([("hot",), ("q2",), ("q3",)], "qid string")
    got = score_hits(hits, queries, None, [10, 50], pairs=pairs).first()
    assert got["accuracy"] == pytest.approx(1 / 3)
    assert got["recall@50"] == pytest.approx((50 / 2000 + 0) / 2)
