from __future__ import annotations

import random

import brute
import pytest

from nearfield.llm import quality

NAMES = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()


@pytest.fixture
def labelled(spark, prose):
    """Clean prose, and prose with symbols on every word."""
    rows, labels = [], []
    for i in range(120):
        text = prose(60 + i % 7, i)
        if i % 3 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text))
        labels.append((i, 0 if i % 3 == 0 else 1, 0))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a b c a b c"),
    (5, "x\nx\n \n\nx y\nx"),
    (6, "un deux \x1c trois é#|<>"),
    (7, "a a a a a " * 30),
    (8, ("ab cd " * 9 + "é ") * 4000),
    (8, "again 8"),
    (None, "null id " * 30),
]


def test_counts(make_docs):
    docs = make_docs(EDGES)
    got = quality.judged(docs, None)
    found = sorted((tuple(r[c] for c in NAMES) for r in got.collect()))
    assert found == sorted(brute.rule_counts(t) for _, t in EDGES)
    assert all(r["kept"] == (not r["base_failed"]) for r in got.collect())


def test_random_counts():
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choices("ab \n\té# ", k=draw.randint(0, 80)))
        parsed = quality.parse(text.encode())
        assert quality.counts(text.encode(), parsed) == brute.rule_counts(text)[:5]


def test_classifier_on_unseen_documents(make_docs, labelled, prose):
    rows, labels = labelled
    model = quality.train(make_docs(rows), labels)
    fresh = [(i, prose(70, i)) for i in range(500, 520)]
    junk = [(i, " ".join(w + "%%%" for w in prose(70, i).split())) for i in range(600, 620)]
    docs = make_docs(fresh + junk)
    kept = {r["doc_id"] for r in quality.judged(docs, model).where("kept").collect()}
    assert kept == {i for i, _ in fresh}
    stage = quality.keep_good(docs, model)
    assert stage.columns == docs.columns
    assert {r["doc_id"] for r in stage.collect()} == kept


def test_training_is_bounded_and_repeatable(make_docs, labelled):
    rows, labels = labelled
    one = quality.train(make_docs(rows, parts=1), labels, rows=60)
    two = quality.train(make_docs(rows, parts=5), labels.repartition(3), rows=60)
    assert (one.weights == two.weights).all()
    assert one.slope > 0


def test_without_labels_or_rows(spark, make_docs, labelled):
    rows, labels = labelled
    assert quality.train(make_docs(rows), labels.where("quality = 1")) is None
    assert quality.train(make_docs(rows), labels.limit(0)) is None
    assert quality.train(make_docs(rows), labels.selectExpr("doc_id", "CAST(NULL AS INT) quality")) is None
    empty = make_docs([(1, "x")]).limit(0)
    assert quality.judged(empty, None).collect() == []
    assert quality.train(empty, labels) is None
