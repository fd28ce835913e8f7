from __future__ import annotations

import pytest

from nearfield.llm import decontaminate

ITEMS = [
    (0, "A train leaves the station with Alice and 25 bags while Bob and 30 km of track wait for Alice to come home"),
    (1, "the quick brown fox jumps over the lazy dog near the river bank at dawn"),
    (2, "only six small words stand here"),
    (3, "too short text"),
    (4, None),
    (5, ""),
    (6, "1 2 3 4 5 6 7 8 9 10 11 12"),
    (1, "the quick brown fox jumps over the lazy dog near the river bank at dawn"),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_pairs(make_docs, benchmark, prose):
    renamed = ITEMS[0][1].replace("Alice", "Carol").replace("Bob", "Dave").replace("25", "47").replace("30", "1,200")
    mixed = ITEMS[0][1].replace("Alice", "Carol", 1)  # one slot with two values: 31 % of the windows hold
    rows = [
        (1, prose(40, 1) + " " + ITEMS[1][1] + " " + prose(40, 2)),
        (2, "Intro. " + ITEMS[0][1].upper().lower() + "."),
        (3, prose(9, 3) + ", " + renamed + " " + prose(9, 4)),
        (4, prose(9, 5) + ", " + mixed + " " + prose(9, 6)),
        (5, prose(200, 7)),
        (6, "9 8 7 6 5 4 3 2 1 0 1 2 3"),
        (7, None),
        (8, ""),
        (9, "Before Only six small words stand here, after"),
        (10, "too short text"),
        (11, ITEMS[1][1]),
        (11, ITEMS[1][1]),
        (None, ITEMS[1][1]),
        (12, " ".join(ITEMS[1][1].split()[:9]) + " " + prose(300, 8)),
    ]
    docs = make_docs(rows)
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert pairs == {(1, 1), (3, 0), (4, 0), (9, 2), (11, 1), (None, 1)}
    left = decontaminate.without_benchmark(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 5, 6, 7, 8, 10, 12]


def test_templates_and_values_have_the_same_tokens(make_docs):
    texts = [
        "In 1,234.5 km he met Ann, then O'Brien; it's 5kg or 5 kg, İstanbul x1.5b 3.4.5 Two cats.",
        "é 1 000 and Ünal 12% A B",
    ]
    docs = make_docs(list(enumerate(texts)))
    rows = docs.select(
        decontaminate.template(docs.text).alias("t"), decontaminate.values(docs.text).alias("v")
    ).collect()
    for r in rows:
        assert len(r["t"]) == len(r["v"])
    assert any(decontaminate.NUMBER in r["t"] and decontaminate.UNIT in r["t"] for r in rows)


def test_units_written_to_their_numbers(spark, make_docs):
    text = "a shop sells 5kg of rice and 7kg of beans on the 10th day"
    items = spark.createDataFrame([(0, text), (1, text.replace("kg", " kg"))], "item_id bigint, text string")
    docs = make_docs([(1, text.replace("5kg", "6kg").replace("7kg", "9KG").replace("10th", "21st"))])
    got = decontaminate.contaminated(docs, items).collect()
    assert {r["item_id"] for r in got} == {0, 1}
    docs = make_docs([(1, text.replace("5kg", "6kg").replace("7kg", "9 kg"))])
    assert all(r["matched"] == r["windows"] for r in decontaminate.contaminated(docs, items).collect())


def test_very_long_text(make_docs, benchmark, prose):
    text = prose(60_000, 1) + " " + ITEMS[1][1] + " " + prose(60_000, 2)
    got = decontaminate.contaminated(make_docs([(1, text), (2, prose(60_000, 3))]), benchmark)
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(1, 1)]


def test_empty_sides(make_docs, benchmark):
    docs = make_docs([(1, ITEMS[1][1])])
    assert decontaminate.contaminated(docs.limit(0), benchmark).collect() == []
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []
    assert decontaminate.without_benchmark(docs, benchmark.limit(0)).count() == 1
