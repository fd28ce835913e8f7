from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import rows_of

from nearfield.llm import mixing


def by_loop(sizes):
    """Targets by sharing the excess again and again; sources in order, None last."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sources", [["b", "a", None, "é"], ["x"], ["a"] * 9 + ["b", "c"]])
def test_targets_and_taken_words(make_docs, prose, sources):
    rows = [(i, prose(5 + i * 7 % 60, i)) for i in range(400)]
    docs = make_docs(rows, sources)
    mixed = mixing.mix(docs).selectExpr(
        "rec.source", "size", "source_size", "target", "copies"
    ).collect()
    assert len(mixed) == 400
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in mixed:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    assert {r["source"]: r["source_size"] for r in mixed} == sizes
    assert target == pytest.approx(by_loop(sizes))
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 64


def test_repeatable_and_rows_come_back_whole(make_docs, prose):
    rows = [(i, prose(20, i)) for i in range(60)]
    one = make_docs(rows, ["a", "b"], parts=1)
    two = make_docs(rows, ["a", "b"], parts=5)
    columns = ["rec.doc_id", "copies"]
    assert rows_of(mixing.mix(one), *columns) == rows_of(mixing.mix(two), *columns)
    mixed = mixing.repeated(mixing.mix(one))
    assert mixed.columns == one.columns
    copies = sum(c for _, c in rows_of(mixing.mix(one), *columns))
    assert mixed.count() == copies


def test_repeated_rows_are_drawn_one_by_one(make_docs):
    docs = make_docs([(7, "one two three four")] * 90 + [(8, "other words")] * 10, ["a"] * 9 + ["b"])
    mixed = mixing.mix(docs).selectExpr("rec.source", "size", "target", "copies").collect()
    for source in "ab":
        own = [r for r in mixed if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 4


def test_empty_texts_and_tables(make_docs):
    docs = make_docs([(1, None), (2, ""), (3, " \n"), (None, "a b c"), (5, "d e f g")], ["a", None])
    got = {r["doc_id"]: r for r in mixing.mix(docs).selectExpr("rec.doc_id", "*").collect()}
    assert [got[i]["size"] * got[i]["copies"] for i in (1, 2, 3)] == [0, 0, 0]
    assert got[None]["size"] == 3
    blank = make_docs([(1, None), (2, "")])
    assert [r["target"] for r in mixing.mix(blank).collect()] == [0.0, 0.0]
    assert mixing.mix(blank.limit(0)).collect() == []
