from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from conftest import rows_of

from nearfield.llm import jaccard


def groups(docs):
    return rows_of(jaccard.linked_groups(docs), "doc_id", "n_shingles", "component_id")


def edited(text, edits, draw):
    out = text.split(" ")
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.random()
        if kind < 0.5:
            out[at] = f"w{draw.randrange(10**6)}"
        elif kind < 0.75:
            out.insert(at, f"w{draw.randrange(10**6)}")
        else:
            out.pop(at)
    return " ".join(out)


def test_near_copies_of_all_sizes(make_docs, prose):
    draw = random.Random(8)
    rows = []
    for seed in range(30):
        text = prose(draw.choice([1, 2, 3, 9, 11, 12, 14, 22, 31, 60, 150, 400]), seed)
        for _ in range(draw.randint(1, 6)):
            rows.append((len(rows), edited(text, draw.choice([0, 0, 1, 2, 4]), draw) if text else text))
    draw.shuffle(rows)
    assert groups(make_docs(rows)) == brute.linked_groups(rows)


def test_chains_link_through_others(make_docs, prose):
    base = prose(200, 1).split(" ")
    rows = [(100 - k, " ".join(base[k * 7 :] + [f"t{i}" for i in range(k * 7)])) for k in range(9)]
    got = groups(make_docs(rows))
    assert got == brute.linked_groups(rows)
    assert len({c for _, _, c in got}) < 9


def test_a_crowd_with_frequent_lines(make_docs, prose):
    """Near copies of one text, and texts that are mostly one frequent passage."""
    draw = random.Random(2)
    text, passage = prose(120, 77), prose(30, 78)
    rows = [(i, edited(text, draw.randint(0, 3), draw)) for i in range(130)]
    rows += [(1000 + i, passage + " " + prose(draw.randint(1, 12), i)) for i in range(130)]
    rows += [(2000 + i, prose(40, 5000 + i) + " " + passage) for i in range(60)]
    assert groups(make_docs(rows, parts=4)) == brute.linked_groups(rows)


@pytest.mark.parametrize("frequent,cost", [(1, 0.0), (3, 1.0), (10**6, 20.0)])
def test_any_order_and_boundary_is_exact(make_docs, prose, monkeypatch, frequent, cost):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "PAIR_COST", cost)
    draw = random.Random(frequent)
    rows = []
    for seed in range(12):
        text = prose(draw.randint(9, 130), seed % 5)
        rows += [(len(rows) + k, edited(text, k % 4, draw)) for k in range(5)]
    assert groups(make_docs(rows)) == brute.linked_groups(rows)


def test_threshold_in_whole_numbers():
    for n in range(1, 400):
        assert jaccard.least_shared(n) == -(-9 * n // 10)
        assert jaccard.prefix_size(n) >= 1


def test_edges(make_docs, prose):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "one two three"), (9, prose(30_000, 3)), (10, prose(30_000, 3) + " end")]
    assert groups(make_docs(rows)) == brute.linked_groups(rows)
    assert groups(make_docs(rows).limit(0)) == []


def test_one_of_each(make_docs, prose):
    same, other = prose(80, 1), prose(80, 2)
    rows = [
        (5, same), (3, same), (4, same + " end"), (9, other), (9, other), (9, prose(50, 3)),
        (None, other + " tail"), (None, prose(60, 4)), (None, prose(60, 4)), (20, None), (21, ""), (22, ""),
        (30, "a b"), (31, "A B"),
    ]
    docs = make_docs(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:12]) for r in kept.collect())
    assert left == sorted(
        (i is None, i or 0, (t or "")[:12])
        for i, t in [(3, same), (9, other), (9, prose(50, 3)), (None, prose(60, 4)), (20, None), (21, ""), (22, ""), (30, "a b")]
    )
    assert jaccard.one_of_each(docs.limit(0)).collect() == []


def test_components_of_random_graphs(spark):
    draw = np.random.default_rng(1)
    for size, edges in ((30, 12), (60, 80), (200, 190)):
        pairs = draw.integers(0, size, (edges, 2)).tolist()
        parent = list(range(size))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        frame = spark.createDataFrame([tuple(p) for p in pairs], "a bigint, b bigint")
        got = {r["nid"]: r["comp"] for r in jaccard.components(frame).collect()}
        assert got == {i: root(i) for i in range(size) if root(i) != i}


def test_a_crowded_list_is_not_all_its_pairs(make_docs, prose):
    draw = random.Random(4)
    text = prose(150, 9)
    docs = make_docs([(i, edited(text, 1, draw)) for i in range(300)])
    sets = jaccard.described(docs, "doc_id", "text")
    nodes = jaccard.distinct_sets(sets)
    frequent, size = jaccard.boundary(jaccard.element_counts(nodes))
    lists = jaccard.list_keys(docs, nodes, frequent, size, "text", "doc_id")
    tried = jaccard.first_pairs(lists).cache()
    assert tried.count() < 300 * 30
    labels = jaccard.components(jaccard.links(docs, nodes, tried, "doc_id", "text"))
    assert jaccard.open_pairs(lists, labels, tried).count() < 300 * 30
