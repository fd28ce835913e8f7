"""Predicates over prepared indexes, trees of centroids, scans by tiles of queries."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.ivf import (
    CentroidTree,
    InvertedLists,
    build_lists,
    filtered_probes,
    knn_ivf_flat,
    oversampled_start,
    train_centroids,
    train_tree,
)
from nearfield.operators.knn import Limits, nearest
from nearfield.operators.pq import PqSettings, build_codes, knn_ivf_pq, train_codebooks
from nearfield.operators.store import store_search
from nearfield.plans.methods import Prepared, settings_of

TILES = Limits(broadcast_bytes=1, query_tile_bytes=600, gallery_tile_bytes=900)


def rows_of(hits):
    return sorted(tuple(row) for row in hits.collect())


@pytest.fixture(scope="module")
def data(vectors):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(24, 8)) * 4
    rows = (centers[rng.integers(0, 24, 600)] + rng.normal(size=(600, 8))).astype(np.float32)
    gallery = vectors(rows, prefix="g").withColumn("kind", F.substring("id", 2, 9).cast("int"))
    # Two queries share an id; they are two queries all the same.
    queries = vectors(rows[:12] + 0.1, "qid", ids=["q0", "q0", *[f"q{i}" for i in range(2, 12)]])
    return rows, gallery, queries


@pytest.fixture(scope="module")
def lists(data):
    _, gallery, _ = data
    return build_lists(gallery, train_centroids(gallery, 24, max_iter=3), "l2", attributes=["kind"])


RARE = "kind % 100 = 7"


@pytest.mark.parametrize("limits", [None, TILES])
def test_all_lists_open_equals_filtered_exact(data, lists, limits):
    _, gallery, queries = data
    want = rows_of(nearest(gallery.where(RARE), queries, 4))
    assert rows_of(knn_ivf_flat(lists, queries, 4, nprobe=24, where=RARE, limits=limits)) == want
    # Six rows match; asking for all of them opens every list that holds one.
    assert rows_of(knn_ivf_flat(lists, queries, 4, nprobe=1, enough=6, where=RARE)) == want


def test_queries_open_lists_until_enough_rows_match(data, lists):
    _, gallery, queries = data
    matching = lists.rows.where("kind % 10 = 3")
    asked, most = filtered_probes(queries, lists, matching, 1, 9)
    sizes = {r["list_id"]: r["count"] for r in matching.groupBy("list_id").count().collect()}
    opened = [row["cells"] for row in asked.collect()]
    assert most == 9 and len(opened) == 12
    for cells in opened:
        assert all(cell in sizes for cell in cells)
        held = [sizes[cell] for cell in cells]
        assert sum(held) >= 9 > sum(held[:-1])
    hits = knn_ivf_flat(lists, queries, 9, nprobe=1, where="kind % 10 = 3").collect()
    assert len(hits) == 12 * 9


def test_nothing_matches(data, lists):
    _, _, queries = data
    assert knn_ivf_flat(lists, queries, 3, where="kind < 0").collect() == []


def test_predicate_reaches_the_scan_of_saved_lists(spark, data, lists, tmp_path):
    _, gallery, queries = data
    lists.save(str(tmp_path), files=2, parts=4)
    saved = InvertedLists.load(spark, str(tmp_path), "l2")
    assert saved.attributes == ["kind"]
    found = knn_ivf_flat(saved, queries, 4, nprobe=24, where="kind = 107")
    assert [r["id"] for r in found.collect()] == ["g107"] * 12
    plan = saved.rows.where("kind = 107")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(kind), EqualTo(kind,107)]" in plan


@pytest.mark.parametrize("limits", [None, TILES])
def test_filtered_codes(data, lists, limits):
    _, gallery, queries = data
    settings = PqSettings(m=4, nbits=6)
    index = build_codes(lists, train_codebooks(lists, settings, max_iter=2), settings)
    queries = queries.where("qid <> 'q0'")  # rescoring joins by id
    found = knn_ivf_pq(index, queries, 4, nprobe=24, rerank_k=10, where=RARE, limits=limits)
    # Six rows match and ten are rescored, so the result is exact.
    close = lambda hits: [(*h[:3], round(h[3], 6)) for h in rows_of(hits)]
    assert close(found) == close(nearest(gallery.where(RARE), queries, 4))


@pytest.mark.parametrize(
    "method",
    [
        {"backend": "faiss", "method": "flat"},
        {"backend": "faiss", "method": "ivf_flat", "nlist": 12, "nprobe": 12},
        {"backend": "scann", "num_leaves": 12, "num_leaves_to_search": 12},
        {"backend": "hnswlib", "m": 64, "ef_search": 64},
    ],
)
def test_a_prepared_method_is_filtered(data, method):
    _, gallery, queries = data
    prepared = Prepared(settings_of(method), gallery, attributes=["kind"])
    hits = store_search(
        gallery,
        queries,
        top_k=3,
        metric="l2",
        filter_expression="kind % 5 = 2",
        output_fields=["kind"],
        search_params={"prepared": prepared},
    ).collect()
    assert hits and all(r["kind"] % 5 == 2 for r in hits)
    if method["backend"] != "hnswlib":
        assert len(hits) == 36


# Trees of centroids -------------------------------------------------------------------------


def test_a_wide_beam_is_the_flat_search(data):
    _, gallery, queries = data
    tree = train_tree(gallery, 24, branches=4, beam=4, max_iter=2)
    flat = build_lists(gallery, tree.centroids, "l2")
    deep = build_lists(gallery, tree, "l2")
    homes = [sorted(map(tuple, x.rows.select("id", "list_id").collect())) for x in (flat, deep)]
    assert homes[0] == homes[1]
    for limits in (None, TILES):
        assert rows_of(knn_ivf_flat(deep, queries, 5, nprobe=3, limits=limits)) == rows_of(
            knn_ivf_flat(flat, queries, 5, nprobe=3)
        )


def test_a_narrow_beam_compares_few_lists(data):
    rows, gallery, queries = data
    tree = train_tree(gallery, 64, beam=2, max_iter=2)
    lists = tree.centroids.count()
    assert 40 <= lists <= 72 and tree.tops.count() == 8
    deep = build_lists(gallery, tree, "l2")
    assert deep.rows.count() == 600
    # A row's list lies below one of its two best tops.
    under = {r["list_id"]: r["top_id"] for r in tree.centroids.collect()}
    tops = {r["list_id"]: np.array(r["embedding"]) for r in tree.tops.collect()}
    for r in deep.rows.collect():
        order = sorted(tops, key=lambda t: ((tops[t] - np.array(r["embedding"])) ** 2).sum())
        assert under[r["list_id"]] in order[:2]
    # Enough lists below enough tops find what an exact search finds.
    wide = build_lists(gallery, CentroidTree(tree.tops, tree.centroids, beam=5), "l2")
    found = rows_of(knn_ivf_flat(wide, queries, 10, nprobe=24))
    exact = rows_of(nearest(gallery, queries, 10))
    pairs = lambda hits: {(h[0], h[2]) for h in hits}
    assert len(pairs(found) & pairs(exact)) >= 0.9 * len(pairs(exact))


def test_trees_are_saved_and_layout_does_not_matter(spark, data, tmp_path):
    _, gallery, queries = data
    tree = train_tree(gallery, 30, max_iter=2)
    again = train_tree(gallery.repartition(7), 30, max_iter=2)
    vectors = [sorted((r["list_id"], r["top_id"], tuple(r["embedding"])) for r in t.centroids.collect()) for t in (tree, again)]
    assert vectors[0] == vectors[1]
    built = build_lists(gallery, tree, "l2", attributes=["kind"])
    built.save(str(tmp_path), files=2)
    saved = InvertedLists.load(spark, str(tmp_path), "l2")
    assert rows_of(knn_ivf_flat(saved, queries, 5, nprobe=4)) == rows_of(
        knn_ivf_flat(built, queries, 5, nprobe=4)
    )


def test_oversampling_spreads_the_start(vectors):
    rng = np.random.default_rng(2)
    centers = np.array([[0, 0], [90, 0], [0, 90], [90, 90], [300, 300]])
    sizes = [300, 20, 20, 20, 3]
    rows = np.concatenate([c + rng.normal(size=(n, 2)) for c, n in zip(centers, sizes, strict=True)])
    start = np.array([r["embedding"] for r in oversampled_start(vectors(rows), 5, 1).collect()])
    near = ((start[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert sorted(near) == [0, 1, 2, 3, 4]


def test_few_rows_and_equal_rows(vectors):
    same = vectors(np.ones((9, 4)))
    tree = train_tree(same, 6, max_iter=2)
    assert tree.centroids.count() == 1
    assert build_lists(same, tree).rows.count() == 9


# Exact search by tiles ----------------------------------------------------------------------


def test_no_exchange_of_the_gallery(data, monkeypatch):
    from nearfield.operators import knn

    monkeypatch.setattr(knn, "LEAST_ASKED", 4)
    plans = []
    held = knn.materialise

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return held(df)

    monkeypatch.setattr(knn, "materialise", seen)
    _, gallery, queries = data
    got = rows_of(nearest(gallery, queries, 3, limits=TILES))
    assert got == rows_of(nearest(gallery, queries, 3))
    scans = [p for p in plans if "MapInArrow" in p]
    assert len(scans) >= 2
    for plan in scans:
        # Kept hits are shuffled by query; nothing below the scan is.
        assert "Exchange" not in plan[plan.index("MapInArrow") :]
