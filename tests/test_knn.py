"""Search as DataFrame jobs: physical forms, routing, invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.ivf import (
    InvertedLists,
    build_lists,
    knn_ivf_flat,
    knn_tree_rerank,
    probed_rows,
    probes,
    train_centroids,
)
from nearfield.operators.knn import Limits, knn_bruteforce, nearest, with_nearest
from nearfield.operators.lsh import HashTables, knn_lsh
from nearfield.operators.pq import (
    PqIndex,
    PqSettings,
    build_codes,
    knn_ivf_pq,
    train_codebooks,
)
from nearfield.operators.rerank import rerank_exact
from nearfield.session import materialise

TILES = Limits(broadcast_bytes=1, query_tile_bytes=600, gallery_tile_bytes=900)


def rows_of(hits):
    return sorted(tuple(row) for row in hits.collect())


def ids_of(hits):
    found: dict[str, list[str]] = {}
    for row in hits.orderBy("qid", "rank").collect():
        found.setdefault(row["qid"], []).append(row["id"])
    return found


@pytest.fixture(scope="module")
def data(vectors):
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(240, 8)).astype(np.float32)
    rows[60:140] = rows[3]  # a third of the gallery are copies
    queries = np.concatenate([rows[:20], rng.normal(size=(10, 8)).astype(np.float32)])
    return rows, vectors(rows, prefix="g"), vectors(queries, "qid", "q")


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_three_forms_agree(data, metric):
    _, gallery, queries = data
    scan = rows_of(nearest(gallery, queries, 7, metric))
    # 240 rows of 8 floats are 7,680 bytes: the gallery fits and 30 queries do as well, so the
    # second form is reached by making the query side the larger one.
    many = queries.unionByName(
        queries.crossJoin(F.broadcast(queries.sparkSession.range(9))).select(
            F.concat("qid", F.lit("-"), "id").alias("qid"), "embedding"
        )
    )
    swapped = nearest(gallery, many, 7, metric, limits=Limits(broadcast_bytes=7_700))
    assert rows_of(swapped.where(~F.col("qid").contains("-"))) == scan
    assert rows_of(nearest(gallery, queries, 7, metric, limits=TILES)) == scan
    assert len(scan) == 30 * 7


def test_partitions_do_not_matter(data):
    _, gallery, queries = data
    one = rows_of(nearest(gallery.repartition(1), queries, 9, "cosine"))
    many = rows_of(nearest(gallery.repartition(13), queries.repartition(5), 9, "cosine"))
    assert one == many


def test_copies_come_in_id_order(data):
    _, gallery, queries = data
    found = ids_of(nearest(gallery, queries, 6, "l2"))
    copies = sorted(["g3"] + [f"g{i}" for i in range(60, 140)])
    assert found["q3"] == copies[:6]


def test_identity_gallery_finds_itself(vectors):
    eye = np.eye(4)
    for metric in ("l2", "ip", "cosine"):
        found = ids_of(nearest(vectors(eye, prefix="img-"), vectors(eye, "qid", "img-"), 1, metric))
        assert found == {f"img-{i}": [f"img-{i}"] for i in range(4)}


def test_fewer_rows_than_k_and_bad_arguments(vectors):
    gallery, queries = vectors(np.eye(2)), vectors(np.eye(2), "qid")
    assert nearest(gallery, queries, 5).count() == 4
    with pytest.raises(ValueError, match="positive"):
        nearest(gallery, queries, 0)
    with pytest.raises(ValueError, match="metric"):
        nearest(gallery, queries, 1, "dot")
    with pytest.raises(KeyError):
        nearest(gallery.drop("embedding"), queries, 1)
    with pytest.raises(Exception, match="Expected vectors of dimension 3"):
        nearest(gallery, vectors(np.eye(3), "qid"), 1).collect()
    with pytest.raises(ValueError, match="one vector width"):
        nearest(gallery, queries.unionByName(vectors(np.eye(3), "qid", "x")), 1)


def test_empty_sides(vectors):
    gallery, queries = vectors(np.eye(2)), vectors(np.eye(2), "qid")
    assert nearest(gallery.limit(0), queries, 1).count() == 0
    assert nearest(gallery, queries.limit(0), 1).count() == 0


def test_zero_vector_scores_zero(vectors):
    gallery = vectors(np.array([[0.0, 0.0], [-1.0, 0.0]]))
    hits = nearest(gallery, vectors(np.array([[1.0, 0.0]]), "qid"), 2, "cosine")
    assert [(r["id"], r["score"]) for r in hits.orderBy("rank").collect()] == [("0", 0.0), ("1", -1.0)]


@pytest.mark.parametrize("limits", [None, Limits(broadcast_bytes=100), TILES])
def test_repeated_ids_are_answered_row_by_row(vectors, limits):
    """Two queries of one id are two queries; two gallery rows of one id are two candidates."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(3, 8))
    gallery = vectors(rows, ids=["a", "a", "b"])
    queries = vectors(rows[[0, 2, 2, 1, 0]], "qid", ids=["x", "x", "y", "z", "z"])
    found = sorted((r["qid"], r["rank"], r["id"]) for r in nearest(gallery, queries, 1, limits=limits).collect())
    assert found == [("x", 1, "a"), ("x", 1, "b"), ("y", 1, "b"), ("z", 1, "a"), ("z", 1, "a")]
    assert nearest(gallery, queries, 3, limits=limits).where("id = 'a'").count() == 10


def test_bruteforce_runs_each_metric_once(data):
    _, gallery, queries = data
    runs = knn_bruteforce(gallery, queries, 2, ["L2", "cosine", "l2"])
    assert list(runs) == ["l2", "cosine"]


@pytest.fixture(scope="module")
def lists(data):
    rows, gallery, _ = data
    centroids = gallery.sparkSession.createDataFrame(
        [(i, [float(x) for x in rows[5 * i]]) for i in range(12)], "list_id long, embedding array<float>"
    )
    return centroids


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("limits", [None, TILES])
def test_probing_all_lists_is_exact(data, lists, metric, limits):
    _, gallery, queries = data
    built = build_lists(gallery, lists, metric, limits=limits)
    found = knn_ivf_flat(built, queries, 5, nprobe=12, limits=limits)
    assert rows_of(found) == rows_of(nearest(gallery, queries, 5, metric))


def test_recall_grows_with_probes(data, lists):
    _, gallery, queries = data
    built = build_lists(gallery, lists, "cosine")
    truth = {q: set(ids) for q, ids in ids_of(nearest(gallery, queries, 5, "cosine")).items()}
    recalls = []
    for nprobe in (1, 3, 6, 12):
        found = ids_of(knn_ivf_flat(built, queries, 5, nprobe=nprobe))
        recalls.append(sum(len(truth[q] & set(found.get(q, []))) for q in truth))
    assert recalls == sorted(recalls)
    assert recalls[-1] == sum(map(len, truth.values()))


def test_lists_survive_a_round_trip(data, lists, spark, tmp_path):
    _, gallery, queries = data
    built = build_lists(gallery, lists, "l2")
    path = str(tmp_path / "ivf")
    built.save(path, files=3)
    again = InvertedLists.load(spark, path, "l2")
    few = queries.limit(2)
    assert rows_of(knn_ivf_flat(again, few, 5, nprobe=2)) == rows_of(
        knn_ivf_flat(built, few, 5, nprobe=2)
    )
    # Probing two queries' lists reads their folders only.
    asked = probes(few, again, 1)
    probed = probed_rows(again.rows, asked, again.centroids)
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "In(list_id" in plan
    assert 1 <= probed.select("part").distinct().count() <= 2
    # Saving what was loaded, and codes next to the lists.
    settings = PqSettings(m=4, nbits=3)
    index = build_codes(again, materialise(train_codebooks(again, settings)), settings)
    index.save(str(tmp_path / "pq"), files=2, parts=5)
    loaded = PqIndex.load(spark, str(tmp_path / "pq"), "l2", settings)
    assert ids_of(knn_ivf_pq(loaded, queries, 5, nprobe=12, rerank_k=240)) == ids_of(
        nearest(gallery, queries, 5, "l2")
    )


def test_centroid_routing_falls_back_to_a_join(data, lists):
    _, gallery, _ = data
    near = with_nearest(gallery, "id", lists, 2, "l2").select("id", "cells")
    far = with_nearest(gallery, "id", lists, 2, "l2", limits=TILES).select("id", "cells")
    assert rows_of(near) == rows_of(far)


def test_trained_centroids_are_capped_by_the_rows(vectors):
    gallery = vectors(np.eye(3))
    assert train_centroids(gallery, 50).count() <= 3


def test_training_uses_every_row_and_no_layout(data, lists):
    _, gallery, _ = data

    def trained(parts):
        centroids = train_centroids(gallery.repartition(parts), 6, "cosine", max_iter=4)
        return rows_of(centroids.select("list_id", F.col("embedding").cast("string")))

    assert trained(1) == trained(3) == trained(8)
    settings = PqSettings(m=2, nbits=3)
    books = [
        rows_of(
            train_codebooks(build_lists(gallery.repartition(n), lists, "l2"), settings, max_iter=3)
            .select("subspace", "code", F.col("embedding").cast("string"))
        )
        for n in (1, 7)
    ]
    assert books[0] == books[1]


def test_codes_without_a_bound_on_centroids(data, lists):
    """Centroids beyond the broadcast bound are joined; nothing stops and nothing changes."""
    _, gallery, queries = data
    built = build_lists(gallery, lists, "l2")
    settings = PqSettings(m=2, nbits=3)
    books = materialise(train_codebooks(built, settings))
    near = knn_ivf_pq(build_codes(built, books, settings), queries, 4, nprobe=5)
    far = knn_ivf_pq(build_codes(built, books, settings, TILES), queries, 4, nprobe=5, limits=TILES)
    left, right = near.orderBy("qid", "rank").collect(), far.orderBy("qid", "rank").collect()
    np.testing.assert_allclose([r["score"] for r in left], [r["score"] for r in right], atol=1e-9)


def test_search_effort_has_no_ceiling(data):
    from nearfield.plans.methods import hash_tables

    _, gallery, queries = data
    tables = [hash_tables(16, effort, 240).tables for effort in (8, 64, 256, 1024)]
    assert tables == [1, 8, 32, 128]
    assert hash_tables(16, 64, 10**9).bits > hash_tables(16, 64, 10**6).bits
    truth = {q: set(ids) for q, ids in ids_of(nearest(gallery, queries, 5, "cosine")).items()}
    recalls = []
    for count in (tables[0], tables[-1]):
        found = ids_of(knn_lsh(gallery, queries, 5, "cosine", config=HashTables(count, 5)))
        recalls.append(sum(len(truth[q] & set(found.get(q, []))) for q in truth))
    assert recalls[0] < recalls[1]


def test_tree_without_leaves_is_exact_and_with_leaves_reorders(data, lists):
    _, gallery, queries = data
    exact = rows_of(nearest(gallery, queries, 4, "cosine"))
    assert rows_of(knn_tree_rerank(gallery, queries, 4, "cosine")) == exact
    built = build_lists(gallery, lists, "cosine")
    full = knn_tree_rerank(
        gallery, queries, 4, "cosine", lists=built, num_neighbors=9, reorder_k=20
    )
    assert ids_of(full) == ids_of(nearest(gallery, queries, 4, "cosine"))


def test_hash_tables_forms_agree_and_recall_grows(data):
    _, gallery, queries = data
    truth = {q: set(ids) for q, ids in ids_of(nearest(gallery, queries, 5, "cosine")).items()}
    recalls = []
    for tables in (1, 4, 16):
        config = HashTables(tables=tables, bits=3)
        found = knn_lsh(gallery, queries, 5, "cosine", config=config)
        tiled = knn_lsh(gallery, queries, 5, "cosine", config=config, limits=TILES)
        assert rows_of(found) == rows_of(tiled)
        hits = ids_of(found)
        assert all(len(ids) == len(set(ids)) for ids in hits.values())
        recalls.append(sum(len(truth[q] & set(hits.get(q, []))) for q in truth))
    assert recalls == sorted(recalls)
    with pytest.raises(ValueError):
        HashTables(tables=0)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_codes_with_full_rerank_are_exact(data, lists, metric):
    _, gallery, queries = data
    built = build_lists(gallery, lists, metric)
    settings = PqSettings(m=4, nbits=3)
    index = build_codes(built, materialise(train_codebooks(built, settings)), settings)
    full = knn_ivf_pq(index, queries, 5, nprobe=12, rerank_k=240)
    assert ids_of(full) == ids_of(nearest(gallery, queries, 5, metric))
    # Codes alone: far better than chance, and the two physical forms agree on the scores.
    plain = knn_ivf_pq(index, queries, 5, nprobe=12)
    tiled = knn_ivf_pq(index, queries, 5, nprobe=12, limits=TILES.__class__(4_000, 600, 900))
    left, right = plain.orderBy("qid", "rank").collect(), tiled.orderBy("qid", "rank").collect()
    np.testing.assert_allclose([r["score"] for r in left], [r["score"] for r in right], atol=1e-9)
    truth = ids_of(nearest(gallery, queries, 20, metric))
    found = ids_of(plain)
    share = np.mean([len(set(found[q]) & set(truth[q])) / 5 for q in truth])
    assert share > 0.5


def test_code_settings(data, lists):
    _, gallery, _ = data
    built = build_lists(gallery, lists, "l2")
    with pytest.raises(ValueError, match="multiple of m"):
        train_codebooks(built, PqSettings(m=3))
    with pytest.raises(ValueError, match="positive"):
        PqSettings(m=0)


def test_rerank_orders_candidates(data):
    _, gallery, queries = data
    candidates = nearest(gallery, queries, 240, "l2")
    again = rerank_exact(candidates, gallery, queries, 6, "cosine")
    assert ids_of(again) == ids_of(nearest(gallery, queries, 6, "cosine"))


def test_plan_reads_only_id_and_vector(spark, vectors):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    gallery = table.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
    hits = nearest(gallery.where("label = 3"), gallery.withColumnRenamed("id", "qid"), 3, "ip")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_codes_score_like_the_vectors_they_stand_for(data, lists, vectors, metric):
    """Searching codes equals an exact search over the decoded vectors."""
    _, gallery, queries = data
    built = build_lists(gallery, lists, metric)
    settings = PqSettings(m=2, nbits=4)
    books = materialise(train_codebooks(built, settings))
    index = build_codes(built, books, settings)
    centers = {r["list_id"]: np.array(r["embedding"]) for r in built.centroids.collect()}
    parts = {(r["subspace"], r["code"]): np.array(r["embedding"]) for r in books.collect()}
    decoded = {
        r["id"]: centers[r["list_id"]]
        + np.concatenate([parts[s, code] for s, code in enumerate(bytes(r["codes"]))])
        for r in index.codes.collect()
    }
    asked = {r["qid"]: np.array(r["embedding"]) for r in queries.collect()}
    if metric == "cosine":
        asked = {name: v / np.linalg.norm(v) for name, v in asked.items()}
    hits = knn_ivf_pq(index, queries, 6, nprobe=12).collect()
    for row in hits:
        gap = asked[row["qid"]] - decoded[row["id"]]
        score = gap @ gap if metric == "l2" else asked[row["qid"]] @ decoded[row["id"]]
        assert row["score"] == pytest.approx(score, abs=1e-5)
    for name, vector in asked.items():
        best = sorted(
            (vector - v) @ (vector - v) if metric == "l2" else -(vector @ v)
            for v in decoded.values()
        )[:6]
        found = [r["score"] if metric == "l2" else -r["score"] for r in hits if r["qid"] == name]
        np.testing.assert_allclose(sorted(found), best, atol=1e-5)
