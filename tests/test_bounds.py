"""What grows with the tables: copies, scans, passes over a derived gallery, memory of a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.functions.encoders import HashEncoder, encode_column
from nearfield.operators import knn
from nearfield.operators.ivf import build_lists, train_centroids
from nearfield.operators.knn import MOST_TILES, Limits, nearest, with_tiles
from nearfield.operators.pq import PqSettings, build_codes, knn_ivf_pq, train_codebooks
from nearfield.operators.topk import BestK, Vectors

TINY = Limits(broadcast_bytes=1, query_tile_bytes=40, gallery_tile_bytes=40)


@pytest.fixture(scope="module")
def data(vectors):
    matrix = np.random.default_rng(3).normal(size=(300, 8))
    return vectors(matrix), vectors(matrix[:80], "qid")


def rows_of(hits):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in hits.collect())


def test_small_bounds_make_few_copies(spark):
    """copies per row used to be the other side's rows over those of a tile."""
    gallery = spark.range(400).select(F.col("id"), (F.col("id") % 2).alias("cell"))
    queries = spark.range(300).select(F.col("id").alias("asked"), (F.col("id") % 2).alias("cell"))
    left, right = with_tiles(gallery, queries, 8, TINY, 3)
    assert left.count() <= MOST_TILES * 400
    assert right.count() <= MOST_TILES * 300
    assert left.select("cell", "gt").distinct().count() > 2
    full = Limits.gallery_tile_bytes // 32
    assert knn.tiles_of(100 * full, 1, full) == 100


def test_small_bounds_make_few_scans_of_a_gallery_computed_once(data, spark, monkeypatch):
    """A scan per tile of 64 queries, and every scan computed a derived gallery again."""
    monkeypatch.setattr(knn, "LEAST_ASKED", 2)
    rows, asked = data
    seen = spark.sparkContext.accumulator(0)

    def derive(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    derived = rows.mapInArrow(derive, rows.schema)
    scans = []
    scan = knn._scan_gallery
    monkeypatch.setattr(knn, "_scan_gallery", lambda *a: scans.append(1) or scan(*a))
    found = rows_of(nearest(derived, asked, 3, limits=TINY))
    assert 1 < len(scans) <= MOST_TILES
    assert seen.value <= 2 * 300  # counted up to the bound, then written
    monkeypatch.undo()
    assert found == rows_of(nearest(rows, asked, 3))


def peak(work) -> int:
    tracemalloc.start()
    work()
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top


def test_a_task_holds_little_besides_its_vectors():
    """Doubles of whole blocks and 32 MiB score blocks."""
    matrix = np.random.default_rng(4).normal(size=(150_000, 64)).astype(np.float32)
    assert peak(lambda: Vectors(matrix, "cosine", True)) < 1.5 * matrix.nbytes
    block = Vectors(matrix[:40_000], "cosine", True)
    queries = Vectors(matrix[:3000], "cosine", True)
    ids = pa.array(np.arange(40_000))
    assert peak(lambda: BestK(queries, 10, "cosine", pa.int64()).offer(block, ids)) < 45 << 20


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_codes_travel_to_the_queries(data, metric, spark):
    """no hits per list are merged when the codes fit; they are computed once."""
    rows, asked = data
    lists = build_lists(rows, train_centroids(rows, 4, metric, max_iter=2), metric)
    settings = PqSettings(m=4, nbits=3)
    index = build_codes(lists, train_codebooks(lists, settings, max_iter=2), settings)
    assert "MapInArrow" not in index.codes._jdf.queryExecution().toString()
    # Codes of 300 rows take 36 bytes each, 80 queries with 20 hits more than 1000 each.
    middle = Limits(broadcast_bytes=4000)
    hits = knn_ivf_pq(index, asked, 20, nprobe=3, limits=middle)
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    expected = rows_of(knn_ivf_pq(index, asked, 20, nprobe=3))
    assert rows_of(hits) == expected
    assert rows_of(knn_ivf_pq(index, asked, 20, nprobe=3, limits=TINY)) == expected


def test_long_texts_are_encoded_in_pieces(spark):
    """the words of a whole batch of long texts used to be held at once."""
    texts = spark.createDataFrame([(i, f"w{i} " * 2000) for i in range(40)], "id long, text string")

    class Watched(HashEncoder):
        def encode_batch(self, texts=None, images=None):
            assert len(texts) < 40
            return super().encode_batch(texts, images)

    from nearfield.functions import encoders

    plain = encode_column(texts.coalesce(1), "text", HashEncoder(16))
    kept = encoders.ENCODE_BYTES
    encoders.ENCODE_BYTES = 50_000
    try:
        pieces = encode_column(texts.coalesce(1), "text", Watched(16, name="watched"))
        assert sorted(pieces.collect()) == sorted(plain.collect())
    finally:
        encoders.ENCODE_BYTES = kept


def test_named_vectors_use_all_cores(spark, vectors):
    """a join of few bytes ended in one partition, so one core searched for all queries."""
    from nearfield.operators.search import vectors_of

    table = vectors(np.eye(40, dtype=np.float32))
    ids = table.select(F.col("id").alias("qid"), F.col("id").alias("image_id"))
    found = vectors_of(table, ids, "image_id")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.count() == 40


def test_a_scan_sends_a_bounded_piece_to_every_task(data, monkeypatch):
    """pieces grew up to the 16 MB of a tile, and a worker's memory with them."""
    for rows, hits in ((Limits().scan_rows(64 << 20, 64, 10), 10), (Limits().scan_rows(64 << 20, 64), 0)):
        assert rows * (4 * 64 + knn.HIT_BYTES * hits) <= 8 << 20
    rows, asked = data
    want = rows_of(nearest(rows, asked, 3))
    monkeypatch.setattr(knn, "SCAN_BYTES", 20 * (4 * 8 + knn.HIT_BYTES * 3))
    monkeypatch.setattr(knn, "LEAST_ASKED", 2)
    sent = []
    scan = knn._scan_gallery

    def counted(gallery, queries, *more):
        sent.append(queries.count())
        return scan(gallery, queries, *more)

    monkeypatch.setattr(knn, "_scan_gallery", counted)
    assert rows_of(nearest(rows, asked, 3)) == want
    assert len(sent) >= 4 and sum(sent) == 80 and max(sent) < 40


def test_few_pairs_are_scored_twice(monkeypatch):
    """F1: every short stretch of rows gave each query k pairs to rescore, until the first of them were sorted."""
    matrix = np.random.default_rng(5).normal(size=(9000, 16)).astype(np.float32)
    queries, block = Vectors(matrix[:4096], "cosine", True), Vectors(matrix[3000:], "cosine", True)
    scored = []
    exact = BestK.exact
    monkeypatch.setattr(BestK, "exact", lambda self, b, q, g: scored.append(len(q)) or exact(self, b, q, g))
    state = BestK(queries, 10, "cosine", pa.int64())
    state.offer(block, pa.array(np.arange(block.rows)))
    assert state.result({}).num_rows == 10 * queries.rows
    assert sum(scored) < 20 * queries.rows


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_a_vector_that_is_no_number_hides_no_other(metric):
    """Only the best score of a run of rows is compared at first; rows fill runs and strips in part."""
    matrix = np.random.default_rng(6).normal(size=(2700, 8)).astype(np.float32)
    matrix[::300] = np.nan
    with np.errstate(all="ignore"):
        block, queries = Vectors(matrix, metric, metric == "cosine"), Vectors(matrix[1:8], metric, metric == "cosine")
        block.norms = np.nan_to_num(block.norms)
        state = BestK(queries, 5, metric, pa.int64())
        state.offer(block, pa.array(np.arange(2700)))
        found = state.result({})["id"].to_numpy().reshape(7, 5)
        q, g = queries.take(np.arange(7)), block.take(np.arange(2700))
        key = ((q[:, None] - g[None]) ** 2).sum(axis=2) if metric == "l2" else -(q @ g.T)
    assert (found == np.argsort(key, axis=1, kind="stable")[:, :5]).all()


def test_a_scan_by_tile_merges_nothing_on_few_cores(data, monkeypatch):
    """all tasks of a scan sent k rows per query through a shuffle, and each began without a bound."""
    rows, asked = data
    want = rows_of(nearest(rows, asked, 3))
    monkeypatch.setattr(knn, "SCAN_BYTES", 20 * (4 * 8 + knn.HIT_BYTES * 3))
    monkeypatch.setattr(knn, "LEAST_ASKED", 2)
    merged = []
    merge = knn.merge_hits
    monkeypatch.setattr(knn, "merge_hits", lambda *a: merged.append(1) or merge(*a))
    hits = nearest(rows, asked, 3)
    assert not merged
    assert hits.rdd.getNumPartitions() > 1
    assert rows_of(hits) == want
    monkeypatch.setattr(knn, "SCANS_AT_ONCE", 2)  # as with more cores: a scan is cut into two tasks
    assert rows_of(nearest(rows, asked, 3)) == want
    assert merged
