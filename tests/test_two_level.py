"""Prefix sums in two levels, popular keys in joins, half precision, versions in a stream."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.functions.encoders import HashEncoder
from nearfield.functions.ids import running_before
from nearfield.operators import rerank
from nearfield.operators.dedup import running_limit
from nearfield.operators.rerank import heavy_keys, join_popular, rerank_exact
from nearfield.operators.store import VectorStore
from nearfield.streaming.jobs import stream_ingest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 5])
def test_running_before(spark, parts):
    draw = random.Random(1)
    rows = [(i, draw.choice([None, 0, 1, 7])) for i in range(500)]
    df = spark.createDataFrame(draw.sample(rows, 500), "i int, n long").repartition(parts)
    found = running_before(df, ["i"], "n")
    total, want = 0, []
    for i, n in rows:
        want.append((i, n, total))
        total += n or 0
    assert sorted(map(tuple, found.collect())) == want
    assert "SinglePartition" not in plan_of(found)
    assert running_before(df.limit(0), ["i"], "n").collect() == []


def test_running_limit_over_many_shards(spark):
    rows = [(i, i % 5, i % 4 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "shard int, n_rows int, skipped boolean")
    found = {r["shard"]: r["n_write"] for r in running_limit(df, 200).collect()}
    left = 200
    for shard, n, skipped in rows:
        own = 0 if skipped else max(0, min(n, left))
        assert found[shard] == own
        left -= own
    assert sum(found.values()) == 200
    assert "SinglePartition" not in plan_of(running_limit(df, 200))
    assert {r["n_write"] for r in running_limit(df, None).where("skipped").collect()} == {0}


# Popular keys -------------------------------------------------------------------------------


@pytest.fixture
def crowded(spark):
    """A third of the left rows share one key; some have none, some find no partner."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 97}") for i in range(3000)]
    right = [("hot", 1), ("hot", 2), *[(f"k{i}", i) for i in range(90)]]
    left = spark.createDataFrame(rows, "n int, id string").repartition(4)
    return rows, right, left, spark.createDataFrame(right, "id string, v int")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_popular_equals_the_plain_join(crowded, how):
    _, _, left, right = crowded
    want = sorted(map(repr, left.join(right, "id", how).collect()))
    assert heavy_keys(left, "id", 300) == ["hot"]
    assert sorted(map(repr, join_popular(left, right, "id", how, least=300).collect())) == want
    assert sorted(map(repr, join_popular(left, right, "id", how).collect())) == want


def test_popular_rows_are_not_shuffled(spark, crowded):
    _, _, left, right = crowded
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = join_popular(left, right, "id", least=300)
        parts = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = sorted(r["count"] for r in parts)
    # The hot key makes 2,000 of some 3,900 rows; one task would have them all.
    assert sizes[-1] < 1000


def test_nothing_is_heavy_in_an_empty_table(crowded):
    _, _, left, right = crowded
    assert heavy_keys(left.limit(0), "id") == []
    assert join_popular(left.limit(0), right, "id").collect() == []


def test_rerank_with_a_popular_candidate(spark, vectors, monkeypatch):
    monkeypatch.setattr(rerank, "heavy_keys", lambda *a: ["g0", "g7"])
    draw = np.random.default_rng(3)
    gallery, queries = vectors(draw.normal(size=(50, 6)), prefix="g"), vectors(draw.normal(size=(90, 6)), "qid", "q")
    pairs = [(f"q{i}", f"g{j}") for i in range(90) for j in {0, i % 50, (7 * i) % 50}]
    candidates = spark.createDataFrame(pairs, "qid string, id string")
    popular = [tuple(r) for r in rerank_exact(candidates, gallery, queries, 2).orderBy("qid", "rank").collect()]
    monkeypatch.setattr(rerank, "heavy_keys", lambda *a: [])
    plain = [tuple(r) for r in rerank_exact(candidates, gallery, queries, 2).orderBy("qid", "rank").collect()]
    assert popular == plain and len(plain) == 178


# Half precision -----------------------------------------------------------------------------


def halves():
    every = np.arange(0, 0x7C01, dtype=np.uint16).view(np.float16).astype(np.float32)
    with np.errstate(over="ignore"):
        between = (every[:-1].astype(np.float64) + every[1:]) / 2
    near = np.nextafter(between[:-1].astype(np.float32), np.float32(np.inf))
    more = [0.0, 65504, 65519.996, 65520, 1e30, np.inf, 1e-8, 2.0**-25, 2.0**-24, 1.5 * 2.0**-25, 1e-45]
    values = np.concatenate([every, between[:-1], near, more]).astype(np.float32)
    return np.concatenate([values, -values, [np.nan]]).astype(np.float32)


def test_half_rounds_like_the_hardware(spark):
    values = halves()
    chunks = [(i, [float(x) for x in part]) for i, part in enumerate(np.array_split(values, 50))]
    df = spark.createDataFrame(chunks, "i int, v array<float>")
    found = df.select("i", V.cast_half("v").alias("h"), V.pack_half("v").alias("p")).orderBy("i").collect()
    with np.errstate(over="ignore"):
        want = values.astype(np.float16)
    got = np.concatenate([r["h"] for r in found]).astype(np.float32)
    np.testing.assert_array_equal(got, want.astype(np.float32))
    np.testing.assert_array_equal(np.signbit(got[:-1]), np.signbit(want[:-1]))
    assert b"".join(bytes(r["p"]) for r in found) == want.tobytes()
    back = df.select("i", V.unpack_half(V.pack_half("v")).alias("h")).orderBy("i").collect()
    np.testing.assert_array_equal(np.concatenate([r["h"] for r in back]).astype(np.float32), want.astype(np.float32))


def test_half_of_nulls_and_empty_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None, 0.1])], "i int, v array<float>")
    rows = {r["i"]: r["h"] for r in df.select("i", V.cast_half("v").alias("h")).collect()}
    tenth = struct.unpack("<e", struct.pack("<e", 0.1))[0]
    assert rows == {1: None, 2: [], 3: [1.0, None, np.float32(tenth)]}
    packed = df.where("i < 3").select("i", V.unpack_half(V.pack_half("v")).alias("h"))
    assert {r["i"]: r["h"] for r in packed.collect()} == {1: None, 2: []}
    assert "Python" not in plan_of(df.select(V.cast_half("v"), V.pack_half("v")))


# Versions in a stream -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_change_nothing(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(f"d{i % 15}", f"text {draw.randint(0, 99)} of {i}", i) for i in range(90)]
    draw.shuffle(rows)
    rows += [("d3", rows[0][1], 5)]  # an old version once more
    feed = tmp_path / "feed"
    schema = "id string, text string, at int"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(feed))
    encoder = HashEncoder(8)
    store = VectorStore(spark, str(tmp_path / "store"), {"dim": 8}).create()
    stream_ingest(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(feed)),
        store,
        str(tmp_path / "progress"),
        encoder=encoder,
        content="text",
        dataset_name="d",
        version="at",
    ).awaitTermination()
    batch = VectorStore(spark, str(tmp_path / "batch"), {"dim": 8}).create()
    newest = {}
    for name, text, at in rows:
        newest[name] = max(newest.get(name, (-1, "")), (at, text))
    from nearfield.functions.encoders import encode_column

    final = spark.createDataFrame([(n, t) for n, (_, t) in newest.items()], "id string, text string")
    batch.add(encode_column(final, "text", encoder).drop("text"), model_name=encoder.name, dataset_name="d")
    order = lambda s: sorted(map(repr, s.read().collect()))
    assert order(store) == order(batch) and len(order(store)) == 15
