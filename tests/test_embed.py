"""Encoders, embedding jobs, pooling, search modes, streams."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.functions.encoders import (
    HashEncoder,
    build_retry,
    encode_column,
    get_encoder,
    register_encoder,
)
from nearfield.functions.pooling import VISION_END, VISION_START, mean_pool, span_pool
from nearfield.operators.knn import nearest
from nearfield.operators.search import (
    attach_captions,
    captions_by_image,
    corpus_status,
    search_by_caption,
    search_by_image,
    search_by_text,
    search_results,
)
from nearfield.operators.store import VectorStore
from nearfield.plans.embed import embed_images, embed_texts
from nearfield.sources.sinks import publish_configs, write_caption_embeddings
from nearfield.streaming.jobs import stream_ingest, stream_search


def hashed(tokens, dim):
    out = np.zeros(dim)
    for token in tokens:
        digest = hashlib.md5(token).hexdigest()
        out[int(digest[:8], 16) % dim] += 1 if digest[8] in "01234567" else -1
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def test_hash_encoder_against_a_plain_loop():
    encoder = HashEncoder(16)
    texts = ["A b  a\n", "", "ÄÖ ä", None, " x "]
    got = encoder.encode_batch(texts=pa.array(texts))
    want = [hashed([w.encode() for w in (t or "").lower().split()], 16) for t in texts]
    np.testing.assert_allclose(got, want, atol=1e-7)
    blob = bytes(range(150))
    got = encoder.encode_batch(images=pa.array([blob, b""], pa.binary()))
    np.testing.assert_allclose(got[0], hashed([blob[:64], blob[64:128], blob[128:]], 16), atol=1e-7)
    assert not got[1].any()
    raw = HashEncoder(16, normalize=False).encode_batch(texts=pa.array(["a a a"]))
    assert np.abs(raw).max() == 3


def test_encoder_contract():
    encoder = HashEncoder(4)
    for both in ({}, {"texts": pa.array(["a"]), "images": pa.array([b"a"])}):
        with pytest.raises(ValueError, match="either"):
            encoder.encode_batch(**both)
    with pytest.raises(ValueError, match="not found"):
        get_encoder({"model": "missing"})
    assert get_encoder({"model": "hash", "dim": 3, "kwargs": {"dim": 9}}).dim == 9
    register_encoder("mine", lambda size: HashEncoder(size, name="mine"))
    assert get_encoder({"model": "mine", "size": 5}).name == "mine"


def test_retries():
    waits, calls = [], []

    def build():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")

    build_retry(build, sleep=waits.append)
    assert len(calls) == 3 and waits == [1.0, 2.0]
    waits.clear()
    with pytest.raises(ZeroDivisionError):
        build_retry(lambda: 1 / 0, pause=lambda n: 1 + n, sleep=waits.append)
    assert waits == [1, 2]


def test_encoded_rows_are_counted(spark):
    class Shrinking:
        """Loses a row: the job must notice."""

        name = "shrinking"

        def build(self):
            pass

        def encode_batch(self, texts=None, images=None):
            return np.zeros((max(len(texts) - 1, 0), 2), np.float32)

    rows = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="one vector per input"):
        encode_column(rows, "t", Shrinking()).collect()


def test_sweep_is_model_major(spark):
    one = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "id string, image binary")
    two = spark.createDataFrame([(7, bytearray(b"z"))], "id long, image binary")
    models = [HashEncoder(4, name="m1"), HashEncoder(6, name="m2")]
    rows = embed_images(models, {"d1": one, "d2": two}).collect()
    assert [(r["model_name"], r["dataset_name"], r["id"]) for r in rows] == [
        ("m1", "d1", "a"),
        ("m1", "d1", "b"),
        ("m1", "d2", "7"),
        ("m2", "d1", "a"),
        ("m2", "d1", "b"),
        ("m2", "d2", "7"),
    ]
    assert {(r["model_name"], len(r["embedding"])) for r in rows} == {("m1", 4), ("m2", 6)}


def test_caption_embeddings(spark, tmp_path):
    captions = spark.createDataFrame(
        [(0, "a#0", "one two", "a.jpg", "a"), (1, "a#1", "three", "a.jpg", "a")],
        "index long, caption_id string, caption string, image string, image_id string",
    )
    rows = embed_texts([HashEncoder(8)], captions, "d", tasks=2)
    write_caption_embeddings(rows, str(tmp_path / "c"))
    back = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    np.testing.assert_allclose(back["a#1"]["embedding"], hashed([b"three"], 8), atol=1e-7)
    assert (back["a#1"]["index"], back["a#1"]["image_id"], back["a#0"]["caption"]) == (
        1, "a", "one two",
    )


def test_pooling(spark):
    tokens = spark.createDataFrame(
        [
            ("a", 0, 5, [9.0, 9.0]),
            ("a", 1, VISION_START, [1.0, 0.0]),
            ("a", 2, 5, [0.0, 2.0]),
            ("a", 3, VISION_END, [2.0, 1.0]),
            ("a", 4, VISION_END, [50.0, 0.0]),
            ("b", 0, 5, [3.0, 4.0]),
            ("z", 0, 5, [0.0, 0.0]),
        ],
        "id string, token_pos int, token_id int, embedding array<float>",
    )
    got = {r["id"]: r["embedding"] for r in span_pool(tokens).collect()}
    np.testing.assert_allclose(got["a"], np.array([1, 1]) / np.sqrt(2))
    np.testing.assert_allclose(got["b"], [0.6, 0.8])
    assert got["z"] == [0.0, 0.0]
    plain = {r["id"]: r["embedding"] for r in mean_pool(tokens, normalize=False).collect()}
    np.testing.assert_allclose(plain["a"], [62 / 5, 12 / 5])


def test_vector_expressions(spark):
    rows = spark.createDataFrame(
        [([3.0, 4.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>"
    )
    got = rows.select(
        V.l2_normalize(F.col("a")).alias("u"),
        V.l2_normalize_eps(F.col("a")).alias("e"),
        V.pair_score_l2(F.col("a"), F.col("b")).alias("l2"),
        V.pair_score_ip(F.col("a"), F.col("b")).alias("ip"),
        V.pair_score_cosine(F.col("a"), F.col("b")).alias("cos"),
        V.similarity_score(F.lit(2.0), "l2").alias("s"),
        V.cast_half(F.transform("a", lambda x: x / 3)).alias("h"),
    ).collect()
    assert got[0]["u"] == [0.6, 0.8] and got[1]["u"] == [0.0, 0.0] and got[1]["e"] == [0.0, 0.0]
    assert [(r["l2"], r["ip"], r["cos"], r["s"]) for r in got] == [
        (18.0, 4.0, 0.8, -2.0),
        (2.0, 0.0, 0.0, -2.0),
    ]
    np.testing.assert_array_equal(got[0]["h"], np.array([1, 4 / 3], np.float16).astype(np.float32))
    empty = spark.createDataFrame([(None,), ([],)], "a array<float>")
    assert [r[0] for r in empty.select(V.cast_half("a")).collect()] == [None, []]
    with pytest.raises(ValueError):
        V.pair_score(F.lit(1), F.lit(1), "dot")


@pytest.fixture(scope="module")
def corpus(spark):
    encoder = HashEncoder(32)
    docs = spark.createDataFrame(
        [("d0", "red cat"), ("d1", "blue dog runs"), ("d2", "green bird")], "id string, text string"
    )
    return encoder, encode_column(docs, "text", encoder).select("id", "embedding")


def test_search_modes(spark, corpus):
    encoder, gallery = corpus
    texts = spark.createDataFrame([("q", "  the dog runs ")], "qid string, text string")
    assert search_by_text(gallery, texts, encoder, 1).first()["id"] == "d1"
    with pytest.raises(ValueError, match="empty"):
        search_by_text(gallery, spark.createDataFrame([("q", " \t")], texts.schema), encoder, 1)
    ids = spark.createDataFrame([("q", "d2")], "qid string, image_id string")
    first = search_by_image(gallery, ids, 1).first()
    assert first["id"] == "d2" and first["score"] == pytest.approx(1.0)
    with pytest.raises(KeyError, match="nope"):
        search_by_image(gallery, spark.createDataFrame([("q", "nope")], ids.schema), 1)
    captions = gallery.withColumn("id", F.concat("id", F.lit("#0")))
    asked = spark.createDataFrame([("q", "d0#0")], "qid string, caption_id string")
    assert search_by_caption(gallery, captions, asked, 1).first()["id"] == "d0"


def test_captions_of_hits(spark):
    captions = spark.createDataFrame(
        [("a", n, f"a#{n}", f"text {n}") for n in range(7)]
        + [("b", 0, "b#0", None), (None, 0, "x", "y"), ("", 1, "e", "e")],
        "image_id string, n int, id string, caption string",
    )
    hits = spark.createDataFrame(
        [("q", 1, "a", 0.25), ("q", 2, "b", 0.5), ("q", 3, "c", 0.75)],
        "qid string, rank int, id string, score double",
    )
    shown = {r["id"]: r for r in attach_captions(hits, captions, ["n"]).collect()}
    assert [c["id"] for c in shown["a"]["captions"]] == [f"a#{n}" for n in range(5)]
    assert shown["a"]["caption"] == "text 0" and shown["b"]["caption"] is None
    assert shown["c"]["captions"] == [] and len(shown["b"]["captions"]) == 1
    full = search_results(hits, captions, ["n"], metric="l2", root="r").orderBy("rank").collect()
    assert [(r["distance"], r["score"], r["image_path"]) for r in full][0] == (0.25, -0.25, "r/a.jpg")
    placed = captions_by_image(captions, ["n"]).collect()
    assert {(r["image_id"], r["position"]) for r in placed} == {("a", n) for n in range(7)} | {("b", 0)}
    status = corpus_status(hits, captions.where("image_id = 'a'"), ["n"]).first()
    assert (status["image_count"], status["caption_count"]) == (3, 7)
    assert status["sample_captions"] == [f"a#{n}" for n in range(5)]
    assert corpus_status(hits, None, ["n"]).first()["caption_embeddings_loaded"] is False


def test_published_configs_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "val")], "id string, split string")
    checks = publish_configs(spark, {"texts": rows, "images": rows.drop("split")}, str(tmp_path / "r"))
    assert {(r["config"], r["split"], r["written"], r["found"]) for r in checks.collect()} == {
        ("texts", "train", 1, 1),
        ("texts", "val", 1, 1),
        ("images", "train", 2, 2),
    }


def test_streams_equal_batches(spark, tmp_path):
    encoder = HashEncoder(16)
    feed = tmp_path / "feed"
    schema = "id string, text string, at int"
    first = [(f"i{n}", f"word{n} old", 0) for n in range(30)]
    second = [(f"i{n}", f"word{n} new", 1) for n in range(20, 50)] + [("i20", "stale", 0)]
    store = VectorStore(spark, str(tmp_path / "store"), {"dim": 16}).create()

    def drain():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
        stream_ingest(
            source,
            store,
            str(tmp_path / "progress"),
            encoder=encoder,
            content="text",
            dataset_name="d",
            newest=[F.col("at").desc()],
        ).awaitTermination()

    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(str(feed))
    drain()
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(feed))
    drain()
    drain()  # nothing new arrives
    final = {n: t for n, t, _ in first} | {n: t for n, t, _ in second if t != "stale"}
    want = {n: hashed([w.encode() for w in t.split()], 16) for n, t in final.items()}
    got = {r["id"]: r["vector"] for r in store.read().collect()}
    assert got.keys() == want.keys()
    for name in want:
        np.testing.assert_allclose(got[name], want[name], atol=1e-7)

    gallery = store.read().select("id", F.col("vector").alias("embedding"))
    queries = gallery.withColumnRenamed("id", "qid")
    queries.repartition(3).write.parquet(str(tmp_path / "queries"))
    source = spark.readStream.schema("qid string, embedding array<float>").option(
        "maxFilesPerTrigger", 1
    )
    stream_search(
        source.parquet(str(tmp_path / "queries")),
        gallery,
        3,
        str(tmp_path / "answers"),
        str(tmp_path / "answers-progress"),
    ).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "answers"))
    batch = nearest(gallery, queries, 3, "cosine")
    key = ["qid", "rank", "id", "score"]
    assert sorted(map(tuple, streamed.select(*key).collect())) == sorted(
        map(tuple, batch.select(*key).collect())
    )
