from __future__ import annotations

import zlib
from collections import Counter

from conftest import rows_of

from nearfield.llm import sharding


def test_slots_and_laws(make_docs, prose):
    rows = [(i, prose(i % 30, i)) for i in range(300)] + [(None, None), (None, ""), (1000, "é" * 9)]
    docs = make_docs(rows, parts=3)
    got = sharding.shuffle_to_shards(docs, bucket_bytes=2000).collect()
    assert len(got) == len(rows)
    for shard, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    for r in got:
        body = (r["rec"]["text"] or "").encode()
        assert r["size"] == len(body) + 1
        assert r["text_crc32"] == zlib.crc32(body)
        assert r["grown_shard"] in (r["shard"], 8)
    assert 10 < sum(r["grown_shard"] == 8 for r in got) < 80
    assert set(got[0]["rec"].asDict()) == set(docs.columns)


def test_shards_depend_on_id_and_number_only(make_docs, prose):
    some = make_docs([(i, prose(9, i)) for i in range(50)])
    more = make_docs([(i, prose(4, i + 1)) for i in range(90)], parts=4)
    columns = ["rec.doc_id", "shard", "grown_shard"]
    few = rows_of(sharding.shuffle_to_shards(some), *columns)
    assert set(few) <= set(rows_of(sharding.shuffle_to_shards(more), *columns))
    nine = dict((a, b) for a, b, _ in rows_of(sharding.shuffle_to_shards(some, shards=9), *columns))
    assert nine == {a: c for a, _, c in few}


def test_order_is_shuffled_and_repeatable(make_docs, prose):
    docs = make_docs([(i, prose(9, i)) for i in range(200)], parts=2)
    columns = ["shard", "slot", "rec.doc_id"]
    one = rows_of(sharding.shuffle_to_shards(docs), *columns)
    assert one == rows_of(sharding.shuffle_to_shards(docs), *columns)
    in_order = [doc for shard, _, doc in one if shard == 0]
    assert in_order != sorted(in_order)


def test_a_crowded_id_spreads_over_buckets(make_docs):
    docs = make_docs([(5, "same words here")] * 200 + [(i, "other") for i in range(10, 110)], parts=8)
    got = sharding.shuffle_to_shards(docs, bucket_bytes=200)
    assert got.where("rec.doc_id = 5").select("slot").distinct().count() == 200
    assert sharding.shuffle_to_shards(docs.limit(0)).collect() == []


def test_no_bucket_is_far_above_its_bytes(spark, make_docs, prose, monkeypatch):
    """Equal rows of one input partition, nine tenths of all, spread like any others."""
    rows = [(1, "x" * 999)] * 3600 + [(i, prose(180, i)) for i in range(10, 410)]
    docs = make_docs(rows, parts=1)
    seen = []
    monkeypatch.setattr(sharding, "numbered", lambda shuffled, buckets: seen.append((shuffled, buckets)))
    sharding.shuffle_to_shards(docs, bucket_bytes=40_000)
    shuffled, buckets = seen[0]
    largest = shuffled.groupBy("shard", "bucket").sum("size").agg({"sum(size)": "max"}).first()[0]
    assert largest <= 3 * 40_000
    assert shuffled.count() == len(rows) and buckets < 120


def test_slots_do_not_depend_on_the_layout(make_docs, prose):
    rows = [(i, prose(20, i)) for i in range(200)] + [(3, prose(20, 3))] * 2
    columns = ["shard", "slot", "rec.doc_id", "text_crc32"]
    one, two = (
        rows_of(sharding.shuffle_to_shards(make_docs(rows, parts=n).drop("copy"), bucket_bytes=4_000), *columns)
        for n in (1, 7)
    )
    assert one == two


def test_very_long_text(make_docs):
    docs = make_docs([(1, "é" * 400_000), (2, "a"), (3, None), (4, "é" * 400_000)])
    got = rows_of(sharding.shuffle_to_shards(docs, bucket_bytes=1_000), "rec.doc_id", "size")
    assert got == [(1, 800_001), (2, 2), (3, 1), (4, 800_001)]


def test_columns_without_a_type(make_docs):
    docs = make_docs([(1, "a")]).selectExpr("*", "NULL AS nothing")
    assert sharding.shuffle_to_shards(docs).first()["rec"]["nothing"] is None
