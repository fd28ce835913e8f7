"""Readers and writers on small files."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from nearfield.functions.ids import image_path, prompt_prefix, resolve_image_id, row_index
from nearfield.operators.dedup import (
    caption_limit,
    head_limit,
    keep_first_row,
    lookup_one,
    running_limit,
    sample_seeded,
    zip_positional,
)
from nearfield.sources.captions import export_captions_jsonl, get_record, read_captions_jsonl
from nearfield.sources.csv import (
    clean_queries,
    fill_optional,
    join_annotations,
    read_csv_drop_index,
    relevant_ids_by_query,
)
from nearfield.sources.embeddings import (
    CorpusSpec,
    QuerySpec,
    corpus_size,
    project_embeddings,
    project_relevance,
    read_embeddings,
    read_split,
    spec_summary,
)
from nearfield.sources.images import (
    get_dataset,
    get_text_dataset,
    image_rows,
    image_rows_by_name,
    read_image_files,
)
from nearfield.sources.shards import (
    checked_pairs,
    convert_shards,
    list_files,
    pair_shards,
    read_half_parquet,
    read_npy_shards,
)
from nearfield.sources.sinks import write_split_shards, write_summary_csv


def test_captions_file(spark, tmp_path):
    lines = [
        json.dumps({"image": "dir/one.v2.jpg", "caption": ["first", "second"]}),
        "",
        "   \t",
        json.dumps({"image": "two.jpg", "caption": "a single 'ü' \"text\""}),
        json.dumps({"caption": ["no image"]}),
        json.dumps({"image": "none.jpg"}),
        json.dumps({"image": "empty.jpg", "caption": []}),
        json.dumps({"image": "three.jpg", "caption": "[not a list]"}),
        json.dumps({"image": "four.jpg", "caption": None}),
    ]
    (tmp_path / "c.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = [r.asDict() for r in read_captions_jsonl(spark, str(tmp_path)).orderBy("index").collect()]
    assert [(r["index"], r["caption_id"], r["caption"]) for r in rows] == [
        (0, "one.v2#0", "first"),
        (1, "one.v2#1", "second"),
        (2, "two#0", "a single 'ü' \"text\""),
        (3, "unknown#0", "no image"),
        (4, "three#0", "[not a list]"),
    ]
    assert rows[0]["image"] == "dir/one.v2.jpg" and rows[3]["image"] == ""
    assert get_record(read_captions_jsonl(spark, str(tmp_path)), 2).first()["image_id"] == "two"


def test_broken_caption_line_fails(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"image": "a.jpg", "caption": "x"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_captions_jsonl(spark, str(tmp_path)).collect()


def test_captions_of_several_files_and_splits(spark, tmp_path):
    """File order, then line order, even when a file is read in many splits."""
    expected = []
    for part in range(3):
        names = [f"f{part}-{i:03d}" for i in range(200)]
        expected += names
        (tmp_path / f"part-{part}.jsonl").write_text(
            "\n".join(json.dumps({"image": f"{n}.jpg", "caption": "c" * 50}) for n in names)
        )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_captions_jsonl(spark, str(tmp_path)).orderBy("index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["image_id"] for r in rows] == expected
    assert [r["index"] for r in rows] == list(range(600))


def test_caption_export_reads_back(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a.jpg", ["x", "y"]), ("b.jpg", ["z"])], "image string, caption array<string>"
    )
    export_captions_jsonl(rows, str(tmp_path / "out"))
    back = read_captions_jsonl(spark, str(tmp_path / "out"))
    assert {r["caption_id"] for r in back.collect()} == {"a#0", "a#1", "b#0"}


def test_csv_and_query_preparation(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        ',query_id,query_text,category\n0,7," two\nlines ",x\n1,7,again,y\n2,3,"say ""hi""",\n'
    )
    table = read_csv_drop_index(spark, str(tmp_path / "q.csv"))
    assert table.columns == ["query_id", "query_text", "category"]
    ordered = row_index(table.withColumn("_f", F.monotonically_increasing_id()), ["_f"])
    cleaned = fill_optional(clean_queries(ordered, ["index"]))
    got = {r["query_id"]: (r["query_text"], r["category"]) for r in cleaned.collect()}
    assert got == {7: ("two\nlines", "x"), 3: ('say "hi"', "")}
    marks = spark.createDataFrame(
        [("7", "b.jpg"), ("7", "a.jpg"), ("7", "b.jpg")], "query_id string, image_path string"
    )
    joined = join_annotations(cleaned, relevant_ids_by_query(marks))
    assert {r["query_id"]: r["relevant_ids"] for r in joined.collect()} == {
        7: ["a.jpg", "b.jpg"],
        3: [],
    }
    with pytest.raises(ValueError, match="image_path"):
        relevant_ids_by_query(marks.drop("image_path"))
    with pytest.raises(ValueError, match="query_text"):
        clean_queries(marks)


def test_specs(spark, tmp_path):
    with pytest.raises(ValueError, match="Either"):
        CorpusSpec()
    with pytest.raises(ValueError, match="only one"):
        CorpusSpec(dataset_name="a", load_from_disk="b")
    with pytest.raises(ValueError, match="id_column"):
        CorpusSpec(dataset_name="a", id_column="")
    with pytest.raises(ValueError, match="positive"):
        CorpusSpec(dataset_name="a", read_batch_size=0)
    spec = QuerySpec(
        dataset_name="n", dataset_config="texts", revision="v1", root=str(tmp_path),
        relevance_column="image_id",
    )
    assert spec.location == f"{tmp_path}/n/v1/texts"
    assert spec_summary(spec) == (
        "name=n, config=texts, split=train, revision=v1, id_column=id,"
        " embedding_column=embedding, relevance_column=image_id"
    )
    for split, rows in (("train", 3), ("test", 2)):
        folder = tmp_path / "n" / "v1" / "texts"
        folder.mkdir(parents=True, exist_ok=True)
        pq.write_table(
            pa.table({"id": list(range(rows)), "embedding": [[float(i)] * 2 for i in range(rows)]}),
            folder / f"{split}-00000.parquet",
        )
    table = read_embeddings(spark, spec)
    assert table.count() == 3 and corpus_size(table) == "3"
    with pytest.raises(KeyError, match="val"):
        read_embeddings(
            spark, QuerySpec(dataset_name="n", dataset_config="texts", revision="v1",
                             root=str(tmp_path), split="val")
        )
    files = CorpusSpec(
        dataset_name="n", revision="v1", root=str(tmp_path), data_files="texts/test-*.parquet"
    )
    assert read_embeddings(spark, files).count() == 2


def test_an_absent_split_is_an_error(spark, tmp_path):
    def write(folder, name, ids):
        folder.mkdir(parents=True, exist_ok=True)
        rows = {"id": ids, "embedding": [[1.0, 2.0]] * len(ids)}
        pq.write_table(pa.table(rows), folder / name)

    def ids(**spec):
        return sorted(r["id"] for r in read_embeddings(spark, CorpusSpec(**spec)).collect())

    write(tmp_path / "one", "train-00000-of-00001.parquet", ["a"])
    write(tmp_path / "plain", "part-00000-x.parquet", ["b"])
    write(tmp_path / "plain", "data.parquet", ["c"])
    write(tmp_path / "cols" / "split=train", "0.parquet", ["d"])
    write(tmp_path / "cols" / "split=dev", "0.parquet", ["e"])
    disk = str(tmp_path / "one")
    assert ids(load_from_disk=disk) == ["a"]
    assert ids(load_from_disk=disk, split=None) == ["a"]
    assert ids(load_from_disk=str(tmp_path / "plain"), split="test") == ["b", "c"]
    assert ids(load_from_disk=str(tmp_path / "cols"), split="dev") == ["e"]
    files = {"dataset_name": "cols", "root": str(tmp_path), "data_files": ["split=dev/0.parquet"]}
    assert ids(**files, split="dev") == ["e"]
    for spec in (
        {"load_from_disk": disk},
        {"dataset_name": "one", "root": str(tmp_path)},
        {"load_from_disk": str(tmp_path / "cols")},
    ):
        with pytest.raises(KeyError, match="test"):
            ids(**spec, split="test")


def test_splits(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string")
    write_split_shards(rows, str(tmp_path / "s"), chunk_size=1)
    table = spark.read.parquet(str(tmp_path / "s"))
    chosen = read_split(table, "test")
    assert [r["id"] for r in chosen.collect()] == ["b"]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(KeyError):
        read_split(table, "val")
    with pytest.raises(ValueError):
        read_split(table, None)
    with pytest.raises(Exception, match="(?i)already exists"):
        write_split_shards(rows, str(tmp_path / "s"), chunk_size=1)
    write_split_shards(rows, str(tmp_path / "s"), chunk_size=5, overwrite=True)


def test_projection(spark, vectors):
    ramp = vectors(np.array([[r, r + 1, r + 2] for r in range(4)]))
    got = project_embeddings(ramp.withColumnRenamed("id", "key"), "key").collect()
    assert [(r["id"], r["embedding"]) for r in got] == [
        (str(i), [float(i), i + 1.0, i + 2.0]) for i in range(4)
    ]
    scalar = spark.createDataFrame([(1, 0.5)], "id int, embedding double")
    assert project_embeddings(scalar).first().asDict() == {"id": "1", "embedding": [0.5]}
    assert project_embeddings(scalar.limit(0)).schema.simpleString() == (
        "struct<id:string,embedding:array<float>>"
    )
    with pytest.raises(KeyError, match="nope"):
        project_embeddings(scalar, "nope")
    text = spark.createDataFrame([(1, "x")], "id int, embedding string")
    with pytest.raises(ValueError, match="numeric vectors"):
        project_embeddings(text)
    nested = spark.createDataFrame([(1, [[1.0]])], "id int, embedding array<array<double>>")
    with pytest.raises(ValueError, match="numeric vectors"):
        project_embeddings(nested)
    labels = spark.createDataFrame([(1, " a "), (2, None)], "id int, r string")
    assert [r["relevant_ids"] for r in project_relevance(labels, "r").orderBy("id").collect()] == [
        ["a"],
        None,
    ]
    with pytest.raises(KeyError):
        project_relevance(labels, "missing")


def test_image_rows(spark, tmp_path):
    table = spark.createDataFrame(
        [(bytearray(b"x"), f"img_{i}.v1.jpg", 100 + i) for i in range(3)],
        "image binary, inat24_file_name string, inat24_image_id long",
    )
    assert {r["id"] for r in image_rows(table).collect()} == {f"img_{i}.v1.jpg" for i in range(3)}
    assert {r["id"] for r in image_rows(table.drop("inat24_file_name")).collect()} == {
        "100", "101", "102",
    }
    bare = table.select("image").withColumn("n", F.monotonically_increasing_id())
    by_row = resolve_image_id(bare, fallback_order=["n"])
    assert sorted(r["id"] for r in by_row.collect()) == ["0", "1", "2"]
    with pytest.raises(KeyError):
        image_rows(bare)
    with pytest.raises(KeyError, match="image"):
        image_rows(table.drop("image"))
    named = image_rows_by_name(table.withColumnRenamed("inat24_file_name", "filename"))
    assert {r["id"] for r in named.collect()} == {"img_0", "img_1", "img_2"}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "k.1.png").write_bytes(b"abc")
    assert [(r["id"], bytes(r["image"])) for r in read_image_files(spark, str(tmp_path)).collect()] == [
        ("k", b"abc")
    ]
    with pytest.raises(ValueError, match="not found"):
        get_dataset(spark, {"dataset": "nothing"})
    with pytest.raises(ValueError, match="not found"):
        get_text_dataset(spark, {"dataset": "nothing"})
    got = get_dataset(spark, {"dataset": "image_files", "path": "/x", "kwargs": {"path": str(tmp_path)}})
    assert got.count() == 1


def shard_files(tmp_path, sizes, dim=4, kind=np.float16):
    meta, vec = tmp_path / "meta", tmp_path / "vec"
    meta.mkdir()
    vec.mkdir()
    for number, size in enumerate(sizes):
        paths = [f"s{number}/{i}.jpg" for i in range(size)]
        pq.write_table(pa.table({"image_path": paths, "x": paths}), meta / f"metadata_{number}.parquet")
        matrix = np.arange(size * dim).reshape(size, dim) + 1000 * number
        np.save(vec / f"img_emb_{number:03d}.npy", matrix.astype(kind))
    return meta, vec


def test_matrix_shards(spark, tmp_path):
    _, vec = shard_files(tmp_path, [5, 3])
    paths = [str(vec / f"img_emb_{n:03d}.npy") for n in range(2)]
    table = read_npy_shards(spark, paths, rows_per_partition=2)
    assert table.rdd.getNumPartitions() == 5
    rows = {(r["path"][-5], r["row_pos"]): r["embedding"] for r in table.collect()}
    assert len(rows) == 8 and rows["1", 2] == [1008.0, 1009.0, 1010.0, 1011.0]


def test_conversion(spark, tmp_path):
    meta, vec = shard_files(tmp_path, [5, 3, 4])
    out = str(tmp_path / "out")
    kwargs = {"model_name": "m", "dataset_name": "d"}
    convert_shards(spark, str(meta), str(vec), out, budget=7, **kwargs)
    rows = spark.read.parquet(out)
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    assert counts == {0: 5, 1: 2}
    one = rows.where("id = 's1/1.jpg'").first()
    assert one["embedding"] == [1004.0, 1005.0, 1006.0, 1007.0] and one["image_path"] == one["id"]
    # Existing shards are skipped and use none of the budget.
    convert_shards(spark, str(meta), str(vec), out, budget=3, **kwargs)
    rows = spark.read.parquet(out)
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    assert counts == {0: 5, 1: 2, 2: 3}
    convert_shards(spark, str(meta), str(vec), out, overwrite=True, **kwargs)
    rows = spark.read.parquet(out)
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    assert counts == {0: 5, 1: 3, 2: 4}


def test_conversion_refuses_uneven_shards(spark, tmp_path):
    meta, vec = shard_files(tmp_path, [2])
    np.save(vec / "img_emb_000.npy", np.zeros((3, 4), np.float32))
    with pytest.raises(ValueError, match="size mismatch"):
        convert_shards(
            spark, str(meta), str(vec), str(tmp_path / "o"), model_name="m", dataset_name="d"
        )


def test_pairing(spark, tmp_path):
    meta, vec = shard_files(tmp_path, [1, 1])
    np.save(vec / "img_emb_9.npy", np.zeros((1, 4)))
    listing = [
        list_files(spark, str(meta), "metadata_*.parquet"),
        list_files(spark, str(vec), "img_emb_*.npy"),
    ]
    pairs = pair_shards(*listing)
    assert {(r["shard"], r["meta_path"] is None) for r in pairs.collect()} == {
        (0, False), (1, False), (9, True),
    }
    assert checked_pairs(pairs).count() == 2
    np.save(vec / "img_emb_1.npy", np.zeros((1, 4)))
    with pytest.raises(ValueError, match="share one shard number"):
        checked_pairs(pair_shards(listing[0], list_files(spark, str(vec), "img_emb_*.npy")))
    with pytest.raises(FileNotFoundError):
        checked_pairs(pair_shards(listing[0], listing[1].where("file = 'img_emb_9.npy'")))


def test_half_precision_parquet(spark, tmp_path):
    values = np.arange(12, dtype=np.float16) / 3
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(values), 4)
    pq.write_table(pa.table({"id": ["a", "b", "c"], "embedding": vectors}), tmp_path / "h.parquet")
    files = list_files(spark, str(tmp_path), "*.parquet")
    rows = read_half_parquet(files, {"id": "string", "embedding": "array<float>"}).collect()
    assert {r["id"]: r["embedding"] for r in rows} == {
        name: [float(x) for x in values[4 * i : 4 * i + 4]] for i, name in enumerate("abc")
    }


def test_rows_limits_and_numbers(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 3)
    assert {r["id"] for r in keep_first_row(rows, ["k"], ["id"]).collect()} == {0, 1, 2}
    hot = spark.range(3000).withColumn("k", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")))
    first = keep_first_row(hot, ["k"], ["id"])
    assert first.count() == 1001
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    a = [r["id"] for r in sample_seeded(rows, "id", 20).collect()]
    b = [r["id"] for r in sample_seeded(rows.repartition(9), "id", 20).collect()]
    assert a == b and len(set(a)) == 20
    assert sample_seeded(rows, "id", 20, seed=1).collect() != sample_seeded(rows, "id", 20).collect()
    assert [r["id"] for r in head_limit(rows, ["id"], 3).collect()] == [0, 1, 2]
    assert head_limit(rows, ["id"], 0).count() == 0 and head_limit(rows, ["id"], None) is rows
    assert caption_limit(rows, ["id"], 2).count() == 10
    assert caption_limit(rows, ["id"], None).count() == 1000
    with pytest.raises(KeyError):
        lookup_one(rows, -1)
    with pytest.raises(ValueError, match="mismatch"):
        zip_positional(rows, rows.limit(3), ["id"])
    numbered = row_index(rows, ["k", "id"]).orderBy("index").collect()
    assert [r["index"] for r in numbered] == list(range(1000))
    assert [(r["k"], r["id"]) for r in numbered] == sorted((i % 3, i) for i in range(1000))
    assert row_index(rows.limit(0), ["id"]).count() == 0
    shards = spark.createDataFrame(
        [(0, 5, False), (1, 4, True), (2, 4, False), (10, 9, False)],
        "shard int, n_rows long, skipped boolean",
    )
    got = {r["shard"]: r["n_write"] for r in running_limit(shards, 7).collect()}
    assert got == {0: 5, 1: 0, 2: 2, 10: 0}
    assert {r["n_write"] for r in running_limit(shards, None).collect()} == {5, 0, 4, 9}


def test_paths_and_prompts(spark):
    row = spark.range(1).select(
        image_path("/root/", "x/{id}.jpg", F.lit("7")).alias("p"),
        prompt_prefix(F.lit("t"), "passage").alias("t"),
    )
    assert row.first().asDict() == {"p": "/root/x/7.jpg", "t": "Passage: t"}
    with pytest.raises(ValueError, match="code"):
        prompt_prefix(F.lit("t"), "code")


def test_summary_columns_are_united(spark, tmp_path):
    first = spark.createDataFrame([("a", 1)], "method string, x int")
    second = spark.createDataFrame([("b", 2)], "method string, y int")
    write_summary_csv([first, second], str(tmp_path / "s"))
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert back.columns == ["method", "x", "y"] and back.count() == 2
