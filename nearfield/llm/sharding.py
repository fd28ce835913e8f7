"""Sharding by a two-pass external shuffle.

Pass one scatters the rows with seeded hashes into buckets small enough for a task's memory; the
shuffle files are the external buckets. Pass two orders each bucket canonically, shuffles it with
Fisher-Yates under a seed of its own and writes it below its shard's folder.

The shard itself follows the law ``key``: rendezvous hashing, that is, the shard whose seeded hash
with the document id is largest. It depends on nothing but the id and the number of shards, and one
more shard takes rows only into itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import broadcast

from nearfield.llm.common import scratch, small, written

# Text bytes of one bucket: a task holds the bucket and its shuffled copy.
BUCKET_BYTES = 24 << 20
# Equal rows with more bytes than this share of a bucket spread over buckets.
CROWDED_SHARE = 0.25
# Crowded rows, known by their marks, that are still sent to every executor.
BROADCAST_MARKS = 1_000_000
# Buckets whose offsets are still sent to every executor (24 bytes each).
BROADCAST_BUCKETS = 200_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard of a key; a null key has a shard like any other."""
    bids = [
        F.struct(F.xxhash64(F.lit(seed), F.lit(j), key).alias("bid"), F.lit(j).alias("shard"))
        for j in range(shards)
    ]
    return F.array_max(F.array(*bids))["shard"]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _storable(docs: DataFrame) -> list[Column]:
    """Parquet holds no column without a type."""
    return [
        F.col(f"`{f.name}`").cast("string" if isinstance(f.dataType, T.NullType) else f.dataType)
        .alias(f.name)
        for f in docs.schema
    ]


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _copies_numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``crowded`` by ``copy``: a running number of equal crowded rows, else null.

    Rows of one mark are equal, so it does not matter which of them gets which number; they are
    counted for each input partition, so that a task that runs again sends as many to each bucket.
    """
    seen: Counter = Counter()
    for batch in batches:
        crowded = batch.column("crowded").to_numpy(zero_copy_only=False).astype(bool)
        groups = np.stack([np.asarray(batch.column(c))[crowded] for c in ("mark", "part")], axis=1)
        kinds, which, counts = np.unique(groups, axis=0, return_inverse=True, return_counts=True)
        kinds = [tuple(kind) for kind in kinds.tolist()]
        first = np.array([seen[kind] for kind in kinds], np.int64)
        order = np.argsort(which, kind="stable")
        within = np.empty(len(groups), np.int64)
        within[order] = np.arange(len(groups)) - np.repeat(np.cumsum(counts) - counts, counts)
        seen.update(dict(zip(kinds, counts.tolist(), strict=True)))
        copy = np.zeros(batch.num_rows, np.int64)
        copy[crowded] = first[which] + within
        names = [name for name in batch.schema.names if name != "crowded"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in names), pa.array(copy, mask=~crowded)],
            names=[*names, "copy"],
        )


def _shuffled(seed: int):
    def fisher_yates(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard, bucket = (int(part.as_py()) for part in key)
        # Rows arrive in any order; a canonical one makes the shuffle repeatable.
        order = pc.sort_indices(rows, sort_keys=[("mark", "ascending"), ("size", "ascending")])
        draw = np.random.Generator(np.random.PCG64([seed, shard, bucket]))
        places = draw.permutation(rows.num_rows)  # a Fisher-Yates shuffle of 0..n-1
        out = rows.take(order.take(pa.array(places)))
        place = pa.array(np.arange(rows.num_rows, dtype=np.int64))
        return out.drop_columns(["mark"]).append_column("place", place)

    return fisher_yates


def shuffle_to_shards(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 20,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write shuffled shards below the shared folder and return them.

    Result: ``rec`` (the whole input row), ``size`` (UTF-8 bytes of the text plus 1),
    ``text_crc32``, ``shard``, ``grown_shard`` (the shard were there one more) and ``slot``
    (the row's place in its shard, gapless from 0). A null text has no bytes; a null key is a key;
    repeated rows are kept, each with a slot of its own; an empty table gives no rows. Columns of
    the input stay inside ``rec``, so no name can clash. Rows of a crowded key spread over buckets
    by the whole row; equal rows that would crowd a bucket are numbered within their input partition
    and spread by that number. Other rows' buckets, and without crowded copies all slots, do not
    depend on the layout of the input. A row longer than a bucket is a bucket of its own length.
    """
    spark = docs.sparkSession
    whole = [F.col(f"`{f.name}`") for f in docs.schema if _hashable(f.dataType)]
    rows = docs.select(
        F.struct(*_storable(docs)).alias("rec"),
        text_bytes(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.lit(seed), *whole).alias("mark"),
        rendezvous(F.col(key), shards, seed).alias("shard"),
        rendezvous(F.col(key), shards + 1, seed).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    )
    totals = dict(rows.groupBy("shard").agg(F.sum("size")).collect())  # one row per shard
    buckets = [max(1, math.ceil(totals.get(j, 0) / bucket_bytes)) for j in range(shards)]
    crowded = written(
        rows.groupBy("mark")
        .agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > CROWDED_SHARE * bucket_bytes)
        .select("mark", F.lit(True).alias("crowded")),
        "crowded-rows",
    )
    marked = rows.join(small(crowded, BROADCAST_MARKS), "mark", "left").withColumn(
        "crowded", F.coalesce("crowded", F.lit(False))
    )
    counted = marked.mapInArrow(
        _copies_numbered,
        T.StructType(
            [f for f in marked.schema if f.name != "crowded"] + [T.StructField("copy", T.LongType())]
        ),
    )
    place = F.xxhash64(
        F.lit(seed + 1), F.col("mark"), F.when(F.col("copy").isNotNull(), F.col("part")), F.col("copy")
    )
    per_shard = F.get(F.array(*map(F.lit, buckets)), F.col("shard"))
    scattered = counted.withColumn("bucket", F.pmod(place, per_shard).cast("int")).drop("part", "copy")
    schema = T.StructType(
        [f for f in scattered.schema if f.name != "mark"] + [T.StructField("place", T.LongType())]
    )
    path = scratch(spark, "shards")
    (
        scattered.groupBy("shard", "bucket")
        .applyInArrow(_shuffled(seed), schema)
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(path)
    )
    return numbered(spark.read.schema(schema).parquet(path), sum(buckets))


def numbered(shuffled: DataFrame, buckets: int) -> DataFrame:
    """Turn places in buckets into slots of shards by an exclusive sum over the bucket counts."""
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = shuffled.groupBy("shard", "bucket").count()
    starts = counts.select(
        "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    starts = broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    joined = shuffled.join(starts, ["shard", "bucket"])
    return joined.select(
        "rec",
        "size",
        "text_crc32",
        "shard",
        "grown_shard",
        (F.col("start") + F.col("place")).alias("slot"),
    )
