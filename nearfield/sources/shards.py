"""Numpy matrix shards and half-precision Parquet, and their conversion to embedding tables."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from nearfield.operators.dedup import running_limit
from nearfield.session import materialise

ROWS_PER_PARTITION = 262_144
# Headers that one task reads.
HEADERS_PER_TASK = 64
ROWS_PER_BATCH = 4096


def _open(path: str) -> pa.NativeFile:
    """Any file system Arrow knows; Spark spells local paths ``file:/x``."""
    files, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return files.open_input_file(inner)


def _npy_header(handle: pa.NativeFile) -> tuple[tuple[int, ...], np.dtype, int]:
    version = np.lib.format.read_magic(handle)
    read = (
        np.lib.format.read_array_header_1_0
        if version == (1, 0)
        else np.lib.format.read_array_header_2_0
    )
    shape, fortran, kind = read(handle)
    if fortran or len(shape) != 2:
        raise ValueError("Expected a two-dimensional row-major matrix")
    return shape, kind, handle.tell()


@dataclass
class _RowRange(InputPartition):
    path: str
    start: int
    stop: int


class NpySource(DataSource):
    """``spark.read.format("npy")``: matrix files listed with their rows, one task per row range.

    The option ``manifest`` has a line ``path<tab>rows`` per file, as ``read_npy_shards`` makes it.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, row_pos bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    """Filters on path and row position decide which ranges are read at all."""

    def __init__(self, options) -> None:
        lines = [line.split("\t") for line in options.get("manifest", "").split("\n") if line]
        self.files = [(path, int(rows)) for path, rows in lines]
        self.rows = int(options.get("rowsPerPartition", ROWS_PER_PARTITION))
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (Spark's name)
        for item in filters:
            if not self._taken(item):
                yield item

    def _taken(self, item: Filter) -> bool:
        name, value = getattr(item, "attribute", ()), getattr(item, "value", None)
        if name == ("path",) and isinstance(item, (EqualTo, In)):
            wanted = {value} if isinstance(item, EqualTo) else set(value)
            self.files = [f for f in self.files if f[0] in wanted]
            return True
        if name != ("row_pos",) or not isinstance(value, int):
            return False
        if isinstance(item, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, value + isinstance(item, GreaterThan))
        if isinstance(item, (EqualTo, LessThan, LessThanOrEqual)):
            stop = value + (not isinstance(item, LessThan))
            self.high = stop if self.high is None else min(self.high, stop)
        return isinstance(item, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))

    def partitions(self) -> list[InputPartition]:
        ranges: list[InputPartition] = []
        for path, total in self.files:
            stop = total if self.high is None else min(total, self.high)
            ranges += [_RowRange(path, at, min(at + self.rows, stop)) for at in range(self.low, stop, self.rows)]
        return ranges or [_RowRange("", 0, 0)]

    def read(self, partition: _RowRange) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        at = partition.start
        for vectors in _row_range(partition.path, partition.start, partition.stop):
            rows = len(vectors)
            places = pa.array(np.arange(at, at + rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * rows), places, vectors],
                names=["path", "row_pos", "embedding"],
            )
            at += rows


def npy_manifest(files: DataFrame) -> DataFrame:
    """``path, rows`` of matrix files, from headers that tasks read."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                with _open(path) as handle:
                    rows.append(_npy_header(handle)[0][0])
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(rows, pa.int64())], ["path", "rows"])

    return _dealt(files.select("path"), HEADERS_PER_TASK).mapInArrow(headers, "path string, rows bigint")


def _dealt(listing: DataFrame, each: int) -> DataFrame:
    """A listing over so many tasks that each gets about ``each`` of its rows."""
    return listing.repartition(max(1, math.ceil(listing.count() / each)))


def read_npy_shards(spark: SparkSession, paths: list[str], rows_per_partition: int | None = None):
    """``path, row_pos, embedding`` of matrix files; filters on path and position skip what they can."""
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = npy_manifest(spark.createDataFrame([(p,) for p in paths], "path string"))
    rows = {r["path"]: r["rows"] for r in listed.collect()}
    reader = spark.read.format("npy").option("manifest", "\n".join(f"{p}\t{rows[p]}" for p in paths))
    if rows_per_partition:
        reader = reader.option("rowsPerPartition", str(rows_per_partition))
    return reader.load()


def shard_sizes(pairs: DataFrame) -> DataFrame:
    """Pairs with ``n_rows`` and ``n_vectors``, from headers that tasks read."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = [], []
            for meta, npy in zip(batch["meta_path"].to_pylist(), batch["npy_path"].to_pylist(), strict=True):
                with _open(meta) as left, _open(npy) as right:
                    rows.append(pq.ParquetFile(left).metadata.num_rows)
                    vectors.append(_npy_header(right)[0][0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, pa.int64()), pa.array(vectors, pa.int64())],
                [*batch.schema.names, "n_rows", "n_vectors"],
            )

    listed = _dealt(pairs.select("shard", "meta_path", "npy_path"), HEADERS_PER_TASK)
    return listed.mapInArrow(
        sizes, "shard bigint, meta_path string, npy_path string, n_rows bigint, n_vectors bigint"
    )


def zipped_rows(quotas: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Metadata rows next to their matrix rows: ``shard, row_pos, image_path, embedding``.

    ``quotas`` names both files of a shard and how many rows to take (``n_write``). Each task reads
    row ranges of both files: row i belongs to row i, so nothing is joined or shuffled but ranges.
    """
    each = F.lit(int(rows_per_partition))
    ranges = quotas.where("n_write > 0").select(
        "shard",
        "meta_path",
        "npy_path",
        "n_write",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n_write") - 1) / each))).alias("range"),
    )
    ranges = ranges.select(
        "shard",
        "meta_path",
        "npy_path",
        (F.col("range") * each).alias("start"),
        F.least((F.col("range") + 1) * each, "n_write").alias("stop"),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = _column_range(row["meta_path"], "image_path", row["start"], row["stop"])
                matrix = _row_range(row["npy_path"], row["start"], row["stop"])
                at = row["start"]
                for name, vectors in _in_step(names, matrix):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(name), row["shard"], np.int64)),
                            pa.array(np.arange(at, at + len(name), dtype=np.int64)),
                            name,
                            vectors,
                        ],
                        names=["shard", "row_pos", "image_path", "embedding"],
                    )
                    at += len(name)

    schema = "shard bigint, row_pos bigint, image_path string, embedding array<float>"
    return _dealt(ranges, 1).mapInArrow(read, schema)


def _in_step(names: Iterator[pa.Array], matrix: Iterator[pa.Array]):
    """Cut two streams of arrays at common row boundaries."""
    left, right = pa.array([], pa.string()), None
    for right in matrix:
        while len(right):
            if not len(left):
                left = next(names)
            rows = min(len(left), len(right))
            yield left[:rows], right[:rows]
            left, right = left[rows:], right[rows:]


def _row_range(path: str, start: int, stop: int) -> Iterator[pa.Array]:
    """Rows of a matrix file as float32 lists, a batch at a time."""
    with _open(path) as handle:
        (_, dim), kind, origin = _npy_header(handle)
        handle.seek(origin + start * dim * kind.itemsize)
        for at in range(start, stop, ROWS_PER_BATCH):
            rows = min(ROWS_PER_BATCH, stop - at)
            raw = np.frombuffer(handle.read(rows * dim * kind.itemsize), kind)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(raw.astype(np.float32)), dim)
            yield vectors.cast(pa.list_(pa.float32()))


def _column_range(path: str, column: str, start: int, stop: int) -> Iterator[pa.Array]:
    """One text column of a Parquet file between two rows; other row groups are not read."""
    with _open(path) as handle:
        file = pq.ParquetFile(handle)
        first = 0
        for group in range(file.num_row_groups):
            rows = file.metadata.row_group(group).num_rows
            low, high = max(start - first, 0), min(stop - first, rows)
            if low < high:
                data = file.read_row_group(group, columns=[column])[column].combine_chunks()
                yield data[low:high].cast(pa.string())
            first += rows


def read_half_parquet(files: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Parquet files whose vectors are float16, which Spark's own reader refuses.

    ``files`` has one ``path`` per row; ``columns`` maps the wanted columns to Spark types. Each
    task streams the row groups of its files, so no file is held whole.
    """
    schema = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    names = list(columns)

    def widen(column: pa.Array) -> pa.Array:
        if pa.types.is_fixed_size_list(column.type) or pa.types.is_list(column.type):
            if pa.types.is_float16(column.type.value_type):
                rows = len(column)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                width = len(flat) // rows if rows else 0
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
                return pa.ListArray.from_arrays(offsets, pa.array(flat))
        return column

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                with _open(path) as handle:
                    for part in pq.ParquetFile(handle).iter_batches(ROWS_PER_BATCH, columns=names):
                        picked = [widen(part[name]) for name in names]
                        yield pa.RecordBatch.from_arrays(picked, names=names)

    # One task per file: the listing is a few rows, the files are large.
    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, schema)


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths and sizes of matching files (the content column is pruned, nothing is read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.substring_index("path", "/", -1).alias("file"))


def shard_number(file: Column, prefix: str) -> Column:
    """Numeric suffix of ``<prefix>N.ext`` without leading zeros."""
    digits = F.regexp_extract(file, rf"^{re.escape(prefix)}(\d+)\.[^.]+$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def pair_shards(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """Match ``metadata_N`` with ``img_emb_N`` files by number.

    Both sides are file listings (``path, file``). The result keeps one-sided shards, with a null
    path on the other side, so that callers can report them.
    """
    left = metadata.select(
        shard_number(F.col("file"), "metadata_").alias("shard"), F.col("path").alias("meta_path")
    )
    right = vectors.select(
        shard_number(F.col("file"), "img_emb_").alias("shard"), F.col("path").alias("npy_path")
    )
    return left.join(right, "shard", "full_outer")


def checked_pairs(pairs: DataFrame) -> DataFrame:
    """Two-sided shards; none at all, a bad name or two files for one number is an error."""
    if pairs.where("shard is null").head(1):
        raise ValueError("Could not extract a numeric suffix from a shard name")
    if pairs.groupBy("shard").count().where("count > 1").head(1):
        raise ValueError("Several files share one shard number")
    both = pairs.where("meta_path is not null and npy_path is not null")
    if not both.head(1):
        raise FileNotFoundError("No matching metadata/img_emb shard pairs were found.")
    return both


def convert_rows(
    metadata: DataFrame,
    vectors: DataFrame,
    *,
    model_name: str,
    dataset_name: str,
    budget: int | None = None,
    done: DataFrame | None = None,
) -> DataFrame:
    """Zip two tables, ``shard, row_pos, image_path`` and ``shard, row_pos, embedding``.

    A shard whose sides differ in length fails the job. ``budget`` limits the rows over all
    shards in shard order; shards in ``done`` are skipped and use none of it.
    """
    counts = (
        metadata.groupBy("shard")
        .agg(F.count("*").alias("n_rows"))
        .join(vectors.groupBy("shard").agg(F.count("*").alias("n_vectors")), "shard")
    )
    uneven = counts.where("n_rows <> n_vectors").head(1)
    if uneven:
        raise ValueError(f"Shard size mismatch: {uneven[0].asDict()}")
    if done is None:
        counts = counts.withColumn("skipped", F.lit(False))
    else:
        marks = done.select("shard").distinct().withColumn("skipped", F.lit(True))
        counts = counts.join(marks, "shard", "left").withColumn(
            "skipped", F.coalesce("skipped", F.lit(False))
        )
    quota = running_limit(counts, budget).select("shard", "n_write")
    return (
        metadata.join(vectors, ["shard", "row_pos"])
        .join(quota, "shard")
        .where(F.col("row_pos") < F.col("n_write"))
        .transform(embedding_rows, model_name, dataset_name)
    )


def embedding_rows(zipped: DataFrame, model_name: str, dataset_name: str) -> DataFrame:
    """The published columns; the path is also the id."""
    return zipped.select(
        "shard",
        F.col("image_path").cast("string").alias("id"),
        F.col("image_path").cast("string").alias("image_path"),
        F.lit(model_name).alias("model_name"),
        F.lit(dataset_name).alias("dataset_name"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )


def convert_shards(
    spark: SparkSession,
    metadata_dir: str,
    vectors_dir: str,
    output: str,
    *,
    model_name: str,
    dataset_name: str,
    overwrite: bool = False,
    budget: int | None = None,
    rows_per_file: int = 100_000,
) -> DataFrame:
    """Read both folders and write ``<output>/shard=N/`` with zstd; returns what was written."""
    pairs = checked_pairs(
        pair_shards(
            list_files(spark, metadata_dir, "metadata_*.parquet"),
            list_files(spark, vectors_dir, "img_emb_*.npy"),
        )
    )
    done: set[int] = set()
    if not overwrite:
        try:
            held = spark.read.parquet(output).select(F.col("shard").cast("bigint")).distinct()
            done = {row["shard"] for row in held.collect()}
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    marks = spark.createDataFrame([(n,) for n in sorted(done)], "shard bigint")
    sized = materialise(
        shard_sizes(pairs).join(F.broadcast(marks.withColumn("skipped", F.lit(True))), "shard", "left")
        .withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    )
    uneven = sized.where("n_rows <> n_vectors and not skipped").head(1)
    if uneven:
        row = uneven[0]
        raise ValueError(
            f"Shard size mismatch: {row['meta_path']} has {row['n_rows']} rows,"
            f" {row['npy_path']} has {row['n_vectors']}"
        )
    zipped = zipped_rows(running_limit(sized, budget))
    rows = embedding_rows(zipped, model_name, dataset_name)
    (
        rows.write.mode("overwrite" if overwrite else "append")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("shard")
        .parquet(output)
    )
    return spark.read.parquet(output)
