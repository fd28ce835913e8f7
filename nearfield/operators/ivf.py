"""Inverted lists: train or take centroids, file every row under its best one, probe a few."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.vectors import l2_normalize
from nearfield.operators.knn import (
    DEFAULT_LIMITS,
    Limits,
    check_metric,
    held_if_small,
    keep_first,
    nearest,
    overfetch,
    with_nearest,
)
from nearfield.operators.topk import to_matrix
from nearfield.schema import VECTOR, require_positive, vector_stats
from nearfield.session import materialise, short_table

CENTROIDS = T.StructType(
    [T.StructField("list_id", T.LongType()), T.StructField("embedding", VECTOR)]
)
# Up to this many probed lists are named in a filter that reaches the scan.
PUSHED_LISTS = 4096
# Folders a saved index is divided into at most, and bytes of one of its files.
LIST_PARTS = 4096
FILE_BYTES = 128 << 20
# Means are taken of multiples of this, so sums are the same in any order.
GRAIN = 2.0**-20
# Partial sums a task holds before it passes them on.
PARTIAL_BYTES = 64 << 20


def first_by_digest(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest digests of seed and id, numbered from 0 as ``place``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    few = rows.withColumn("_digest", digest).orderBy("_digest", "id").limit(int(n))
    order = Window.orderBy("_digest", "id")
    return few.withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("_digest")


def group_means(rows: DataFrame, group: str) -> DataFrame:
    """``group, embedding``: mean vector of every group, the same in any layout.

    Tasks add up what they read, so only one row per group and task is shuffled.
    """
    kind = rows.schema[group].dataType
    out = T.StructType(
        [
            T.StructField(group, kind),
            T.StructField("n", T.LongType()),
            T.StructField("sums", T.ArrayType(T.DoubleType())),
        ]
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, counts = np.zeros(0, np.int64), None, np.zeros(0, np.int64)

        def passed_on():
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(-1)), sums.shape[1])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys),
                    pa.array(counts),
                    vectors.cast(pa.list_(pa.float64())),
                ],
                [group, "n", "sums"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = to_matrix(batch["embedding"]).astype(np.float64)
            matrix = np.floor(matrix / GRAIN + 0.5) * GRAIN
            own, at = np.unique(batch[group].to_numpy(), return_inverse=True)
            if sums is None:
                sums = np.zeros((0, matrix.shape[1]))
            merged = np.union1d(keys, own)
            grown, grown_counts = np.zeros((len(merged), matrix.shape[1])), np.zeros(len(merged), np.int64)
            old = np.searchsorted(merged, keys)
            grown[old], grown_counts[old] = sums, counts
            new = np.searchsorted(merged, own)[at]
            np.add.at(grown, new, matrix)
            grown_counts += np.bincount(new, minlength=len(merged))
            keys, sums, counts = merged, grown, grown_counts
            if sums.nbytes > PARTIAL_BYTES:
                yield passed_on()
                keys, sums, counts = keys[:0], sums[:0], counts[:0]
        if len(keys):
            yield passed_on()

    partial = rows.select(group, "embedding").mapInArrow(add, out)
    means = (
        partial.select(group, "n", F.posexplode("sums").alias("pos", "x"))
        .groupBy(group, "pos")
        .agg((F.sum("x") / F.sum("n")).cast("float").alias("x"))
    )
    return means.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(
            "embedding"
        )
    )


def _points(gallery: DataFrame, metric: str) -> DataFrame:
    """``id, embedding`` as trained on: unit vectors for the cosine."""
    vector = F.col("embedding")
    if check_metric(metric) == "cosine":
        vector = l2_normalize(vector).cast("array<float>")
    return gallery.select(F.col("id").cast("string").alias("id"), vector.alias("embedding"))


def lloyd(filed, centroids: DataFrame, max_iter: int) -> DataFrame:
    """Lloyd's steps from given centroids; ``filed`` files the rows under centroids.

    A list that nobody is nearest to stays where it is; columns besides the vector stay as well.
    """
    more = [name for name in centroids.columns if name not in ("list_id", "embedding")]
    for _ in range(max_iter):
        cells = filed(centroids).select(F.col("cells")[0].alias("list_id"), "embedding")
        means = group_means(cells, "list_id")
        moved = materialise(
            centroids.withColumnRenamed("embedding", "old")
            .join(means, "list_id", "left")
            .select("list_id", F.coalesce("embedding", "old").alias("embedding"), *more, "old")
        )
        centroids = moved.drop("old")
        if moved.where("embedding != old").isEmpty():
            break
    return centroids


def train_centroids(
    gallery: DataFrame,
    nlist: int,
    metric: str = "l2",
    *,
    seed: int = 42,
    max_iter: int = 10,
    limits: Limits | None = None,
) -> DataFrame:
    """k-means centroids ``list_id, embedding`` of all rows; fewer when there are fewer rows.

    Lloyd's steps over the whole gallery. Starting points go by the digest of the id, and sums do
    not depend on their order, so any layout of the gallery gives the same centroids.
    """
    require_positive(nlist=nlist, max_iter=max_iter)
    points = _points(gallery, metric)
    start = materialise(
        first_by_digest(points, nlist, seed).select(F.col("place").alias("list_id"), "embedding")
    )
    return lloyd(
        lambda c: with_nearest(points, "id", c, 1, "l2", normalize=False, limits=limits), start, max_iter
    )


# Many lists ---------------------------------------------------------------------------------

# Rounds of oversampling, and how many candidates a round takes per centroid wanted.
ROUNDS, OVERSAMPLING = 4, 2.0
# Starting points of a top's lists are drawn from so many rows per list.
DRAWN = 8
# Partings of [0, 1) by a digest.
_PARTS = float(1 << 52)


def _chance(seed: int, *more) -> Column:
    """A number in [0, 1) from the digest of seed and id: the same in any layout."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), *more))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / _PARTS


def oversampled_start(points: DataFrame, n: int, seed: int, limits: Limits | None = None) -> DataFrame:
    """Starting centroids by k-means||: ``list_id, embedding``.

    Each round takes every row with a chance in proportion to its squared distance from the
    candidates so far, some ``OVERSAMPLING * n`` rows in all. The candidates (at most a few times
    ``n``) are then weighted by the rows nearest to them and thinned out to ``n``.
    """
    chosen = materialise(first_by_digest(points, 1, seed).select("id", "embedding"))
    for step in range(ROUNDS):
        numbered = chosen.select(
            (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("list_id"), "embedding"
        )
        far = _far(points, materialise(numbered), limits)
        total = far.agg(F.sum("gap")).first()[0] or 0.0
        if total <= 0.0:
            break
        taken = far.where(_chance(seed + step + 1) < F.lit(OVERSAMPLING * n) * F.col("gap") / F.lit(total))
        chosen = materialise(
            chosen.unionByName(taken.select("id", "embedding")).dropDuplicates(["embedding"])
        )
    candidates = materialise(
        chosen.select(
            (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("list_id"), "embedding"
        )
    )
    filed = with_nearest(points, "id", candidates, 1, "l2", normalize=False, limits=limits)
    weights = filed.groupBy(F.col("cells")[0].alias("list_id")).agg(F.count("*").alias("rows"))
    weighted = candidates.join(weights, "list_id", "left").select(
        "embedding", F.coalesce("rows", F.lit(0)).alias("rows"), "list_id"
    )
    table = weighted.orderBy("list_id").toArrow()
    picked = _spread(to_matrix(table["embedding"]).astype(np.float64), table["rows"].to_numpy(), n)
    few = table.select(["embedding"]).take(pa.array(picked)).append_column(
        "list_id", pa.array(np.arange(len(picked)))
    )
    session = points.sparkSession
    return session.createDataFrame(few.select(["list_id", "embedding"]), CENTROIDS)


def _far(points: DataFrame, centroids: DataFrame, limits: Limits | None) -> DataFrame:
    """``id, embedding, gap``: squared distance to the nearest of a bounded set of candidates."""
    filed = with_nearest(points, "id", centroids, 1, "l2", normalize=False, limits=limits)
    near = centroids.select(F.col("list_id").alias("_near"), F.col("embedding").alias("_center"))
    joined = filed.join(short_table(near), F.col("cells")[0] == F.col("_near"))
    gap = F.aggregate(
        F.zip_with("embedding", "_center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )
    return joined.select("id", "embedding", gap.alias("gap"))


def _spread(matrix: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` candidates that are heavy and far apart: the farthest by weighted squared distance."""
    if len(matrix) <= n:
        return np.arange(len(matrix))
    picked = [int(np.argmax(rows))]
    gap = ((matrix - matrix[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < n:
        best = int(np.argmax(gap * np.maximum(rows, 1)))
        picked.append(best)
        gap = np.minimum(gap, ((matrix - matrix[best]) ** 2).sum(axis=1))
    return np.array(sorted(picked))


@dataclass(frozen=True)
class CentroidTree:
    """Centroids under centroids: a row is compared with the tops, then with lists of ``beam`` tops."""

    tops: DataFrame  # list_id, embedding
    centroids: DataFrame  # list_id, embedding, top_id
    beam: int = 2

    def file(
        self,
        df: DataFrame,
        key: str,
        n: int,
        metric: str,
        normalize: bool | None = None,
        limits: Limits | None = None,
        centroids: DataFrame | None = None,
    ) -> DataFrame:
        """Append ``cells``: the ``n`` best lists among those of the ``beam`` best tops."""
        kept = limits or DEFAULT_LIMITS
        high = with_nearest(df, key, self.tops, self.beam, metric, normalize=normalize, limits=kept)
        return with_nearest(
            high,
            key,
            self.centroids if centroids is None else centroids,
            n,
            metric,
            normalize=normalize,
            within=True,
            limits=kept,
        )


def train_tree(
    gallery: DataFrame,
    nlist: int,
    metric: str = "l2",
    *,
    branches: int | None = None,
    beam: int = 2,
    seed: int = 42,
    max_iter: int = 10,
    limits: Limits | None = None,
) -> CentroidTree:
    """A tree of about ``nlist`` lists under ``branches`` tops (their square root by default).

    A row meets ``branches`` tops and the lists of one of them, never all lists. Tops start by
    k-means||; each gets lists in proportion to its rows, started by digest, and all lists are
    trained at once.
    """
    require_positive(nlist=nlist, max_iter=max_iter, beam=beam)
    branches = branches or max(1, math.isqrt(nlist))
    points = _points(gallery, metric)
    start = oversampled_start(points, min(branches, nlist), seed, limits)

    def nearest_top(c: DataFrame, n: int = 1) -> DataFrame:
        return with_nearest(points, "id", c, n, "l2", normalize=False, limits=limits)

    tops = lloyd(nearest_top, start, max_iter)
    filed = materialise(nearest_top(tops))
    top = F.col("cells")[0]
    counts = materialise(filed.groupBy(top.alias("top_id")).agg(F.count("*").alias("rows")))
    total = counts.agg(F.sum("rows")).first()[0] or 1
    wanted = F.greatest(F.lit(1), F.floor(F.lit(nlist / total) * F.col("rows"))).alias("wanted")
    shares = short_table(counts.select("top_id", "rows", wanted))
    # Few rows of each top are ranked; a crowded top is thinned out first.
    drawn = filed.withColumn("top_id", top).join(shares, "top_id").where(
        _chance(seed) * F.col("rows") < F.lit(DRAWN) * F.col("wanted")
    )
    order = Window.partitionBy("top_id").orderBy(_chance(seed), "id")
    first = (
        drawn.withColumn("place", F.row_number().over(order))
        .where("place <= wanted")
        .dropDuplicates(["top_id", "embedding"])
        .select("top_id", "place", "embedding")
    )
    numbers = Window.orderBy("top_id", "place")
    leaves = materialise(
        first.select((F.row_number().over(numbers) - 1).cast("long").alias("list_id"), "embedding", "top_id")
    )
    leaves = lloyd(
        lambda c: with_nearest(filed, "id", c, 1, "l2", normalize=False, within=True, limits=limits),
        leaves,
        max_iter,
    )
    return CentroidTree(tops, leaves, beam)


@dataclass(frozen=True)
class InvertedLists:
    """Centroids plus the gallery filed under ``list_id``, with attributes to filter by."""

    centroids: DataFrame
    rows: DataFrame
    metric: str
    normalize: bool | None = None
    # Tops of the centroids, where there are many (centroids then have a ``top_id``).
    tops: DataFrame | None = None
    beam: int = 2

    @property
    def attributes(self) -> list[str]:
        own = ("id", "embedding", "list_id", "part")
        return [name for name in self.rows.columns if name not in own]

    def nearest(
        self, df: DataFrame, key: str, n: int, limits: Limits | None, centroids: DataFrame | None = None
    ) -> DataFrame:
        """Append ``cells``, the ``n`` best lists (of ``centroids``, a part of them) of each row."""
        chosen = self.centroids if centroids is None else centroids
        if self.tops is not None:
            tree = CentroidTree(self.tops, chosen, self.beam)
            return tree.file(df, key, n, self.metric, self.normalize, limits)
        return with_nearest(df, key, chosen, n, self.metric, normalize=self.normalize, limits=limits)

    def save(self, path: str, files: int | None = None, parts: int | None = None) -> None:
        """Rows in folders of list groups, so that probing reads the probed groups only.

        The number of files goes by the bytes of the vectors unless it is given.
        """
        write_by_list(self.centroids, self.rows, path, "lists", files, parts)
        if self.tops is not None:
            self.tops.write.mode("overwrite").parquet(f"{path}/tops")

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        path: str,
        metric: str,
        normalize: bool | None = None,
        beam: int = 2,
    ) -> InvertedLists:
        centroids = spark.read.parquet(f"{path}/centroids")
        return cls(
            centroids,
            spark.read.parquet(f"{path}/lists"),
            check_metric(metric),
            normalize,
            spark.read.parquet(f"{path}/tops") if "top_id" in centroids.columns else None,
            beam,
        )


def write_by_list(
    centroids: DataFrame,
    rows: DataFrame,
    path: str,
    name: str,
    files: int | None,
    parts: int | None = None,
) -> None:
    """Rows under ``part=<n>/``, sorted by list; the centroids remember each list's part.

    One part per list up to ``LIST_PARTS``. The id takes part in the range, which splits a list
    that holds much of the table over several tasks.
    """
    parts = parts or min(LIST_PARTS, max(1, centroids.count()))
    if files is None:
        dim = vector_stats(centroids)[1]
        files = max(1, math.ceil(rows.count() * 4 * dim / FILE_BYTES))
    part = F.pmod(F.col("list_id"), F.lit(parts)).cast("int").alias("part")
    centroids.select(*[c for c in centroids.columns if c != "part"], part).write.mode("overwrite").parquet(
        f"{path}/centroids"
    )
    (
        rows.select(*[c for c in rows.columns if c != "part"], part)
        .repartitionByRange(files, "part", "list_id", "id")
        .sortWithinPartitions("part", "list_id", "id")
        .write.mode("overwrite")
        .partitionBy("part")
        .parquet(f"{path}/{name}")
    )


def build_lists(
    gallery: DataFrame,
    centroids: DataFrame | CentroidTree,
    metric: str = "l2",
    *,
    normalize: bool | None = None,
    attributes: Sequence[str] = (),
    limits: Limits | None = None,
) -> InvertedLists:
    """File rows under the best centroid by the search metric; ties go to the smaller list.

    ``attributes`` are columns of the gallery that searches may filter by. A tree of centroids
    compares each row with the lists of its best tops only.
    """
    limits = limits or DEFAULT_LIMITS
    tops, beam = None, 2
    if isinstance(centroids, CentroidTree):
        tops, beam, centroids = centroids.tops, centroids.beam, centroids.centroids
    # Building and probing read the centroids several times.
    centroids = held_if_small(centroids, *vector_stats(centroids), limits)
    empty = InvertedLists(centroids, gallery, check_metric(metric), normalize, tops, beam)
    filed = empty.nearest(gallery.select("id", "embedding", *attributes), "id", 1, limits)
    rows = filed.select("id", "embedding", F.col("cells")[0].alias("list_id"), *attributes)
    return replace(empty, rows=rows)


def probes(
    queries: DataFrame, lists: InvertedLists, nprobe: int, limits: Limits | None = None
) -> DataFrame:
    """Queries with ``cells``, the ``nprobe`` lists each of them looks into."""
    require_positive(nprobe=nprobe)
    return lists.nearest(queries.select("qid", "embedding"), "qid", nprobe, limits)


def filtered_probes(
    queries: DataFrame,
    lists: InvertedLists,
    matching: DataFrame,
    nprobe: int,
    enough: int,
    limits: Limits | None = None,
) -> tuple[DataFrame, int]:
    """Queries with ``cells`` for a search among ``matching`` rows, and the most cells there are.

    Only lists that hold matching rows count. A query opens its ``nprobe`` best of them, and goes on
    until the opened lists hold ``enough`` matching rows. Every list that counts has one at least, so
    ``enough`` lists always do.
    """
    require_positive(nprobe=nprobe, enough=enough)
    counts = short_table(
        matching.groupBy(F.col("list_id").cast("long").alias("list_id")).agg(F.count("*").alias("matches"))
    )
    live = lists.centroids.join(counts.select("list_id"), "list_id", "left_semi")
    live = held_if_small(live, *vector_stats(lists.centroids), limits or DEFAULT_LIMITS)
    most = max(int(nprobe), int(enough))
    asked = queries.select("qid", "embedding")
    if live.isEmpty():
        return asked.withColumn("cells", F.array().cast("array<bigint>")), 0
    found = lists.nearest(asked, "qid", most, limits, live)
    found = materialise(found.withColumn("_row", F.monotonically_increasing_id()))
    before = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    opened = (
        found.select("_row", F.posexplode("cells").alias("pos", "list_id"))
        .join(counts, "list_id")
        .withColumn("before", F.coalesce(F.sum("matches").over(before), F.lit(0)))
        .where((F.col("pos") < int(nprobe)) | (F.col("before") < int(enough)))
    )
    cells = opened.groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "list_id"))), lambda s: s["list_id"]).alias(
            "cells"
        )
    )
    return found.drop("cells").join(cells, "_row").drop("_row"), most


def probed_rows(rows: DataFrame, asked: DataFrame, centroids: DataFrame) -> DataFrame:
    """Only the rows of lists that some query probes.

    Few lists become literal filters: on saved lists the one on ``part`` picks folders. With many
    lists nearly everything is read anyway, and the tasks ignore what nobody probes.
    """
    wanted = asked.select(F.explode("cells").alias("list_id")).distinct().limit(PUSHED_LISTS + 1)
    names = [row["list_id"] for row in wanted.collect()]
    if len(names) > PUSHED_LISTS:
        return rows
    chosen = F.col("list_id").isin(names)
    if "part" in rows.columns and "part" in centroids.columns:
        parts = centroids.where(chosen).select("part").distinct().collect()
        rows = rows.where(F.col("part").isin([row["part"] for row in parts]))
    return rows.where(chosen)


def probe_join(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """How many rows each query would score: probe to list sizes, never the pairs themselves."""
    sizes = rows.groupBy("list_id").agg(F.count("*").alias("list_rows"))
    return (
        asked.select("qid", F.explode("cells").alias("list_id"))
        .join(sizes, "list_id")
        .select("qid", "list_id", "list_rows")
    )


def knn_ivf_flat(
    lists: InvertedLists,
    queries: DataFrame,
    k: int,
    *,
    nprobe: int = 32,
    where: str | None = None,
    enough: int | None = None,
    limits: Limits | None = None,
    **options,
) -> DataFrame:
    """Exact scores over the probed lists only.

    ``where`` is a predicate over the attributes filed with the lists. It reaches the scan of the
    lists, and queries open lists until ``enough`` (``k`` unless given) of the rows in them match.
    """
    limits = limits or DEFAULT_LIMITS
    rows = lists.rows
    if where:
        rows = rows.where(where)
        asked, cells = filtered_probes(queries, lists, rows, nprobe, enough or k, limits)
    else:
        asked, cells = probes(queries, lists, nprobe, limits), nprobe
    asked = held_if_small(asked, *vector_stats(queries), limits)
    rows = probed_rows(rows, asked, lists.centroids).select(
        "id", "embedding", F.array(F.col("list_id").cast("long")).alias("cells")
    )
    return nearest(
        rows,
        asked,
        k,
        lists.metric,
        normalize=lists.normalize,
        routing="list",
        cells=cells,
        limits=limits,
        **options,
    )


def knn_tree_rerank(
    gallery: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    lists: InvertedLists | None = None,
    num_leaves_to_search: int | None = None,
    num_neighbors: int = 10,
    reorder_k: int | None = None,
    normalize: bool | None = None,
    where: str | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """Leaves, a wider fetch, exact reorder, first k. Without leaves the scan is exact.

    ``lists`` must be built with the same metric and normalisation. Scores of lists are exact
    already, so the reorder of ``reorder_k`` candidates is their order as found.
    """
    wider = overfetch(overfetch(k, num_neighbors), reorder_k)
    if lists is None:
        rows = gallery.where(where) if where else gallery
        hits = nearest(rows, queries, wider, metric, normalize=normalize, limits=limits)
        return keep_first(hits, k)
    leaves = lists.centroids.count()
    search = min(int(num_leaves_to_search or leaves), leaves)
    hits = knn_ivf_flat(lists, queries, wider, nprobe=search, where=where, limits=limits)
    return keep_first(hits, k)
