"""Product quantisation on top of inverted lists.

Rows are stored as one code per subvector of their residual (row minus list centroid). A query
turns into a small table of partial scores per probed list, and a row's score is the sum of the
entries its codes name. Scores are approximate; ``rerank_k`` rescores candidates exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.operators.ivf import (
    InvertedLists,
    filtered_probes,
    first_by_digest,
    group_means,
    probed_rows,
    probes,
    write_by_list,
)
from nearfield.operators.knn import (
    CELL_BYTES,
    DEFAULT_LIMITS,
    HIT_NAMES,
    Limits,
    cogrouped_tiles,
    held_if_small,
    keep_first,
    merge_hits,
    numbered,
    overfetch,
    partial_hits,
    partial_schema,
    pieces,
    scan_tasks,
    with_tiles,
)
from nearfield.operators.rerank import rerank_exact
from nearfield.operators.topk import (
    SCREEN_BYTES,
    BestK,
    Cells,
    Vectors,
    to_matrix,
    without_spare_copies,
)
from nearfield.schema import VECTOR, require_positive, vector_stats
from nearfield.session import materialise

# What the id of a coded row takes about.
CODED_ID_BYTES = 16

CODEBOOKS = T.StructType(
    [
        T.StructField("subspace", T.IntegerType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("embedding", VECTOR),
    ]
)


@dataclass(frozen=True)
class PqSettings:
    m: int = 8
    nbits: int = 8

    def __post_init__(self) -> None:
        require_positive(m=self.m, nbits=self.nbits)
        if self.nbits > 16:
            raise ValueError("nbits must be at most 16")

    @property
    def code_type(self) -> type:
        return np.uint8 if self.nbits <= 8 else np.uint16

    def width(self, dim: int) -> int:
        if dim % self.m:
            raise ValueError(f"Vector dimension {dim} must be a multiple of m={self.m}")
        return dim // self.m


@dataclass(frozen=True)
class PqIndex:
    lists: InvertedLists
    codes: DataFrame  # id, list_id, codes BINARY
    codebooks: DataFrame
    settings: PqSettings

    def save(self, path: str, files: int | None = None, parts: int | None = None) -> None:
        """Codes next to the saved lists, whose vectors serve the exact rescoring."""
        self.lists.save(path, files, parts)
        self.codebooks.write.mode("overwrite").parquet(f"{path}/codebooks")
        write_by_list(self.lists.centroids, self.codes, path, "codes", files, parts)

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        path: str,
        metric: str,
        settings: PqSettings,
        normalize: bool | None = None,
    ) -> PqIndex:
        return cls(
            InvertedLists.load(spark, path, metric, normalize),
            spark.read.parquet(f"{path}/codes"),
            spark.read.parquet(f"{path}/codebooks"),
            settings,
        )


def unit_rows(matrix: np.ndarray, unit: bool) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    if not unit:
        return matrix
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0.0, 1.0, norms)


class _Books:
    """Codebooks as arrays, and the arithmetic on them."""

    def __init__(self, codebooks: pa.Table, m: int):
        self.m = m
        sub = codebooks["subspace"].to_numpy()
        code = codebooks["code"].to_numpy()
        values = to_matrix(codebooks["embedding"]).astype(np.float64)
        self.codes = int(code.max()) + 1 if len(code) else 0
        # Unused codes stay at infinity and are never the nearest one.
        self.book = np.full((m, self.codes, values.shape[1]), np.inf)
        self.book[sub, code] = values

    def encode(self, residual: np.ndarray) -> np.ndarray:
        out = np.empty((len(residual), self.m), dtype=np.int64)
        for s, part in enumerate(np.split(residual, self.m, axis=1)):
            used = np.isfinite(self.book[s]).all(axis=1)
            book = self.book[s][used]
            gap = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None, :]
            out[:, s] = np.flatnonzero(used)[np.argmin(gap, axis=1)]
        return out

    def tables(self, parts: np.ndarray) -> list[np.ndarray]:
        """Partial dot products, one (asked, code) table per subspace."""
        book = np.where(np.isfinite(self.book), self.book, 0.0)
        return [part @ book[s].T for s, part in enumerate(np.split(parts, self.m, axis=1))]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.hstack([self.book[s][codes[:, s]] for s in range(self.m)])


class _Asked:
    """Some asked vectors against the coded rows of one list."""

    def __init__(self, books: _Books, asked: np.ndarray, center: np.ndarray, metric: str):
        self.books, self.metric, self.center = books, metric, center
        self.parts = asked if metric != "l2" else asked - center
        self.tables = books.tables(self.parts)
        if metric == "l2":
            book = np.where(np.isfinite(books.book), books.book, 0.0)
            for s, part in enumerate(np.split(self.parts, books.m, axis=1)):
                table = -2.0 * self.tables[s] + (book[s] ** 2).sum(axis=1)
                self.tables[s] = table + (part**2).sum(axis=1)[:, None]
            self.base = None
        else:
            self.tables = [-table for table in self.tables]
            self.base = asked @ center
        self.norms = np.sqrt((self.parts**2).sum(axis=1))

    def keys(self, qi: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Sort keys (smaller is better) of single pairs: asked vector ``qi[i]`` and ``codes[i]``."""
        keys = np.zeros(len(qi))
        for s, table in enumerate(self.tables):
            keys += table[qi, codes[:, s]]
        return np.maximum(keys, 0.0) if self.base is None else keys - self.base[qi]

    def screen(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pairs by a matrix product, and a bound on their error for each asked vector."""
        rows = self.books.decode(codes)
        if self.metric != "l2":
            rows = rows + self.center
        squared = (rows**2).sum(axis=1)
        top = np.sqrt(squared.max(initial=0.0))
        wide = max(top, self.norms.max(initial=0.0)) > 1e18
        kind = np.float64 if wide else np.float32
        keys = self.parts.astype(kind) @ rows.astype(kind).T
        size = self.norms * top
        if self.metric == "l2":
            keys *= -2
            keys += (self.norms**2).astype(kind)[:, None]
            keys += squared.astype(kind)[None, :]
            size = (self.norms + top) ** 2
        else:
            np.negative(keys, out=keys)
            size = size + self.norms * np.sqrt((self.center**2).sum())
        dim = self.parts.shape[1]
        return keys, 4.0 * (dim + 16) * 2.0**-24 * size + dim * 1e-44


def _with_centers(rows: DataFrame, lists: InvertedLists, limits: Limits, key: str = "list_id"):
    """Rows with the ``center`` of their list; few centroids are broadcast, many are joined."""
    centers = lists.centroids.select(
        F.col("list_id").cast("long").alias(key), F.col("embedding").alias("center")
    )
    if _fits(lists, limits):
        centers = F.broadcast(centers)
    return rows.withColumn(key, F.col(key).cast("long")).join(centers, key)


def _fits(lists: InvertedLists, limits: Limits) -> bool:
    count, dim = vector_stats(lists.centroids)
    return count <= limits.rows(limits.broadcast_bytes, dim)


def _residuals(lists: InvertedLists, unit: bool, limits: Limits) -> DataFrame:
    """``id, list_id, embedding`` and attributes: every row minus the centroid of its list."""
    more = lists.attributes

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = unit_rows(to_matrix(batch["embedding"]), unit) - to_matrix(batch["center"])
            flat = pa.array(rest.astype(np.float32).reshape(-1))
            vectors = pa.FixedSizeListArray.from_arrays(flat, rest.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    batch["list_id"],
                    vectors.cast(pa.list_(pa.float32())),
                    *[batch[c] for c in more],
                ],
                names=["id", "list_id", "embedding", *more],
            )

    out = T.StructType(
        [
            lists.rows.schema["id"],
            T.StructField("list_id", T.LongType()),
            T.StructField("embedding", VECTOR),
            *[lists.rows.schema[c] for c in more],
        ]
    )
    rows = _with_centers(lists.rows.select("id", "list_id", "embedding", *more), lists, limits)
    return rows.select("id", "list_id", "embedding", "center", *more).mapInArrow(subtract, out)


def train_codebooks(
    lists: InvertedLists,
    settings: PqSettings,
    *,
    seed: int = 42,
    max_iter: int = 10,
    limits: Limits | None = None,
) -> DataFrame:
    """``subspace, code, embedding``: Lloyd's steps over the residuals of all rows.

    Tasks code the rows they read and add them up by subspace and code. Codebooks have at most
    ``2**nbits`` vectors per subspace whatever the number of rows, so they travel to every task.
    """
    _, dim = vector_stats(lists.centroids)
    width = settings.width(dim)
    # Written once: every step reads them, and no task runs the filing beside the coding.
    residuals = materialise(
        _residuals(lists, _unit(lists), limits or DEFAULT_LIMITS).select("id", "embedding")
    )
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(settings.m - 1)),
        lambda s: F.slice("embedding", s * width + 1, width),
    )
    start = first_by_digest(residuals, 1 << settings.nbits, seed).select(
        F.col("place").cast("int").alias("code"), F.posexplode(parts).alias("subspace", "embedding")
    )
    # Equal vectors would be equal codes: the first of them stands for all.
    books = materialise(
        start.groupBy("subspace", "embedding")
        .agg(F.min("code").alias("code"))
        .select("subspace", "code", "embedding")
    )
    for _ in range(max_iter):
        means = group_means(_coded_parts(residuals, books, settings), "slot")
        named = means.select(
            F.floor(F.col("slot") / (1 << settings.nbits)).cast("int").alias("subspace"),
            (F.col("slot") % (1 << settings.nbits)).cast("int").alias("code"),
            "embedding",
        )
        moved = materialise(
            books.withColumnRenamed("embedding", "old")
            .join(named, ["subspace", "code"], "left")
            .select("subspace", "code", F.coalesce("embedding", "old").alias("embedding"), "old")
        )
        books = moved.drop("old")
        if moved.where("embedding != old").isEmpty():
            break
    return books


def _coded_parts(residuals: DataFrame, books: DataFrame, settings: PqSettings) -> DataFrame:
    """``slot, embedding``: every subvector under the number of its subspace and nearest code."""
    shared = residuals.sparkSession.sparkContext.broadcast(books.toArrow())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Books(shared.value, settings.m)
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = to_matrix(batch["embedding"])
            slots = tables.encode(matrix.astype(np.float64))
            slots += np.arange(settings.m) << settings.nbits
            width = matrix.shape[1] // settings.m
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(matrix.reshape(-1)), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots.reshape(-1)), vectors.cast(pa.list_(pa.float32()))],
                names=["slot", "embedding"],
            )

    out = T.StructType([T.StructField("slot", T.LongType()), T.StructField("embedding", VECTOR)])
    return residuals.select("embedding").mapInArrow(code, out)


def _unit(lists: InvertedLists) -> bool:
    return lists.metric == "cosine" if lists.normalize is None else bool(lists.normalize)


def build_codes(
    lists: InvertedLists,
    codebooks: DataFrame,
    settings: PqSettings,
    limits: Limits | None = None,
) -> PqIndex:
    """Encode every row in one narrow pass, written once; attributes of the lists go along."""
    limits = limits or DEFAULT_LIMITS
    more = lists.attributes
    books = lists.rows.sparkSession.sparkContext.broadcast(codebooks.toArrow())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Books(books.value, settings.m)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = tables.encode(to_matrix(batch["embedding"]).astype(np.float64))
            packed = codes.astype(settings.code_type)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    batch["list_id"],
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                    *[batch[c] for c in more],
                ],
                names=["id", "list_id", "codes", *more],
            )

    out = T.StructType(
        [
            lists.rows.schema["id"],
            T.StructField("list_id", T.LongType()),
            T.StructField("codes", T.BinaryType()),
            *[lists.rows.schema[c] for c in more],
        ]
    )
    residuals = _residuals(lists, _unit(lists), limits)
    return PqIndex(lists, materialise(residuals.mapInArrow(encode, out)), codebooks, settings)


def knn_ivf_pq(
    index: PqIndex,
    queries: DataFrame,
    k: int,
    *,
    nprobe: int = 32,
    rerank_k: int | None = None,
    where: str | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """Approximate scores from codes; with ``rerank_k`` the candidates are rescored exactly.

    ``where`` is a predicate over the attributes filed with the lists; see ``knn_ivf_flat``.
    """
    require_positive(top_k=k)
    limits = limits or DEFAULT_LIMITS
    lists, settings = index.lists, index.settings
    wider = overfetch(k, rerank_k)
    count, dim = vector_stats(queries)
    coded = index.codes
    if where:
        coded = coded.where(where)
        asked, cells = filtered_probes(queries, lists, coded, nprobe, wider, limits)
    else:
        asked, cells = probes(queries, lists, nprobe, limits), nprobe
    asked = held_if_small(asked, count, dim, limits)
    session = queries.sparkSession.sparkContext
    books = session.broadcast(index.codebooks.toArrow())
    unit, metric = _unit(lists), lists.metric
    id_type = to_arrow_type(index.codes.schema["id"].dataType)
    out = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("id", index.codes.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def unpack(column: pa.Array) -> np.ndarray:
        raw = b"".join(column.to_pylist())
        return np.frombuffer(raw, settings.code_type).reshape(len(column), settings.m)

    def offer(state, tables, vectors, picked, center, found, codes, ids) -> None:
        # Equal codes in a list score the same: only the smallest ids of a crowd can be returned.
        stamp = (codes[found].astype(np.int64) * np.arange(1, settings.m + 1)).sum(axis=1)
        kept = without_spare_copies(stamp, [codes[found]], ids.take(pa.array(found)), wider)
        found = found if kept is None else found[kept]
        # Tiles keep the score block within bounds when a list is long or probed by many.
        for asks in np.array_split(picked, -(-len(picked) // 2048)):
            own = _Asked(tables, vectors[asks], center, metric)
            step = max(256, SCREEN_BYTES // (4 * len(asks)))
            for start in range(0, len(found), step):
                part = found[start : start + step]
                near, slack = own.screen(codes[part])
                bound = state.reach[asks] + slack
                open_ended = np.isinf(bound)
                if len(part) > wider and open_ended.any():
                    kth = np.partition(near[open_ended], wider - 1, axis=1)[:, wider - 1]
                    bound[open_ended] = kth + 2 * slack[open_ended]
                # Compared in the block's own type, rounded so that no candidate is lost.
                reach = np.nextafter(bound.astype(near.dtype), np.inf, dtype=near.dtype)
                at = np.flatnonzero(near <= reach[:, None])
                if len(at):
                    at_q, at_g = at // len(part), part[at % len(part)]
                    state.add(asks[at_q], own.keys(at_q, codes[at_g]), at_g, ids)

    def prepared(table: pa.Table):
        matrix = to_matrix(table["embedding"])
        tables = _Books(books.value, settings.m)
        state = BestK(Vectors(matrix, metric, False), wider, metric, id_type)
        return tables, unit_rows(matrix, unit), state

    def offer_lists(state, tables, vectors, asked_cells, places, centers, rows) -> None:
        codes, at = unpack(rows["codes"]), rows["list_id"].to_numpy()
        for list_id in np.unique(at):
            picked = asked_cells.of_key(list_id)
            if len(picked):
                found = np.flatnonzero(at == list_id)
                center = centers[places[int(list_id)]]
                offer(state, tables, vectors, picked, center, found, codes, rows["id"])

    # Counting stops one row above the bound. Codes are held once, not several times like vectors.
    coded_bytes = settings.m * np.dtype(settings.code_type).itemsize + CELL_BYTES + CODED_ID_BYTES
    fitting = max(1, 4 * limits.broadcast_bytes // coded_bytes)
    if _fits(lists, limits) and count <= limits.rows(limits.broadcast_bytes, dim, cells, wider):
        table = numbered(asked.select("qid", "embedding", "cells").toArrow())
        tasks = scan_tasks(coded, table.num_rows, wider)
        shared = session.broadcast((table, lists.centroids.toArrow()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, centroids = shared.value
            if not table.num_rows:
                return
            tables, vectors, state = prepared(table)
            cells = Cells.of_lists(table["cells"])
            places = {key: at for at, key in enumerate(centroids["list_id"].to_pylist())}
            centers = to_matrix(centroids["embedding"]).astype(np.float64)
            for batch in batches:
                if batch.num_rows:
                    offer_lists(state, tables, vectors, cells, places, centers, batch)
            yield from partial_hits(state, table).to_batches()

        partial = (
            probed_rows(coded, asked, lists.centroids)
            .select("id", "list_id", "codes")
            .coalesce(tasks)
            .mapInArrow(scan, partial_schema(out))
        )
        hits = merge_hits(partial, wider, metric, "asked")
    elif _fits(lists, limits) and coded.select("id").limit(fitting + 1).count() <= fitting:
        rows = coded.select("id", "list_id", "codes").toArrow().combine_chunks()
        shared = session.broadcast((rows, lists.centroids.toArrow()))

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, centroids = shared.value
            if not rows.num_rows:
                return
            rows = rows.combine_chunks().to_batches()[0]
            places = {key: at for at, key in enumerate(centroids["list_id"].to_pylist())}
            centers = to_matrix(centroids["embedding"]).astype(np.float64)
            for batch in batches:
                for part in pieces(batch, wider):
                    tables, vectors, state = prepared(part)
                    cells = Cells.of_lists(part["cells"])
                    offer_lists(state, tables, vectors, cells, places, centers, rows)
                    yield from state.result({"qid": part["qid"]}).select(list(HIT_NAMES)).to_batches()

        # Ranks are final in the task: no row is shuffled.
        hits = asked.select("qid", "embedding", "cells").mapInArrow(answer, out)
    else:
        rows = coded.select("id", "codes", F.col("list_id").alias("cell"))
        own = materialise(asked.withColumn("asked", F.monotonically_increasing_id()))
        own = own.select("qid", "asked", "embedding", F.explode("cells").alias("cell"))
        left, right = with_tiles(rows, _with_centers(own, lists, limits, "cell"), dim, limits, wider)

        def meet(coded: pa.Table, table: pa.Table) -> pa.Table:
            tables, vectors, state = prepared(table)
            if coded.num_rows and table.num_rows:
                offer(
                    state,
                    tables,
                    vectors,
                    np.arange(table.num_rows),
                    to_matrix(table["center"].slice(0, 1))[0].astype(np.float64),
                    np.arange(coded.num_rows),
                    unpack(coded["g_codes"].combine_chunks()),
                    coded["g_id"].combine_chunks(),
                )
            return partial_hits(state, table)

        partial = cogrouped_tiles(left, right).applyInArrow(meet, partial_schema(out))
        hits = merge_hits(partial, wider, metric, "asked")
    if rerank_k:
        gallery = lists.rows.select("id", "embedding")
        hits = rerank_exact(hits, gallery, queries, wider, metric, normalize=lists.normalize)
    return keep_first(hits, k)
