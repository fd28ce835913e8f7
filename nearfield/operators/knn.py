"""Top-k nearest neighbours as a DataFrame job.

Every method returns long form ``qid, rank, id, score`` and shares one engine:

* queries fit the broadcast bound: they are sent to the tasks that scan the gallery. The gallery
  is read once, in place, and never shuffled; only k rows per query and task are merged.
* the gallery fits instead: it is sent to the tasks that scan the queries. No shuffle at all.
* neither fits, and every query sees every row: the queries are cut into tiles of bounded size.
  The gallery is scanned in place once per tile, by one task while there are few cores.
* neither fits, and queries look into cells: both sides are cut into tiles and each pair of tiles
  meets in one task through an equi key. Nothing is collected and no group outgrows a task.

Pairs are never emitted: tasks reduce them to the best k. All forms answer query by query, not
id by id: a query id that occurs twice is two queries. Every gallery row is a candidate of its own,
so an id that occurs twice in the gallery may be returned twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.util import inheritable_thread_target

from nearfield.operators.topk import (
    METRICS,
    BestK,
    Cells,
    Vectors,
    first_shared_table,
    smaller_is_better,
    to_matrix,
    without_spare_copies,
)
from nearfield.schema import require_columns, require_positive, vector_stats
from nearfield.session import materialise, short_table

# Every scanning task emits k rows per query. Scans are folded (no shuffle) into so few tasks that
# the merge gets about this many rows, but never into fewer than there are cores.
MERGE_ROWS, MOST_TASKS = 1 << 22, 1 << 20
# Every tile is one more copy of the other side (or one more scan of it). Bounds below the default
# ones cut into so many tiles at most; from there on tiles grow, up to the default bounds.
MOST_TILES = 4
# A scan of the whole gallery answers so many queries at least, whatever the bounds.
LEAST_ASKED = 64
# Tiles that the driver sends at a time at most, when there are several.
SCANS_AT_ONCE = 16
# What a scan without cells sends to every task at most, whatever the bounds. Such a scan moves no rows
# of the side it reads, so a smaller piece costs no more than one further scan.
SCAN_BYTES = 8 << 20
# Hits kept at once by a task that answers its queries one piece after the other.
PIECE_HITS = 1 << 17
# What a query takes besides its vector: per kept hit, and per cell it looks into.
HIT_BYTES, CELL_BYTES = 48, 16


@dataclass(frozen=True)
class Limits:
    """Byte bounds (vectors, ids, cells and kept hits) that decide between the physical forms.

    A task takes about five times a bound: the vectors as sent, as a matrix and as screened, and the
    hits as kept, as new ones and while they are sorted. A worker runs one task per core.
    """

    broadcast_bytes: int = 16 << 20
    query_tile_bytes: int = 16 << 20
    gallery_tile_bytes: int = 16 << 20

    def rows(self, budget: int, dim: int, cells: int = 0, hits: int = 0) -> int:
        each = 4 * max(1, dim) + CELL_BYTES * cells + HIT_BYTES * hits
        return max(1, budget // each)

    def query_rows(self, dim: int, cells: int = 0, hits: int = 0) -> tuple[int, int]:
        """Rows of a tile of queries by the own bound, and by the default one if that is larger."""
        own = self.rows(self.query_tile_bytes, dim, cells, hits)
        return own, max(own, self.rows(Limits.query_tile_bytes, dim, cells, hits))

    def scan_rows(self, budget: int, dim: int, hits: int = 0) -> int:
        """Rows that a scan without cells sends by a bound."""
        return self.rows(min(budget, SCAN_BYTES), dim, 0, hits)

    def gallery_rows(self, dim: int) -> tuple[int, int]:
        own = self.rows(self.gallery_tile_bytes, dim)
        return own, max(own, self.rows(Limits.gallery_tile_bytes, dim))


DEFAULT_LIMITS = Limits()


@dataclass(frozen=True)
class Match:
    """What a task needs to know about the scoring rule."""

    k: int
    metric: str
    normalize: bool
    id_type: pa.DataType
    # None: every query sees every row; "list": rows of the cells a query probes;
    # "hash": rows sharing a bucket in at least one table.
    routing: str | None = None
    # Scores equal to this many decimals count as ties (None: only equal doubles do).
    tie_decimals: int | None = None

    def state(self, queries: Vectors) -> BestK:
        return BestK(queries, self.k, self.metric, self.id_type, self.tie_decimals)

    def vectors(self, table: pa.Table | pa.RecordBatch) -> Vectors:
        return Vectors(to_matrix(table["embedding"]), self.metric, self.normalize)

    def block(self, rows: pa.Table | pa.RecordBatch) -> tuple[Vectors, pa.Table | pa.RecordBatch]:
        """Gallery rows prepared for scoring, without copies that no query can return."""
        block = self.vectors(rows)
        parts = [block.matrix]
        if self.routing:
            parts.append(_cells_matrix(rows["cells"]))
        keep = without_spare_copies(block.fingerprint, parts, _whole(rows["id"]), self.k)
        if keep is None:
            return block, rows
        rows = rows.take(pa.array(keep))
        return self.vectors(rows), rows


def check_metric(metric: str) -> str:
    metric = str(metric).lower()
    if metric not in METRICS:
        raise ValueError("metric must be 'l2', 'ip', or 'cosine'")
    return metric


def tiles_of(rows: int, own: int, full: int) -> int:
    """Tiles of so many rows: of ``own`` rows up to ``MOST_TILES``, else larger, to ``full`` rows."""
    return max(1, min(-(-rows // own), max(MOST_TILES, -(-rows // full))))


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _cells_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = _whole(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Route:
    """The query side of a routing rule, prepared once per task or batch."""

    def __init__(self, match: Match, queries: pa.Table | pa.RecordBatch):
        self.rule = match.routing
        if self.rule == "list":
            self.cells = Cells.of_lists(queries["cells"])
        elif self.rule == "hash":
            self.buckets = _cells_matrix(queries["cells"])
            self.tables = Cells.of_tables(self.buckets)

    def offer(self, state: BestK, block: Vectors, rows: pa.RecordBatch | pa.Table) -> None:
        """Gallery rows as ``Match.block`` prepares them."""
        ids = _whole(rows["id"])
        if self.rule is None:
            state.offer(block, ids)
        elif self.rule == "list":
            state.offer_cells(block, ids, self.cells, Cells.of_lists(rows["cells"]))
        else:
            theirs = _cells_matrix(rows["cells"])
            for table, cells in enumerate(Cells.of_tables(theirs)):
                keep = first_shared_table(self.buckets, theirs, table)
                state.offer_cells(block, ids, self.tables[table], cells, keep)


def _empty(batch: pa.RecordBatch | pa.Table) -> bool:
    return batch.num_rows == 0


def pieces(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """A batch of queries cut so that a piece keeps a bounded number of hits."""
    step = max(64, PIECE_HITS // k)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _columns(df: DataFrame, key: str, match: Match) -> list[str]:
    return [key, "embedding"] + (["cells"] if match.routing else [])


def _hits_schema(queries: DataFrame, gallery: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("id", gallery.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


HIT_NAMES = ("qid", "rank", "id", "score")


def partial_schema(out: T.StructType) -> T.StructType:
    """Hits of one task: also the number of the query, which tells equal ids apart."""
    return T.StructType([*out.fields, T.StructField("asked", T.LongType())])


def partial_hits(state: BestK, table: pa.Table | pa.RecordBatch) -> pa.Table:
    return state.result({"qid": _whole(table["qid"]), "asked": _whole(table["asked"])}).select(
        [*HIT_NAMES, "asked"]
    )


def numbered(table: pa.Table) -> pa.Table:
    """Queries with their place as ``asked``."""
    return table.append_column("asked", pa.array(np.arange(table.num_rows, dtype=np.int64)))


def scan_tasks(df: DataFrame, asked: int, k: int) -> int:
    """Tasks that scan a gallery for so many queries."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(MOST_TASKS, MERGE_ROWS // max(1, asked * k)))


def merge_hits(partial: DataFrame, k: int, metric: str, by: str = "qid") -> DataFrame:
    """Best k per query over partial lists; equal scores go to the smaller id."""
    score = F.col("score").asc() if smaller_is_better(metric) else F.col("score").desc()
    order = Window.partitionBy(by).orderBy(score, F.col("id").asc())
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= int(k))
        .select(*HIT_NAMES)
    )


def _scan_gallery(
    gallery: DataFrame, queries: DataFrame, match: Match, out, tasks: int | None = None
) -> DataFrame:
    """Queries broadcast (their size is already checked), gallery scanned in place."""
    table = numbered(queries.toArrow())
    tasks = tasks or scan_tasks(gallery, table.num_rows, match.k)
    shared = queries.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if _empty(table):
            return
        state = match.state(match.vectors(table))
        route = _Route(match, table)
        for batch in batches:
            if not _empty(batch):
                route.offer(state, *match.block(batch))
        yield from partial_hits(state, table).to_batches()

    partial = gallery.coalesce(tasks).mapInArrow(scan, partial_schema(out))
    if tasks == 1:
        return partial.select(*HIT_NAMES)  # one task saw all rows: ranks are final
    return merge_hits(partial, match.k, match.metric, "asked")


def _scan_queries(gallery: DataFrame, queries: DataFrame, match: Match, out) -> DataFrame:
    """Gallery broadcast (size checked), queries scanned in place; ranks are final."""
    shared = queries.sparkSession.sparkContext.broadcast(gallery.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value.combine_chunks()
        if _empty(rows):
            return
        block, rows = match.block(rows)  # once per task, however many batches follow
        for batch in batches:
            for part in pieces(batch, match.k):
                state = match.state(match.vectors(part))
                _Route(match, part).offer(state, block, rows)
                yield from state.result({"qid": part["qid"]}).select(list(HIT_NAMES)).to_batches()

    return queries.mapInArrow(scan, out)


def with_tiles(
    gallery: DataFrame, queries: DataFrame, dim: int, limits: Limits, hits: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides (``cell``; queries also ``asked``) placed and copied so that their tiles meet.

    How many tiles a cell is cut into comes from its counts (see ``tiles_of``); queries count with
    room for their hits. That table has one row per cell; it is written once and counted, so the
    broadcast below rests on a checked size. A join on the cell itself would send a crowded cell to
    a single task.
    """

    def counts(df: DataFrame, name: str, own: int, full: int) -> DataFrame:
        few = F.greatest(F.lit(MOST_TILES), F.ceil(F.count("*") / F.lit(full)))
        tiles = F.least(F.ceil(F.count("*") / F.lit(own)), few)
        return df.groupBy("cell").agg(tiles.cast("int").alias(name))

    tiles = short_table(
        counts(gallery, "n_gt", *limits.gallery_rows(dim)).join(
            counts(queries, "n_qt", *limits.query_rows(dim, 1, hits)), "cell"
        )
    )
    return (
        place(gallery.join(tiles, "cell"), gallery.columns, "gt", "qt"),
        place(queries.join(tiles, "cell"), ["asked"], "qt", "gt"),
    )


def place(df: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """One tile of its own side for each row, and a copy for every tile of the other side.

    Whole gallery rows are hashed, and the numbers of queries: that spreads even a cell or an id
    that holds most of the table.
    """
    return (
        df.withColumn(own, F.pmod(F.xxhash64(*keys), F.col(f"n_{own}")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        .drop(f"n_{own}", f"n_{other}")
    )


TILE_KEYS = ("cell", "gt", "qt")


def cogrouped_tiles(left: DataFrame, right: DataFrame):
    """Pairs of tiles. The left columns get fresh names: both sides may be the same table."""
    left = left.select(*[F.col(name).alias(f"g_{name}") for name in left.columns])
    keys = [f"g_{name}" for name in TILE_KEYS]
    return left.groupBy(*keys).cogroup(right.groupBy(*TILE_KEYS))


def _scan_by_tile(
    gallery: DataFrame, queries: DataFrame, match: Match, out, asked: int, dim: int, limits: Limits
) -> DataFrame:
    """Both sides large, no cells: one scan of the gallery, where it lies, per tile of queries.

    As many tiles are answered at a time as there are cores (``SCANS_AT_ONCE`` at most), each by one
    task that reads the whole gallery: its ranks are final, and a row that cannot stay is soon found
    out. With more cores a scan is cut into a few tasks. A tile's answers are written before the next
    tile is sent in its place, so a lost executor costs the scans under way at most.
    """
    own = limits.scan_rows(limits.query_tile_bytes, dim, match.k)
    full = limits.scan_rows(SCAN_BYTES, dim, match.k)
    tiles = tiles_of(asked, max(LEAST_ASKED, own), max(LEAST_ASKED, full))
    cores = gallery.sparkSession.sparkContext.defaultParallelism
    tasks = -(-cores // SCANS_AT_ONCE)
    at_once = -(-cores // tasks)
    if tiles > 1:
        tiles = -(-tiles // at_once) * at_once
    # Written once and by tile, as the numbers must be the same wherever they are read.
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tiles)).cast("int")
    held = materialise(queries.withColumn("tile", number))
    if tiles == 1:
        return materialise(_scan_gallery(gallery, held.drop("tile"), match, out))
    # Every tile scans the gallery, which may be derived (encoded texts, a join): computed once, and
    # in even parts.
    rows = materialise(gallery.repartition(cores))

    def answer(tile: int) -> DataFrame:
        own = held.where(F.col("tile") == tile).drop("tile")
        found = _scan_gallery(rows, own, match, out, tasks)
        # Tables of one partition each would be united to a table of one partition.
        return materialise(found.repartition(cores) if tasks == 1 else found)

    with ThreadPoolExecutor(at_once) as pool:
        threads = inheritable_thread_target(gallery.sparkSession)
        answers = list(pool.map(threads(answer), range(tiles)))
    return reduce(DataFrame.unionAll, answers)


def _tile_pairs(
    gallery: DataFrame, queries: DataFrame, match: Match, out, dim: int, limits: Limits
) -> DataFrame:
    """Both sides large: tiles meet through (cell, gallery tile, query tile)."""
    # Written once, as the numbers must be the same wherever they are read.
    queries = materialise(queries.withColumn("asked", F.monotonically_increasing_id()))
    left, right = with_tiles(
        gallery.withColumn("cell", F.explode("cells")),
        queries.withColumn("cell", F.explode("cells")),
        dim,
        limits,
        match.k,
    )
    # Inside a group the cell is fixed; only the hash rule must look at the other tables.
    aligned = match.routing == "hash"

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if _empty(rows) or _empty(asked):
            return pa.schema(
                [
                    ("qid", asked.schema.field("qid").type),
                    ("rank", pa.int32()),
                    ("id", match.id_type),
                    ("score", pa.float64()),
                    ("asked", pa.int64()),
                ]
            ).empty_table()
        rows = rows.rename_columns([name.removeprefix("g_") for name in rows.column_names])
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        state = match.state(match.vectors(asked))
        block, rows = match.block(rows)
        keep = None
        if aligned:
            mine, theirs = _cells_matrix(asked["cells"]), _cells_matrix(rows["cells"])
            here = int(np.argmax(mine[0] == asked["cell"][0].as_py()))
            keep = first_shared_table(mine, theirs, here)
        state.offer(block, _whole(rows["id"]), keep_pair=keep)
        return partial_hits(state, asked)

    partial = cogrouped_tiles(left, right).applyInArrow(meet, partial_schema(out))
    return merge_hits(partial, match.k, match.metric, "asked")


def nearest(
    gallery: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    normalize: bool | None = None,
    routing: str | None = None,
    cells: int = 0,
    tie_decimals: int | None = None,
    limits: Limits | None = None,
) -> DataFrame:
    """Best ``k`` gallery rows per query among the candidates that ``routing`` allows.

    ``gallery`` holds ``id, embedding`` and ``queries`` ``qid, embedding``; with routing both
    also hold ``cells`` (ARRAY<BIGINT>), at most ``cells`` of them per query. Fewer than k candidates
    give fewer hits.
    """
    require_positive(top_k=k)
    metric = check_metric(metric)
    require_columns(gallery, "id", "embedding")
    require_columns(queries, "qid", "embedding")
    limits = limits or DEFAULT_LIMITS
    match = Match(
        k=int(k),
        metric=metric,
        normalize=metric == "cosine" if normalize is None else bool(normalize),
        id_type=to_arrow_type(gallery.schema["id"].dataType),
        routing=routing,
        tie_decimals=tie_decimals,
    )
    gallery = gallery.select(*_columns(gallery, "id", match))
    queries = queries.select(*_columns(queries, "qid", match))
    out = _hits_schema(queries, gallery)

    asked, dim = vector_stats(queries)
    if routing:
        fits = limits.rows(limits.broadcast_bytes, dim, cells, match.k)
        fitting = limits.rows(limits.broadcast_bytes, dim, 1)
    else:
        fits = limits.scan_rows(limits.broadcast_bytes, dim, match.k)
        fitting = limits.scan_rows(limits.broadcast_bytes, dim)
    if asked <= fits:
        return _scan_gallery(gallery, queries, match, out)
    # Counting stops one row above the bound, so a huge gallery is not scanned for it.
    if gallery.select("id").limit(fitting + 1).count() <= fitting:
        return _scan_queries(gallery, queries, match, out)
    if routing is None:
        return _scan_by_tile(gallery, queries, match, out, asked, dim, limits)
    return _tile_pairs(gallery, queries, match, out, dim, limits)


def knn_flat(gallery: DataFrame, queries: DataFrame, k: int, metric: str = "l2", **options):
    """Exact search over the whole gallery."""
    return nearest(gallery, queries, k, metric, **options)


def knn_bruteforce(
    gallery: DataFrame, queries: DataFrame, k: int, metrics: list[str] | None = None, **options
) -> dict[str, DataFrame]:
    """Exact baseline, one run per distinct metric."""
    wanted = list(dict.fromkeys(check_metric(m) for m in (metrics or ["l2"])))
    return {metric: nearest(gallery, queries, k, metric, **options) for metric in wanted}


def with_nearest(
    df: DataFrame,
    key: str,
    centroids: DataFrame,
    n: int,
    metric: str,
    *,
    normalize: bool | None = None,
    within: bool = False,
    limits: Limits | None = None,
) -> DataFrame:
    """Append ``cells``: the ``n`` best centroids of each row, best first.

    ``centroids`` holds ``list_id BIGINT, embedding``. While they fit the broadcast bound this is
    one narrow pass; a larger set meets the rows tile by tile and is joined back on a row number.
    ``within``: rows come with ``cells`` already, and only centroids whose ``top_id`` is among
    them are compared; the new cells take the place of the old.
    """
    require_positive(n=n)
    metric = check_metric(metric)
    limits = limits or DEFAULT_LIMITS
    above = F.col("top_id").cast("long") if within else F.lit(0).cast("long")
    lists = centroids.select(
        F.col("list_id").cast("long").alias("id"), "embedding", F.array(above).alias("cells")
    )
    count, dim = vector_stats(lists)
    match = Match(
        k=min(int(n), max(count, 1)),
        metric=metric,
        normalize=metric == "cosine" if normalize is None else bool(normalize),
        id_type=pa.int64(),
        routing="list" if within else None,
    )
    if count > limits.rows(limits.broadcast_bytes, dim):
        # The key of the rows need not be unique: a number of their own joins the answers back.
        own = "_row"
        df = materialise(df.withColumn(own, F.monotonically_increasing_id()))
        cells = F.col("cells") if within else F.array(F.lit(0).cast("long"))
        rows = df.select(F.col(own).alias("qid"), "embedding", cells.alias("cells"))
        rule = Match(match.k, metric, match.normalize, match.id_type, "list")
        out = _hits_schema(rows, lists)
        found = _tile_pairs(lists, rows, rule, out, dim, limits)
        cells = found.groupBy("qid").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]
            ).alias("cells")
        )
        return df.drop("cells").join(cells.withColumnRenamed("qid", own), own).drop(own)

    shared = df.sparkSession.sparkContext.broadcast(lists.toArrow())
    kept = [name for name in df.columns if name != "cells"] if within else df.columns
    out = T.StructType(
        [*[df.schema[name] for name in kept], T.StructField("cells", T.ArrayType(T.LongType()))]
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value.combine_chunks()
        block = match.vectors(rows)
        for batch in batches:
            if _empty(batch):
                continue
            state = match.state(match.vectors(batch))
            _Route(match, batch).offer(state, block, rows)
            state.flush()
            sizes = np.bincount(state.kept["q"].to_numpy(), minlength=batch.num_rows)
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            cells = pa.ListArray.from_arrays(
                pa.array(offsets), state.kept["id"].combine_chunks()
            )
            yield batch.select(kept).append_column("cells", cells)

    return df.mapInArrow(route, out)


def held_if_small(df: DataFrame, rows: int, dim: int, limits: Limits) -> DataFrame:
    """A small derived query set is computed once and reused; a large one stays lazy."""
    if rows > limits.rows(limits.broadcast_bytes, dim):
        return df
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def overfetch(k: int, wider: int | None) -> int:
    """How many neighbours to fetch before the first k are kept."""
    return max(int(k), int(wider or 0))


def keep_first(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= int(k))
