"""Exact top-k selection inside one task.

A task sees vectors as Arrow batches. Scores are screened with a float32 matrix product, and
only pairs that can still enter a query's best k (given a bound on the float32 error) are scored
again in double precision, adding dimensions in index order. The kept scores are therefore the
same whatever the batch or partition layout, and equal scores go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

METRICS = ("l2", "ip", "cosine")
SCREEN_BYTES = 8 << 20
PAIR_BYTES = 4 << 20
BLOCK_PAIRS = 512
# Pairs and rows of a screening block at most, rows of one of its products, and rows of a run, of which
# only the best score is compared at first.
SCREEN_PAIRS, SCREEN_ROWS, SCREEN_STRIP, SCREEN_RUN = 1 << 21, 1 << 13, 1 << 10, 1 << 8


def smaller_is_better(metric: str) -> bool:
    return metric == "l2"


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column -> (n, dim) float32; ragged or null vectors are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.empty((0, 0), dtype=np.float32)
    if column.null_count:
        raise ValueError("Embedding column holds null vectors")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("Embedding column holds vectors with null elements")
    width, rest = divmod(len(flat), rows)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if rest or (lengths != width).any():
        raise ValueError("Expected vectors of one dimension")
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(rows, width)


class Vectors:
    """A block of vectors with what the metric needs prepared once."""

    def __init__(self, matrix: np.ndarray, metric: str, normalize: bool):
        self.rows, self.dim = matrix.shape
        self.matrix = matrix
        # A part of the rows at a time: the doubles of a whole block would take twice its room.
        step = max(1, PAIR_BYTES // (8 * max(1, self.dim)))
        parts = [slice(start, start + step) for start in range(0, self.rows, step)]
        self.squared = np.empty(self.rows)
        for part in parts:
            self.squared[part] = np.square(matrix[part], dtype=np.float64).sum(axis=1)
        self.fingerprint = self.squared
        norms = np.sqrt(self.squared)
        self.scale = None
        if normalize:
            self.scale = np.where(norms == 0.0, 1.0, norms)
            self.screen = np.empty(matrix.shape, dtype=np.float32)
            for part in parts:
                self.screen[part] = matrix[part] / self.scale[part, None]
            self.squared = np.where(norms == 0.0, 0.0, 1.0)
            norms = self.squared
        else:
            wide = norms.size and norms.max() > 1e18
            self.screen = np.ascontiguousarray(matrix, dtype=np.float64 if wide else np.float32)
        self.norms = norms

    def take(self, rows: np.ndarray) -> np.ndarray:
        block = self.matrix[rows].astype(np.float64)
        if self.scale is not None:
            block /= self.scale[rows, None]
        return block


def _strips(rows: np.ndarray) -> np.ndarray:
    """Rows of a block (vectors or numbers) in strips of one length, zeros behind the last row."""
    strip = min(len(rows), SCREEN_STRIP)
    if strip > SCREEN_RUN:
        strip = -(-strip // SCREEN_RUN) * SCREEN_RUN
    strips = -(-len(rows) // strip)
    if len(rows) < strips * strip:
        rows = np.concatenate([rows, np.zeros((strips * strip - len(rows), *rows.shape[1:]), rows.dtype)])
    return rows.reshape(strips, strip, *rows.shape[1:])


def without_spare_copies(
    fingerprint: np.ndarray, parts: list[np.ndarray], ids: pa.Array, k: int
) -> np.ndarray | None:
    """Rows worth scoring when some are exact copies; None when all of them are.

    Copies (equal in all ``parts``) score the same against any query, and ties go to the smaller
    id, so beyond the k smallest ids of a group no copy can be among the best k. The fingerprint
    is equal for copies; only rows whose fingerprint occurs more than k times are compared.
    """
    _, seen, counts = np.unique(fingerprint, return_inverse=True, return_counts=True)
    crowded = np.flatnonzero(counts[seen] > k)
    if not len(crowded):
        return None
    raw = np.hstack(
        [np.ascontiguousarray(part[crowded]).view(np.uint8).reshape(len(crowded), -1) for part in parts]
    )
    whole = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.shape[1])))[:, 0]
    _, group = np.unique(whole, return_inverse=True)
    by_id = np.empty(len(crowded), dtype=np.int64)
    by_id[pc.sort_indices(ids.take(pa.array(crowded))).to_numpy()] = np.arange(len(crowded))
    order = np.lexsort((by_id, group))
    spare = crowded[order[_rank_in_runs(group[order]) >= k]]
    if not len(spare):
        return None
    keep = np.ones(len(fingerprint), dtype=bool)
    keep[spare] = False
    return np.flatnonzero(keep)


class BestK:
    """Running best k per query over any number of candidate batches."""

    def __init__(
        self,
        queries: Vectors,
        k: int,
        metric: str,
        id_type: pa.DataType,
        tie_decimals: int | None = None,
    ):
        self.queries, self.k, self.metric = queries, int(k), metric
        self.tie_decimals = tie_decimals
        self.kept = pa.table(
            {
                "q": pa.array([], pa.int32()),
                "key": pa.array([], pa.float64()),
                "id": pa.array([], id_type),
            }
        )
        self.reach = np.full(queries.rows, np.inf)
        self.waiting: list[pa.Table] = []
        self.waiting_rows = 0
        self.flush_rows = max(50_000, queries.rows * self.k)
        self.room: np.ndarray | None = None

    def _slack(self, picked: slice | np.ndarray, block: Vectors) -> np.ndarray:
        """Bound on |float32 score - exact score| per query against this block."""
        dim = self.queries.dim
        top = block.norms.max(initial=0.0)
        own = self.queries.norms[picked]
        size = (own + top) ** 2 if self.metric == "l2" else own * top
        tie = 0.0 if self.tie_decimals is None else 10.0**-self.tie_decimals
        return 2.0 * (dim + 16) * 2.0**-24 * size + dim * 1e-44 + tie

    def _screen(self, left: np.ndarray, right: np.ndarray, squared: np.ndarray, rows: int) -> np.ndarray:
        """Scores by strip, query and row of the strip; smaller is better, rows that only fill up have none.

        Those of l2 lack the query's own square, as its bound does. All blocks are written to the
        same room: fresh pages would cost as much as the product.
        """
        strips, strip = right.shape[:2]
        shape, kind = (strips, len(left), strip), np.result_type(left, right)
        size = strips * len(left) * strip
        if self.room is None or self.room.dtype != kind or self.room.size < size:
            self.room = np.empty(size, dtype=kind)
        approx = self.room[:size].reshape(shape)
        np.matmul(left, right.transpose(0, 2, 1), out=approx)
        if self.metric == "l2":
            approx += squared.astype(kind)[:, None, :]
        approx[-1, :, rows - (strips - 1) * strip :] = np.inf
        return approx

    def exact(self, block: Vectors, qi: np.ndarray, gi: np.ndarray) -> np.ndarray:
        """Sort key (smaller is better) of each (query, row) pair in double precision."""
        out = np.empty(len(qi))
        step = max(1, PAIR_BYTES // (8 * max(1, self.queries.dim)))
        for start in range(0, len(qi), step):
            left = self.queries.take(qi[start : start + step])
            right = block.take(gi[start : start + step])
            if self.metric == "l2":
                left -= right
                left *= left
                out[start : start + step] = left.sum(axis=1)
            else:
                left *= right
                out[start : start + step] = -left.sum(axis=1)
        return out if self.tie_decimals is None else np.round(out, self.tie_decimals)

    def offer(
        self,
        block: Vectors,
        ids: pa.Array,
        picked: np.ndarray | None = None,
        rows: np.ndarray | None = None,
        keep_pair=None,
    ) -> None:
        """Score the picked queries against the given rows of a block."""
        if block.rows and block.dim != self.queries.dim:
            raise ValueError(
                f"Expected vectors of dimension {self.queries.dim}, received {block.dim}"
            )
        asked = self.queries.rows if picked is None else len(picked)
        offered = block.rows if rows is None else len(rows)
        for part in np.array_split(np.arange(offered), -(-offered // SCREEN_ROWS) or 1):
            part = part if rows is None else rows[part]
            if not len(part):
                continue
            right, squared = _strips(block.screen[part]), _strips(block.squared[part])
            step = max(1, SCREEN_PAIRS // squared.size)
            for start in range(0, asked, step):
                some = slice(start, min(asked, start + step))
                some = some if picked is None else picked[some]
                qi, gi = self._near(some, right, squared, len(part), self._slack(some, block))
                if not len(qi):
                    continue
                qi, gi = qi + start if picked is None else some[qi], part[gi]
                if keep_pair is not None:
                    keep = keep_pair(qi, gi)
                    qi, gi = qi[keep], gi[keep]
                self.add(qi, self.exact(block, qi, gi), gi, ids)

    def _near(
        self,
        some: slice | np.ndarray,
        right: np.ndarray,
        squared: np.ndarray,
        rows: int,
        slack: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of some queries and a block's rows that may enter a best k.

        The best score of each run is found first. The k-th of them bounds the k-th of all scores, and
        only runs whose best is within the bound are compared: few of them, once many rows were seen.
        """
        k = self.k
        left = self.queries.screen[some] * (-2 if self.metric == "l2" else -1)
        approx = self._screen(left, right, squared, rows)
        strips, asked, strip = approx.shape
        run = min(strip, SCREEN_RUN)
        runs = approx.reshape(strips, asked, -1, run)
        best = runs.min(axis=3).transpose(1, 0, 2).reshape(asked, -1)
        bound = self.reach[some] + slack
        if self.metric == "l2":
            bound -= self.queries.squared[some]
        if best.shape[1] >= k:
            kth = np.partition(best, k - 1, axis=1)[:, k - 1]
            bound = np.fmin(bound, kth + 2 * slack)
        open_ended = np.isinf(bound)
        if rows > k and open_ended.any():
            whole = approx[:, open_ended].transpose(1, 0, 2).reshape(-1, strips * strip)
            bound[open_ended] = np.partition(whole, k - 1, axis=1)[:, k - 1] + 2 * slack[open_ended]
        # Compared in the block's own type, rounded so that no candidate is lost.
        reach = np.nextafter(bound.astype(approx.dtype), np.inf, dtype=approx.dtype)
        # A best score that is no number hides the others of its run, so that run is compared.
        q, at = np.divmod(np.flatnonzero(~(best > reach[:, None])), best.shape[1])
        met = runs[at // runs.shape[2], q, at % runs.shape[2]]
        near, place = np.divmod(np.flatnonzero(met <= reach[q, None]), run)
        qi, gi = q[near], at[near] * run + place
        return (qi, gi) if rows == strips * strip else (qi[gi < rows], gi[gi < rows])

    def offer_cells(
        self, block: Vectors, ids: pa.Array, asked: Cells, held: Cells, keep_pair=None
    ) -> None:
        """Score the queries and rows that share a cell.

        Crowded cells are scored as blocks. The many small ones are pooled into lists of pairs,
        since a matrix product per handful of rows would cost more than its arithmetic.
        """
        mine, theirs = asked.shared(held)
        sizes = asked.counts[mine] * held.counts[theirs]
        for left, right in zip(mine[sizes >= BLOCK_PAIRS], theirs[sizes >= BLOCK_PAIRS]):
            self.offer(block, ids, asked.members(left), held.members(right), keep_pair)
        small = sizes < BLOCK_PAIRS
        mine, theirs, sizes = mine[small], theirs[small], sizes[small]
        limit = max(BLOCK_PAIRS, PAIR_BYTES // (8 * max(1, self.queries.dim)))
        chunk = np.cumsum(sizes) // limit
        for cut in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(chunk)) + 1):
            if len(cut):
                qi, gi = asked.pairs(mine[cut], held, theirs[cut])
                self._offer_pairs(block, ids, qi, gi, keep_pair)

    def _offer_pairs(self, block, ids, qi, gi, keep_pair) -> None:
        if block.dim != self.queries.dim:
            raise ValueError(
                f"Expected vectors of dimension {self.queries.dim}, received {block.dim}"
            )
        if keep_pair is not None:
            keep = keep_pair(qi, gi)
            qi, gi = qi[keep], gi[keep]
        product = np.einsum("ij,ij->i", self.queries.screen[qi], block.screen[gi])
        if self.metric == "l2":
            approx = self.queries.squared[qi] + block.squared[gi] - 2.0 * product
        else:
            approx = -product
        everyone = np.arange(self.queries.rows)
        near = approx <= (self.reach + self._slack(everyone, block))[qi]
        qi, gi = qi[near], gi[near]
        self.add(qi, self.exact(block, qi, gi), gi, ids)

    def add(self, qi: np.ndarray, keys: np.ndarray, gi: np.ndarray, ids: pa.Array) -> None:
        within = keys <= self.reach[qi]
        if not within.all():
            qi, keys, gi = qi[within], keys[within], gi[within]
        if not len(qi):
            return
        self.waiting.append(
            pa.table(
                {
                    "q": pa.array(qi.astype(np.int32)),
                    "key": pa.array(keys + 0.0),
                    "id": ids.take(pa.array(gi)),
                }
            )
        )
        self.waiting_rows += len(qi)
        if self.waiting_rows >= self.flush_rows:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        pool = pa.concat_tables([self.kept, *self.waiting]).combine_chunks()
        self.waiting, self.waiting_rows = [], 0
        order = pc.sort_indices(
            pool, sort_keys=[("q", "ascending"), ("key", "ascending"), ("id", "ascending")]
        )
        q = pool["q"].to_numpy()[order.to_numpy()]
        rank = _rank_in_runs(q)
        inside = rank < self.k
        self.kept = pool.take(order.filter(pa.array(inside)))
        last = rank[inside] == self.k - 1
        self.reach[self.kept["q"].to_numpy()[last]] = self.kept["key"].to_numpy()[last]

    def result(self, queries: dict[str, pa.Array]) -> pa.Table:
        """The queries' columns, rank, id, score; in query and rank order of this task's rows."""
        self.flush()
        q = pa.array(self.kept["q"].to_numpy())
        keys = self.kept["key"].to_numpy()
        return pa.table(
            {
                **{name: column.take(q) for name, column in queries.items()},
                "rank": pa.array((_rank_in_runs(q.to_numpy()) + 1).astype(np.int32)),
                "id": self.kept["id"],
                "score": pa.array(keys if smaller_is_better(self.metric) else -keys + 0.0),
            }
        )


def _rank_in_runs(values: np.ndarray) -> np.ndarray:
    """0-based position within each run of equal neighbours."""
    index = np.arange(len(values))
    if not len(values):
        return index
    starts = np.r_[True, values[1:] != values[:-1]]
    return index - np.maximum.accumulate(np.where(starts, index, 0))


class Cells:
    """Which queries look into which cell (inverted list or hash bucket)."""

    def __init__(self, cells: np.ndarray, owner: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.owner = owner[order]
        self.keys, self.starts, self.counts = np.unique(
            cells[order], return_index=True, return_counts=True
        )

    @classmethod
    def of_lists(cls, column: pa.Array | pa.ChunkedArray) -> Cells:
        """From a list column: every entry of a row is a cell of that row."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return cls(
            column.flatten().to_numpy(zero_copy_only=False),
            pc.list_parent_indices(column).to_numpy(zero_copy_only=False),
        )

    @classmethod
    def of_tables(cls, cells: np.ndarray) -> list[Cells]:
        """One per hash table, from a (rows, tables) matrix."""
        rows = np.arange(len(cells))
        return [cls(cells[:, table], rows) for table in range(cells.shape[1])]

    def members(self, at: int) -> np.ndarray:
        """Owners in the cell at a position of ``keys``."""
        return self.owner[self.starts[at] : self.starts[at] + self.counts[at]]

    def of_key(self, cell: int) -> np.ndarray:
        at = np.searchsorted(self.keys, cell)
        found = at < len(self.keys) and self.keys[at] == cell
        return self.members(at) if found else self.owner[:0]

    def shared(self, other: Cells) -> tuple[np.ndarray, np.ndarray]:
        """Positions, on both sides, of the cells that both sides hold."""
        _, mine, theirs = np.intersect1d(
            self.keys, other.keys, assume_unique=True, return_indices=True
        )
        return mine, theirs

    def pairs(
        self, mine: np.ndarray, other: Cells, theirs: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Every owner of ``mine[i]`` with every owner of ``theirs[i]``, for all i at once."""
        rows = other.counts[theirs]
        sizes = self.counts[mine] * rows
        group = np.repeat(np.arange(len(mine)), sizes)
        step = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = self.owner[self.starts[mine][group] + step // rows[group]]
        right = other.owner[other.starts[theirs][group] + step % rows[group]]
        return left, right


def first_shared_table(q_cells: np.ndarray, g_cells: np.ndarray, table: int):
    """Keep a pair in the first hash table that joins it, so it is offered once."""

    def keep(qi: np.ndarray, gi: np.ndarray) -> np.ndarray:
        if table == 0:
            return np.ones(len(qi), dtype=bool)
        return ~(q_cells[qi, :table] == g_cells[gi, :table]).any(axis=1)

    return keep
