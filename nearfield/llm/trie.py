"""Prefix trie of conversations, in double arrays.

Conversations are rebuilt as rows of turn digests; equal ones become one sequence with a count, and
their ids are hashed in a sorted stream. A prefix that more than a bound of different sequences
share is an *upper* node; there are few of them. Every other sequence leaves the upper trie at its
*cut*, the first prefix below the bound, and all sequences of one cut lie in one prefix shard. A
shard numbers its turns densely, packs BASE and CHECK arrays level by level, and walks its sequences
through them for the nodes and their aggregates. The cuts' aggregates are summed per upper node and
folded upwards, so an upper node that many shards share is counted once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import small, words_in, written

# Sequences below a prefix from which on it is an upper node, and the most upper nodes there can be.
SHARED_SEQUENCES, UPPER_NODES = 1_000, 200_000
# Turns of one shard.
SHARD_TURNS = 20_000
# Ids that are joined before they travel: the width of a range of ids.
LEAST_WIDTH, MOST_WIDTH = 1_024, 65_536
# Starting places that are tried for a node with several children.
TRIES = 16

ROOT = bytes(16)
NOTHING = hashlib.sha256().hexdigest()


# The double array ---------------------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK over dense labels: the child of slot s by label c is slot BASE[s] + c.

    It is a child only if CHECK there is s. Slot 0 is the root; BASE may be negative.
    """

    def __init__(self, labels: np.ndarray, bounds: np.ndarray):
        """Sequences lie side by side in ``labels``; ``bounds`` has their edges."""
        self.labels, self.bounds = labels, bounds
        size = 2 * (len(labels) + 1) + 64
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = 0
        self.top = 1
        self.holes: list[int] = []
        width = int(labels.max(initial=0)) + 1
        state = np.zeros(len(bounds) - 1, np.int64)
        active, depth = np.flatnonzero(np.diff(bounds) > 0), 0
        while len(active):
            label = labels[bounds[active] + depth]
            pairs = np.unique(state[active] * width + label)
            self._place(pairs // width, pairs % width)
            state[active] = self.base[state[active]] + label
            depth += 1
            active = active[np.diff(bounds)[active] > depth]

    def _room(self, upto: int) -> None:
        if upto > len(self.check):
            more = max(upto, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _hole(self) -> int:
        """A free slot below the top, else the top."""
        while self.holes:
            slot = self.holes.pop()
            if self.check[slot] < 0:
                return slot
        self.top += 1
        return self.top - 1

    def _place(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """Give the children of a level their slots; they come by parent, then by label."""
        first = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(np.append(first, len(parents)))
        for at in first[sizes > 1].tolist():
            stop = at + int(sizes[np.searchsorted(first, at)])
            self._several(int(parents[at]), labels[at:stop])
        single = first[sizes == 1]
        slots = np.array([self._hole() for _ in range(len(single))], np.int64)
        self._room(self.top)
        self.base[parents[single]] = slots - labels[single]
        self.check[slots] = parents[single]

    def _several(self, parent: int, labels: np.ndarray) -> None:
        spread = labels - labels[0]
        place = self.top
        for slot in self.holes[: -TRIES - 1 : -1]:
            self._room(slot + int(spread[-1]) + 1)
            if (self.check[slot + spread] < 0).all():
                place = slot
                break
        slots = place + spread
        self._room(int(slots[-1]) + 1)
        self.check[slots] = parent
        self.base[parent] = place - labels[0]
        if slots[-1] >= self.top:
            fresh = np.arange(self.top, int(slots[-1]))
            self.holes += fresh[self.check[fresh] < 0].tolist()
            self.top = int(slots[-1]) + 1

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per level the sequences that reach it and the slots where they stand."""
        sizes = np.diff(self.bounds)
        state = np.zeros(len(sizes), np.int64)
        active, depth = np.flatnonzero(sizes > 0), 0
        while len(active):
            before = state[active]
            state[active] = self.base[before] + self.labels[self.bounds[active] + depth]
            if (self.check[state[active]] != before).any():
                raise AssertionError("a sequence has left its trie")
            yield active, state[active]
            depth += 1
            active = active[sizes[active] > depth]


# Sequences ----------------------------------------------------------------------------------


def _sequences(rows: DataFrame) -> DataFrame:
    """Rebuilt conversations, written: ``conv``, ``digests`` (16 bytes a turn), ``words``, ``seq``."""
    size = F.octet_length("role").cast("string")
    turns = rows.select(
        "conv",
        F.struct(
            "turn",
            "role",
            F.md5(F.concat(size, F.lit(":"), "role", "text")).alias("digest"),
            words_in(F.col("text")).alias("words"),
        ).alias("t"),
    )
    own = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("own"))
    own = own.select(
        "conv",
        F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own"),
    )
    own = written(own, "trie-own")
    heads = own.where(F.col("conv") % 20 == 0).select(
        F.col("conv").alias("base"), F.slice("own", 1, 3).alias("head")
    )
    h = (F.crc32(F.col("conv").cast("string")) % 4).cast("int")
    joined = own.withColumn("base", F.col("conv") - F.col("conv") % 20).join(heads, "base", "left")
    nothing = F.slice("own", 1, 0)
    turns = F.concat(
        F.slice(F.coalesce("head", nothing), F.lit(1), h),
        F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))),
    )
    rebuilt = joined.select("conv", turns.alias("turns")).select(
        "conv",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("digests"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    return written(rebuilt.withColumn("seq", F.md5("digests")), "trie-conversations")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, least id and digest of the ids of each sequence, from ranges of ids in order."""
    now, state, count, least = None, hashlib.sha256(), 0, 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["seq", "n_convs", "conv", "ids_sha256"])

    for rows in batches:
        columns = (rows.column(c).to_pylist() for c in ("seq", "n", "least", "ids"))
        for seq, n, first, ids in zip(*columns, strict=True):
            if seq != now:
                if now is not None:
                    out.append((now, count, least, state.hexdigest()))
                now, state, count, least = seq, hashlib.sha256(ids.encode()), 0, first
            else:
                state.update(f",{ids}".encode())
            count += n
        if len(out) > 10_000:
            yield batch()
            out = []
    if now is not None:
        out.append((now, count, least, state.hexdigest()))
    if out:
        yield batch()


def _distinct(members: DataFrame) -> DataFrame:
    """Different sequences, written: ``n_convs``, ``conv`` (least), ``ids_sha256`` and the turns.

    A range of ids is one row of a sequence, so a crowded sequence travels in few rows; its digest
    is taken in a stream.
    """
    seen = members.agg(F.count("conv").alias("n"), F.min("conv").alias("a"), F.max("conv").alias("b")).first()
    width = (seen["b"] - seen["a"] + 1) * LEAST_WIDTH // max(seen["n"], 1) if seen["n"] else LEAST_WIDTH
    width = min(max(width, LEAST_WIDTH), MOST_WIDTH)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    ranges = members.groupBy("seq", F.floor(F.col("conv") / width).alias("range")).agg(
        F.count("conv").alias("n"), F.min("conv").alias("least"), ids.alias("ids")
    )
    counted = (
        ranges.repartition("seq")
        .sortWithinPartitions("seq", "range")
        .select("seq", "n", "least", "ids")
        .mapInArrow(_streamed, "seq string, n_convs bigint, conv bigint, ids_sha256 string")
    )
    return written(counted.join(members.drop("seq"), "conv").drop("seq"), "trie-sequences")


# Upper nodes --------------------------------------------------------------------------------


def _turns(digests: bytes) -> list[bytes]:
    return [digests[i : i + 16] for i in range(0, len(digests), 16)]


def _below(key: bytes, turn: bytes) -> bytes:
    """The key of a prefix from the key of the one before."""
    return hashlib.md5(key + turn).digest()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for digests, words in zip(*(rows.column(c).to_pylist() for c in ("digests", "words")), strict=True):
            keys = [ROOT]
            for turn in _turns(digests):
                keys.append(_below(keys[-1], turn))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[1:], pa.binary()),
                    pa.array(keys[:-1], pa.binary()),
                    pa.array(range(1, len(keys)), pa.int64()),
                    pa.array(words, pa.int64()),
                ],
                ["key", "above", "depth", "words"],
            )


_UPPER = "key binary, above binary, depth bigint, words bigint"


def _upper(sequences: DataFrame, shared: int) -> DataFrame:
    """Prefixes of more than ``shared`` sequences, and the root: turns / ``shared`` rows at most."""
    first = F.substring("digests", 1, 16)
    turned = sequences.where(F.octet_length("digests") > 0)
    crowded = written(
        turned.groupBy(first.alias("turn")).count().where(F.col("count") > shared).select("turn"), "trie-turns"
    )
    root = sequences.sparkSession.createDataFrame([(bytearray(ROOT), None, 0, 0)], _UPPER)
    below = turned.join(small(crowded, UPPER_NODES), first == F.col("turn"), "left_semi")
    counted = (
        below.select("digests", "words")
        .mapInArrow(_prefixes, _UPPER)
        .groupBy("key", "above", "depth", "words")
        .count()
        .where(F.col("count") > shared)
        .drop("count")
    )
    return written(root.unionByName(counted), "trie-upper")


def _cutter(upper: frozenset[bytes]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            above, cuts, depths = [], [], []
            for digests in rows.column("digests").to_pylist():
                key, depth, found = ROOT, 0, None
                for at in range(0, len(digests), 16):
                    child = _below(key, digests[at : at + 16])
                    depth += 1
                    if child not in upper:
                        found = child
                        break
                    key = child
                above.append(key)
                cuts.append(found)
                depths.append(depth)
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array(above, pa.binary()),
                    pa.array(cuts, pa.binary()),
                    pa.array(depths, pa.int64()),
                ],
                [*rows.schema.names, "above", "cut", "cut_depth"],
            )

    return cut


# Shards -------------------------------------------------------------------------------------

_FIGURES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def _nodes(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """All nodes of one prefix shard; ``above`` is set where the parent is an upper node."""
    cuts, depths = rows.column("cut").to_pylist(), rows.column("cut_depth").to_numpy()
    bodies = rows.column("digests").to_pylist()
    # Behind its cut, a sequence goes on turn by turn. Cuts get the first numbers.
    tails = [body[16 * d :] for body, d in zip(bodies, depths.tolist(), strict=True)]
    symbols = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(16), len(cuts) + sum(map(len, tails)) // 16, [None, pa.py_buffer(b"".join([*cuts, *tails]))]
    )
    dense = symbols.dictionary_encode().indices.to_numpy().astype(np.int64)
    sizes = np.array([len(t) // 16 for t in tails], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    labels = np.empty(bounds[-1], np.int64)
    labels[bounds[:-1]] = dense[: len(cuts)]
    inside = np.ones(len(labels), bool)
    inside[bounds[:-1]] = False
    labels[inside] = dense[len(cuts) :]
    every = rows.column("words").combine_chunks()
    word_bounds, words_flat = every.offsets.to_numpy(), every.values.to_numpy()

    trie = DoubleArray(labels, bounds)
    room = len(trie.check)
    n, first = np.zeros(room, np.int64), np.full(room, np.iinfo(np.int64).max)
    depth, own_words = np.zeros(room, np.int64), np.zeros(room, np.int64)
    end = np.full(room, -1, np.int64)
    weight, least = rows.column("n_convs").to_numpy(), rows.column("conv").to_numpy()
    levels = []
    for level, (active, slots) in enumerate(trie.walk()):
        np.add.at(n, slots, weight[active])
        np.minimum.at(first, slots, least[active])
        depth[slots] = depths[active] + level
        own_words[slots] = words_flat[word_bounds[active] + depths[active] + level - 1]
        last = sizes[active] == level
        end[slots[last]] = active[last]
        levels.append(np.unique(slots))
    nodes = np.concatenate(levels)
    children, leaves = np.zeros(room, np.int64), np.zeros(room, np.int64)
    saved = (n - 1) * own_words
    parent = trie.check
    for slots in levels[::-1]:
        leaves[slots] += children[slots] == 0
        np.add.at(children, parent[slots], 1)
        np.add.at(leaves, parent[slots], leaves[slots])
        np.add.at(saved, parent[slots], saved[slots])
    top = np.isin(nodes, levels[0])
    digests = np.array([*rows.column("ids_sha256").to_pylist(), NOTHING], object)
    above = np.full(room, None, object)
    starts = next(trie.walk())
    for row, slot, key_above in zip(*starts, rows.column("above").to_pylist(), strict=True):
        above[slot] = key_above
    return pa.table(
        {
            "conv_id": first[nodes],
            "depth": depth[nodes],
            "parent_conv_id": pa.array(first[parent[nodes]], mask=top),
            "n_convs": n[nodes],
            "n_children": children[nodes],
            "n_leaves": leaves[nodes],
            "saved_tokens": saved[nodes],
            "ends_sha256": pa.array(digests[end[nodes]], pa.string()),
            "above": pa.array(above[nodes], pa.binary()),
        }
    )


def _folded(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The upper nodes with the aggregates of all below them, deepest first."""
    nodes = {r["key"]: r for r in rows.to_pylist()}
    order = sorted(nodes.values(), key=lambda r: -r["depth"])
    for r in order:
        r["children"] = r["cuts"]
    for r in order:
        r["leaves"] += r["children"] == 0
        r["saved"] += (r["n"] - 1) * r["words"]
        if r["depth"]:
            up = nodes[r["above"]]
            up["n"] += r["n"]
            up["least"] = r["least"] if up["least"] is None else min(up["least"], r["least"])
            for name in ("leaves", "saved"):
                up[name] += r[name]
            up["children"] += 1
    return pa.table(
        {
            "key": pa.array([r["key"] for r in order], pa.binary()),
            "conv_id": pa.array([r["least"] for r in order], pa.int64()),
            "depth": pa.array([r["depth"] for r in order], pa.int64()),
            "parent_conv_id": pa.array(
                [nodes[r["above"]]["least"] if r["depth"] else None for r in order], pa.int64()
            ),
            "n_convs": pa.array([r["n"] for r in order], pa.int64()),
            "n_children": pa.array([r["children"] for r in order], pa.int64()),
            "n_leaves": pa.array([r["leaves"] for r in order], pa.int64()),
            "saved_tokens": pa.array([r["saved"] for r in order], pa.int64()),
            "ends_sha256": pa.array([r["ids_sha256"] or NOTHING for r in order], pa.string()),
        }
    )


def _zero(column: str) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")


def prefix_trie(
    conversations: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    shared: int = SHARED_SEQUENCES,
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    Result per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``, as the query op13 defines
    them. A null role or text is empty; a null turn comes first; turns of equal number are ordered
    by role, then by a digest of the text, and repeated rows are turns of their own; rows without a
    conversation id belong to no conversation; other columns are not read; an empty table gives no
    rows. A task holds the turn digests of a conversation (16 bytes each), never its texts.
    """
    rows = conversations.select(
        F.col(key).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    sequences = _distinct(_sequences(rows))
    turns = sequences.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    upper = _upper(sequences, max(shared, turns // UPPER_NODES))
    known = frozenset(bytes(r["key"]) for r in upper.select("key").collect())
    schema = sequences.schema.simpleString()[len("struct<") : -1]
    cut = written(
        sequences.mapInArrow(_cutter(known), f"{schema}, above binary, cut binary, cut_depth bigint"), "trie-cut"
    )
    shards = max(1, math.ceil(turns / shard_turns))
    nodes = written(
        cut.where("cut IS NOT NULL")
        .withColumn("shard", F.pmod(F.xxhash64("cut"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_nodes, f"{_FIGURES}, above binary"),
        "trie-nodes",
    )
    below = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(
        F.sum("n_convs").alias("n_below"),
        F.min("conv_id").alias("least_below"),
        F.count(F.lit(1)).alias("cuts"),
        F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"),
    )
    ended = cut.where("cut IS NULL").select(
        F.col("above").alias("key"), F.col("n_convs").alias("n_ended"), F.col("conv").alias("least_ended"), "ids_sha256"
    )
    joined = upper.join(below, "key", "left").join(ended, "key", "left").select(
        *upper.columns,
        (_zero("n_below") + _zero("n_ended")).alias("n"),
        F.least("least_below", "least_ended").alias("least"),
        *[_zero(c).alias(c) for c in ("cuts", "leaves", "saved")],
        "ids_sha256",
    )
    folded = joined.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_folded, f"key binary, {_FIGURES}")
    folded = written(folded.where("conv_id IS NOT NULL"), "trie-folded")
    parents = folded.select(F.col("key").alias("above"), F.col("conv_id").alias("upper_conv_id"))
    lower = nodes.join(small(parents, UPPER_NODES), "above", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id")
    )
    names = folded.drop("key").columns
    return lower.select(names).unionByName(folded.select(names))
