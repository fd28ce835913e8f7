"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Equal sets become one node first. Candidates come from shared keys. With the elements of all sets in
one order (rare ones first), sets that reach the threshold share ``c`` elements among their first
``n - need + c``. Small sets enumerate all subsets of the fixed size ``c = 2`` of that prefix, which
frequent elements alone rarely make equal; large sets, whose subsets would be too many, scan the
inverted lists of single elements (``c = 1``). The size that parts them is the one where both cost
the same. Sets just below it take part in both, so no pair is lost across it.

Groups never become all their pairs. Round one pairs every member of a list with one of them only,
that which may share most; links found join sets into components. Round two pairs what is left: members of one list
that are still in different components. A pair inside a component adds nothing, so the components
are exact. Every pair passes an exact bound on its smallest hashes before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.common import own_name, small, written

# Elements of more sets than this come last in the order; at most so many are listed. Any list is
# correct, a better one makes shorter inverted lists.
FREQUENT = 96
FREQUENT_ELEMENTS = 262_144
# Rows of a helper table that are still sent to every executor: those that pick texts, which would
# have to be shuffled else, and those that pick keys, which are narrow.
BROADCAST_ROWS = 1_000_000
BROADCAST_KEYS = 65_536
# What comparing one candidate costs, in keys written.
PAIR_COST = 1.0

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


@dataclass(frozen=True)
class Law:
    """When two documents link: words of a shingle, and the least Jaccard similarity in percent."""

    words: int = 3
    percent: int = 90

    def __post_init__(self):
        # From 60 on, sets that can link share two elements at least, which a key of two needs.
        if self.words < 1 or not 60 <= self.percent <= 99:
            raise ValueError(f"no such law: {self}")

    @property
    def least(self) -> int:
        """Sets below this size link with equal sets only."""
        return -(-self.percent // (100 - self.percent))

    def least_shared(self, n: int | np.ndarray) -> int | np.ndarray:
        """Elements a set of n must share with any partner, rounded up."""
        return (self.percent * n + 99) // 100

    def prefix_size(self, n: int | np.ndarray) -> int | np.ndarray:
        return n - self.least_shared(n) + 1

    def sketch_size(self, n: int) -> int:
        """Smallest hashes kept: a prefix though a third of them be frequent, whatever the size."""
        return min(n, self.prefix_size(n) * 3 // 2 + 17)

    def reaches(self, shared, sizes):
        """Whether sets of ``sizes`` elements in sum link if they share ``shared``."""
        return (100 + self.percent) * shared >= self.percent * sizes


# The law of the query op6; the pipeline's stage has its own.
EXACT = Law()


def shingles(text: bytes, width: int = EXACT.words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter word sequence is one shingle."""
    words = text.translate(_LOWER).split()  # bytes split at space and five controls only
    if not words:
        return np.zeros(0, _U)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    count = len(h) - width + 1
    found = _mix(h[:count])
    for k in range(1, width):
        found = _mix(found + h[k : k + count])
    return np.unique(found)


def least_shared(n: int | np.ndarray, law: Law = EXACT) -> int | np.ndarray:
    """Elements a set of n must share with any partner: ceil(0.9 n) for op6."""
    return law.least_shared(n)


def prefix_size(n: int | np.ndarray, law: Law = EXACT) -> int | np.ndarray:
    return law.prefix_size(n)


def _bodies(column: pa.Array) -> list[bytes]:
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _unlisted(column: pa.Array) -> list[np.ndarray]:
    """Long lists of a column as unsigned arrays."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(_U)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _node_of(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def _describe(law: Law):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(body, law.words) for body in _bodies(batch.column("text"))]
            heads = [s[: law.sketch_size(len(s))] if len(s) >= law.least else s[:0] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node_of(s) if len(s) else None for s in sets], pa.binary()),
                    _longs(heads),
                ],
                ["doc_id", "mark", "n", "node", "sketch"],
            )

    return describe


def described(docs: DataFrame, key: str, text: str, law: Law = EXACT) -> DataFrame:
    """Per document: size of its set, digest of the set, and its smallest hashes."""
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
        F.col(text).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _describe(law), f"doc_id {kind}, mark bigint, n bigint, node binary, sketch array<bigint>"
    )


def distinct_sets(sets: DataFrame, law: Law = EXACT) -> DataFrame:
    """One row per distinct set that can have links, with a number of its own."""
    merged = (
        sets.where(F.col("n") >= law.least)
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    return written(merged.withColumn("nid", F.monotonically_increasing_id()), "join-nodes")


def element_counts(nodes: DataFrame) -> DataFrame:
    """Elements among the smallest hashes of more than one set, with their number of sets."""
    counted = nodes.select(F.explode("sketch").alias("element")).groupBy("element").count()
    return written(counted.where("count > 1"), "join-counts")


def boundary(counts: DataFrame, law: Law = EXACT) -> tuple[np.ndarray, int]:
    """The frequent elements, and the size from which lists are scanned.

    An element of a prefix of p costs one key and as many pairs as its list is long; a subset costs
    one key, and there are p + 1 over 2 of them. They meet where (p + 1) / 2 is a list's cost.
    """
    rest = counts.where(F.col("count") <= FREQUENT).agg(
        F.sum(F.col("count") * (F.col("count") - 1)).alias("pairs"), F.sum("count").alias("all")
    )
    row = rest.first()
    companions = (row["pairs"] or 0) / max(1, row["all"] or 0)
    most = 2 * (1 + PAIR_COST * companions) - 1
    # prefix_size(n) is about n / 10 + 1 at 90 percent
    return most_frequent(counts), max(law.least + 1, int(100 * most) // (100 - law.percent))


def most_frequent(counts: DataFrame) -> np.ndarray:
    top = counts.where(F.col("count") > FREQUENT).orderBy(F.col("count").desc(), "element")
    listed = top.select("element").limit(FREQUENT_ELEMENTS).toArrow()["element"]
    return np.sort(listed.to_numpy().view(_U))


def prefix_keys(
    elements: np.ndarray, n: int, from_size: int, law: Law = EXACT
) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set whose first elements in the common order are given, and for each key the
    most that the set can share with another if the key's elements are the first they share."""
    p = int(law.prefix_size(n))
    keys, most = [], []
    if n < from_size:
        i, j = np.triu_indices(p + 1, 1)
        head = elements[: p + 1]
        low, high = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
        keys.append(_mix(_mix(low) + high))
        most.append(n - j + 1)
    if 100 * n >= law.percent * from_size:
        keys.append(_mix(elements[:p] + _U(1)))
        most.append(n - np.arange(p))
    return np.concatenate(keys), np.concatenate(most)


def _in_order(elements: np.ndarray, frequent: np.ndarray, whole: bool, need: int):
    """The first ``need`` elements in the common order, or None if more of the set must be seen."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        often = frequent[at] == elements
    else:
        often = np.zeros(len(elements), bool)
    rare = elements[~often]
    if len(rare) >= need:
        return rare[:need]
    return np.concatenate([rare, elements[often]])[:need] if whole else None


def _key_batches(rows, frequent, from_size, law):
    """Key rows of (nid, n, elements, whole) rows; sets seen too little of get one null key."""
    nids, sizes, parts, mosts = [], [], [], []
    short = []
    for nid, n, elements, whole in rows:
        head = _in_order(elements, frequent, whole, int(law.prefix_size(n)) + 1)
        if head is None:
            short.append((nid, n))
            continue
        keys, most = prefix_keys(head, n, from_size, law)
        parts.append(keys)
        mosts.append(most)
        nids.append(np.full(len(keys), nid, np.int64))
        sizes.append(np.full(len(keys), n, np.int64))
    if parts:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(parts).view(np.int64)),
                pa.array(np.concatenate(nids)),
                pa.array(np.concatenate(sizes)),
                pa.array(np.concatenate(mosts)),
            ],
            ["key", "nid", "n", "most"],
        )
    if short:
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(short), pa.int64()),
                pa.array([s[0] for s in short], pa.int64()),
                pa.array([s[1] for s in short], pa.int64()),
                pa.nulls(len(short), pa.int64()),
            ],
            ["key", "nid", "n", "most"],
        )


_KEYS = "key bigint, nid bigint, n bigint, most bigint"


def list_keys(
    docs: DataFrame,
    nodes: DataFrame,
    frequent: np.ndarray,
    from_size: int,
    text: str,
    key: str,
    law: Law = EXACT,
) -> DataFrame:
    """The inverted lists with more than one member, as rows of ``key, nid, n, most``."""

    def of_sketches(batches):
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            rows = zip(
                batch.column("nid").to_pylist(), sizes, _unlisted(batch.column("sketch")), strict=True
            )
            yield from _key_batches(
                ((i, n, s, len(s) == n) for i, n, s in rows), frequent, from_size, law
            )

    def of_sets(batches):
        for batch in batches:
            elements = [np.frombuffer(b, _U) for b in batch.column("elements").to_pylist()]
            rows = zip(batch.column("nid").to_pylist(), elements, strict=True)
            yield from _key_batches(
                ((i, len(s), s, True) for i, s in rows), frequent, from_size, law
            )

    def elements_of(batches):
        for batch in batches:
            flat = b"".join(batch.column("elements").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(flat, np.int64))], ["element"])

    def first_keys():
        # Keys are cheap to make again from the nodes, so they are not written.
        return nodes.select("nid", "n", "sketch").mapInArrow(of_sketches, _KEYS)

    # Sets whose smallest hashes are mostly frequent: their order needs the whole set. As they are
    # near copies of each other, or full of common passages, their other elements are counted too.
    short = written(first_keys().where("key IS NULL").select("nid"), "join-short")
    sets = written(whole_sets(docs, nodes, short, key, text, law), "join-short-sets")
    counted = sets.mapInArrow(elements_of, "element bigint").groupBy("element").count()
    counted = written(counted.where(F.col("count") > FREQUENT), "join-short-counts")
    # From here on the order is fixed for all sets.
    frequent = np.union1d(frequent, most_frequent(counted))
    more = written(
        first_keys().where("key IS NULL").select("nid").join(short, "nid", "left_anti"), "join-more"
    )
    more_sets = written(whole_sets(docs, nodes, more, key, text, law), "join-more-sets")
    sets = sets.unionByName(more_sets)
    every = first_keys().where("key IS NOT NULL").unionByName(sets.mapInArrow(of_sets, _KEYS))
    # Most keys are found in one set only. Count keys alone, then keep the rows of the others.
    shared = written(every.groupBy("key").count().where("count > 1").select("key"), "join-shared")
    return written(every.join(small(shared, BROADCAST_KEYS), "key", "left_semi"), "join-lists")


def whole_sets(
    docs: DataFrame, nodes: DataFrame, wanted: DataFrame, key: str, text: str, law: Law = EXACT
) -> DataFrame:
    """``nid, elements`` of the wanted nodes, read from the texts of their representatives."""

    def elements(batches):
        for batch in batches:
            kept = []
            columns = (batch.column(c).to_pylist() for c in ("nid", "node"))
            for nid, node, body in zip(*columns, _bodies(batch.column("text")), strict=True):
                found = shingles(body, law.words)
                # Rows that share an id need not share a text.
                if len(found) and _node_of(found) == node:
                    kept.append((nid, found.tobytes()))
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.binary())],
                    ["nid", "elements"],
                )

    ids = written(
        nodes.join(small(wanted, BROADCAST_ROWS), "nid", "left_semi").select("nid", "node", "rep"),
        "join-wanted",
    )
    texts = docs.select(F.col(key).alias("rep_id"), F.col(text).alias("text"))
    found = texts.join(small(ids, BROADCAST_ROWS), F.col("rep_id").eqNullSafe(F.col("rep")))
    sets = found.select("nid", "node", "text").mapInArrow(elements, "nid bigint, elements binary")
    return sets.dropDuplicates(["nid"])


def _possible(n: str, most: str, other_n: str, other_most: str, law: Law):
    """Whether sets may reach the threshold if this key holds the first elements they share.

    A pair that reaches it passes in the list of its first shared elements, so none is lost.
    """
    return law.reaches(F.least(most, other_most), F.col(n) + F.col(other_n))


def first_pairs(lists: DataFrame, law: Law = EXACT) -> DataFrame:
    """Every member of a list with the one that may share most: the least edited of its copies."""
    share = F.col("most") / F.col("n")
    centers = lists.groupBy("key").agg(
        F.max(F.struct(share.alias("share"), "n", "nid", "most")).alias("center")
    )
    centers = written(centers, "join-centers")
    return (
        lists.join(small(centers, BROADCAST_KEYS), "key")
        .where(F.col("nid") != F.col("center.nid"))
        .where(_possible("n", "most", "center.n", "center.most", law))
        .select(F.least("nid", "center.nid").alias("a"), F.greatest("nid", "center.nid").alias("b"))
        .distinct()
    )


def open_pairs(
    lists: DataFrame, labels: DataFrame, tried: DataFrame, law: Law = EXACT
) -> DataFrame:
    """Pairs of a list that are in different components, but for those already compared."""
    members = lists.join(small(labels, BROADCAST_ROWS), "nid", "left").withColumn(
        "comp", F.coalesce("comp", "nid")
    )
    share = F.col("most") / F.col("n")
    mixed = (
        members.groupBy("key")
        .agg(
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.max(F.struct(share.alias("share"), "n", "nid", "comp")).alias("center"),
        )
        .where("low < high")
        .select("key", F.col("center.comp").alias("main"))
    )
    mixed = written(mixed, "join-mixed")
    rows = written(members.join(small(mixed, BROADCAST_KEYS), "key"), "join-members")
    # Of two components in a list, one at least is not the main one.
    aside = rows.where("comp != main").select(
        "key",
        F.col("nid").alias("x"),
        F.col("n").alias("xn"),
        F.col("most").alias("xm"),
        F.col("comp").alias("xc"),
    )
    pairs = (
        aside.join(rows, "key")
        .where((F.col("xc") != F.col("comp")) & _possible("xn", "xm", "n", "most", law))
        .select(F.least("x", "nid").alias("a"), F.greatest("x", "nid").alias("b"))
        .distinct()
    )
    return pairs.join(tried, ["a", "b"], "left_anti")


def _promising(law: Law):
    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose smallest hashes still allow the threshold: an exact upper bound."""
        for batch in batches:
            sizes = zip(batch.column("an").to_pylist(), batch.column("bn").to_pylist(), strict=True)
            sketches = zip(_unlisted(batch.column("as")), _unlisted(batch.column("bs")), strict=True)
            keep = []
            for (an, bn), (one, two) in zip(sizes, sketches, strict=True):
                # Up to the smaller of the two last hashes both sets are known completely.
                last = min(one[-1], two[-1])
                one, two = one[one <= last], two[two <= last]
                shared = len(np.intersect1d(one, two, assume_unique=True))
                most = shared + min(an - len(one), bn - len(two))
                keep.append(law.reaches(most, an + bn))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return promising


def _linked(law: Law):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("ae").to_pylist(), batch.column("be").to_pylist(), strict=True)
            keep = []
            for one, two in pairs:
                one, two = np.frombuffer(one, _U), np.frombuffer(two, _U)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(law.reaches(shared, len(one) + len(two)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


def links(
    docs: DataFrame, nodes: DataFrame, pairs: DataFrame, key: str, text: str, law: Law = EXACT
) -> DataFrame:
    """The pairs that reach the threshold, compared on their whole sets."""
    one = nodes.select(F.col("nid").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("as"))
    two = nodes.select(F.col("nid").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bs"))
    likely = written(
        pairs.join(one, "a").join(two, "b").mapInArrow(_promising(law), "a bigint, b bigint"),
        "join-likely",
    )
    wanted = written(
        likely.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), "join-compared"
    )
    sets = written(whole_sets(docs, nodes, wanted, key, text, law), "join-sets")
    left = sets.select(F.col("nid").alias("a"), F.col("elements").alias("ae"))
    right = sets.select(F.col("nid").alias("b"), F.col("elements").alias("be"))
    both = likely.join(left, "a").join(right, "b")
    return written(both.mapInArrow(_linked(law), "a bigint, b bigint"), "join-links")


def components(edges: DataFrame) -> DataFrame:
    """``nid, comp`` (the smallest node reachable) by alternating large and small stars.

    Every round replaces the edges by stars around smaller nodes; hubs are only ever grouped by
    minimum and joined, never gathered.
    """
    stars = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u != v")
        .distinct(),
        "join-stars",
    )
    seen = None
    while True:
        state = stars.agg(
            F.count("u").alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("sum"),
        ).first()
        if state == seen or state["n"] == 0:
            return stars.groupBy(F.col("u").alias("nid")).agg(F.min("v").alias("comp"))
        seen = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        lowered = (
            large.join(nearest, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        stars = written(
            lowered.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct(), "join-stars"
        )


def linked_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", law: Law = EXACT
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id``; also ``mark`` (digest of the
    text) and ``group`` (digest that names the group even where ids repeat).

    Two documents link as ``law`` says (op6: three words, 0.9 or more); the component is the smallest id
    reachable by links. Documents without words (null, empty or blank texts) have no shingles and
    are their own component. Repeated rows stay, a null id is the component only of documents that
    reach no other id, and an empty table gives no rows.
    """
    sets = written(described(docs, key, text, law), "join-described")
    nodes = distinct_sets(sets, law)
    frequent, from_size = boundary(element_counts(nodes), law)
    lists = list_keys(docs, nodes, frequent, from_size, text, key, law)
    tried = written(first_pairs(lists, law), "join-tried")
    found = links(docs, nodes, tried, key, text, law)
    labels = written(components(found), "join-labels")
    more = links(docs, nodes, open_pairs(lists, labels, tried, law), key, text, law)
    labels = written(components(found.unionByName(more)), "join-groups")
    # The smallest id over all nodes of a component; its smallest digest names the group.
    comps = nodes.select("nid", "node", "rep").join(labels, "nid", "left").select(
        "node", "rep", F.coalesce("comp", "nid").alias("comp")
    )
    least = comps.groupBy("comp").agg(
        F.min("rep").alias("component_id"), F.min("node").alias("group")
    )
    large_sets = comps.join(least, "comp").select("node", "component_id", "group")
    small_sets = (
        sets.where((F.col("n") > 0) & (F.col("n") < law.least))
        .groupBy("node")
        .agg(F.min("doc_id").alias("component_id"))
        .withColumn("group", F.col("node"))
    )
    groups = written(large_sets.unionByName(small_sets), "join-components")
    return sets.drop("sketch").join(small(groups, BROADCAST_ROWS), "node", "left").select(
        "doc_id",
        "mark",
        "group",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", law: Law = EXACT
) -> DataFrame:
    """One row of each group of linked documents: its smallest id, with all columns as they are.

    Every document without words stays. Of rows that repeat the kept id and its text, one stays.
    """
    groups = written(linked_groups(docs, key, text, law), "join-docs")
    worded = groups.where("n_shingles > 0")
    # The kept row of a group: its smallest id and, should that repeat, the smallest digest.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    kept = worded.groupBy("group").agg(F.min(order).alias("best"), F.count("mark").alias("rows"))
    crowded = written(
        kept.where("rows > 1").select(
            "group", F.col("best.doc_id").alias("best_id"), F.col("best.mark").alias("best_mark")
        ),
        "join-crowded",
    )
    ruled = worded.join(small(crowded, BROADCAST_ROWS), "group")
    is_best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark"))
    gone = written(ruled.where(~is_best).select("doc_id", "mark").distinct(), "join-gone")
    repeated = written(
        ruled.where(is_best).groupBy("doc_id", "mark").count().where("count > 1").drop("count"),
        "join-repeated",
    )
    mark, gone_id, gone_mark = (own_name(docs.columns, c) for c in ("mark", "gone_id", "gone_mark"))
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))

    def match(side: DataFrame, how: str, left: DataFrame) -> DataFrame:
        named = side.select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark))
        on = F.col(key).eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark))
        return left.join(small(named, BROADCAST_ROWS), on, how)

    left = match(gone, "left_anti", marked)
    if repeated.isEmpty():
        return left.drop(mark)
    once = match(repeated, "left_semi", left).dropDuplicates([key, mark])
    return match(repeated, "left_anti", left).unionByName(once).drop(mark)
