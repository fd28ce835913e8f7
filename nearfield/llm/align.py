"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline.

The ids are written as binary values of two (four) bytes an id; each batch of documents is then a
pair of list columns. The lists are flattened, parent indices tell the
document of a token, and a cumulative sum of token lengths that restarts with each document gives
the place where a token ends. A hash join of the two tables of ends on (document, end) finds the
places where tokens of both end: they cut the tokens into groups. The outer form of the same join
has one row for each stretch of bytes between neighbouring ends, and so for each pair of tokens that
overlap: a link. ``Table.group_by`` counts the links of a batch by pair of ids, Spark adds up the
counts, and tasks write them as sorted arrays that later tasks map into memory.
"""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import scratch, written
from nearfield.llm.files import mapped, own_file, save
from nearfield.llm.vocab import (
    FOLDER,
    Rows,
    Stretches,
    at_single_spaces,
    by_words,
    byte_entries,
    chunks,
    decoded,
    forget,
    in_runs,
    json_tokenizer,
    pair_encoder,
    piece_model,
    text_chunks,
)

BYTE_TOKENIZER = f"{FOLDER}/byte_bpe_50k.json"
PIECE_TOKENIZER = f"{FOLDER}/piece_bpe_32k.model"
# Tokens that are joined at a time, different pairs that a task gathers, and pairs of one file.
SLICE_TOKENS = 1 << 17
GATHERED_PAIRS = 500_000
SHARD_PAIRS = 2_000_000
# Text bytes that are cut and encoded at a time.
CHUNK_BYTES = 1 << 20
# Bits of a place that tell the byte at which a token ends; those above tell the document.
PLACE_BITS = 40
# Stretches that a worker remembers.
CACHE_STRETCHES = 150_000

_SPACE = re.compile(r"\s")


_entries: dict[str, list[bytes]] = {}


def piece_entries(path: str) -> list[bytes]:
    """Bytes of each id of a piece vocabulary."""
    if path not in _entries:
        model = piece_model(path)
        out = []
        for number in range(model.get_piece_size()):
            name = model.id_to_piece(number)
            out.append(bytes([int(name[3:5], 16)]) if model.is_byte(number) else name.replace("▁", " ").encode())
        _entries[path] = out
    return _entries[path]


class _Pair:
    """Both tokenizers on stretches that have a space before them."""

    def __init__(self, one: str, two: str):
        self.tokenizer, self.model = json_tokenizer(one), piece_model(two)
        self.entries = byte_entries(one), piece_entries(two)
        self.pairs = pair_encoder(self.entries[0], " [^ ]+")
        self.sizes = [np.array([len(e) for e in own]) for own in self.entries]
        # A stretch without white space opens with its only token that starts with a space.
        self.opens = [np.array([e.startswith(b" ") for e in own]) for own in self.entries]

    def _each(self, new: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> Rows:
        one = self.pairs.encode_ordinary
        each = lambda run: self._each([f" {s}" for s in run])
        return in_runs(words, lambda text: one(f" {text}"), each, self.opens[0])

    def _pieces(self, text: str) -> list[int]:
        return self.model.encode(text)  # the model puts a space of its own before it

    def _each_pieces(self, new: list[str]) -> list[list[int]]:
        return self.model.encode(new, num_threads=1)

    def joined(self, side: int, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries[side].__getitem__, ids.tolist()))

    def _returned(self, side: int, rows: Rows, bodies: list[bytes]) -> np.ndarray:
        """Rows whose ids give the bytes of their stretch."""
        upto = np.concatenate([[0], np.cumsum(self.sizes[side][rows.ids])])
        sizes = np.diff(upto[rows.bounds])
        same = sizes == np.fromiter(map(len, bodies), np.int64, len(bodies))
        if same.all() and self.joined(side, rows.ids) == b"".join(bodies):
            return same
        edges = zip(rows.bounds.tolist(), rows.bounds[1:].tolist(), bodies, strict=False)
        return np.array([self.joined(side, rows.ids[a:b]) == body for a, b, body in edges])

    def __call__(self, new: list[str]) -> tuple[list[str], list[Rows], np.ndarray]:
        ordered, tokens = by_words(
            new,
            self._plain,
            lambda marks: Rows.of(self._each(marks)),
            lambda rest: Rows.of(self._each([f" {s}" for s in rest])),
        )
        # In the pieces' order, stretches with white space inside come last.
        inner = np.fromiter((not s or _SPACE.search(s) is not None for s in ordered), bool, len(ordered))
        order = np.argsort(inner, kind="stable")
        ordered = [ordered[i] for i in order.tolist()]
        whole, rest = ordered[: len(inner) - inner.sum()], ordered[len(inner) - inner.sum() :]
        pieces = in_runs(whole, self._pieces, self._each_pieces, self.opens[1])
        rows = [tokens.take(order), pieces.plus(Rows.of(self._each_pieces(rest)))]
        bodies = [f" {s}".encode() for s in ordered]
        return ordered, rows, self._returned(0, rows[0], bodies) & self._returned(1, rows[1], bodies)


_coders: dict[tuple[str, str], tuple[_Pair, Stretches]] = {}


def coders(one: str, two: str) -> tuple[_Pair, Stretches]:
    """The two tokenizers and their cache, kept by the worker."""
    if (one, two) not in _coders:
        pair = _Pair(one, two)
        _coders[one, two] = pair, Stretches(pair, 2, at_single_spaces, CACHE_STRETCHES)
    return _coders[one, two]


def release() -> None:
    """Give the tokenizers and their cache back where a worker has ids only to read.

    What is freed stays with the allocators of Arrow and C, so both are asked to return it: a worker
    lives on, and its memory counts beside the executor's own.
    """
    _coders.clear()
    _entries.clear()
    forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tokenised(texts: list[str], bodies: list[bytes], one: str, two: str) -> tuple[Rows, Rows]:
    """Ids of texts by both tokenizers; none where joined bytes are not the space and the text."""
    pair, stretches = coders(one, two)
    rows, good = stretches.texts(texts)
    kept = np.array([bool(body) for body in bodies])
    for i in range(len(texts)):
        if kept[i] and not (good[i] and texts[i].encode() == bodies[i]):
            kept[i] = all(
                pair.joined(side, r.ids[r.bounds[i] : r.bounds[i + 1]]) == b" " + bodies[i]
                for side, r in enumerate(rows)
            )
    if kept.all():
        return tuple(rows)
    empty = np.zeros(1, np.int64)
    return tuple(
        r.plus(Rows(r.ids[:0], empty.repeat(2))).take(np.where(kept, np.arange(len(texts)), len(texts)))
        for r in rows
    )


def id_type(entries: int) -> pa.DataType:
    """How an id of so many is written."""
    return pa.uint16() if entries <= 1 << 16 else pa.int32()


def _packed(rows: Rows, kind: pa.DataType) -> pa.Array:
    """Rows of ids as binary values: Spark copies a value whole, but a list id by id."""
    edges = (rows.bounds * (kind.bit_width // 8)).astype(np.int32)
    ids = rows.ids.astype(kind.to_pandas_dtype())
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(ids)]
    )


def _of(part: pa.RecordBatch, name: str, kind: pa.DataType) -> pa.ListArray:
    """Ids of the rows of a slice as lists, without the rest of its batch."""
    column, width = part.column(name).cast(pa.binary()), kind.bit_width // 8
    _, edges, body = column.buffers()
    edges = np.frombuffer(edges, np.int32)[column.offset : column.offset + len(column) + 1] // width
    count = int(edges[-1] - edges[0])
    ids = pa.array([], pa.int32())
    if count:
        ids = pa.Array.from_buffers(kind, count, [None, body], offset=int(edges[0])).cast(pa.int32())
    return pa.ListArray.from_arrays(pa.array(edges - edges[0], pa.int32()), ids)


def _encode(one: str, two: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, bodies in text_chunks(batch.column("text"), CHUNK_BYTES):
                rows = tokenised(decoded(bodies), bodies, one, two)
                kinds = [id_type(len(e)) for e in (byte_entries(one), piece_entries(two))]
                packed = [_packed(r, kind) for r, kind in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, end - at), *packed], ["doc_id", "a", "b"]
                )

    return encode


def encoded(
    docs: DataFrame,
    one: str = BYTE_TOKENIZER,
    two: str = PIECE_TOKENIZER,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Ids of each document by both tokenizers, written: ``doc_id``, ``a``, ``b`` (see ``id_type``)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(
        rows.mapInArrow(_encode(one, two), f"doc_id {kind}, a binary, b binary"), "align-ids"
    )


# The join of a batch ------------------------------------------------------------------------


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two ids as one number: one key is grouped faster than two, and sorts by the second id."""
    return (b.astype(np.int64) << 32) | a


@dataclass
class Joined:
    """Links of a batch in the order of documents and bytes, and the batch's tokens."""

    links: pa.Table  # doc, end, a, b, both: does the stretch end a token of each side?
    sides: tuple[pa.Table, pa.Table]  # doc, end, a / doc, end, b

    def counts(self) -> pa.Table:
        """Links by pair of ids: ``pair`` (see ``_pair``), ``n``."""
        pairs = pa.table({"pair": _pair(self.links["a"].to_numpy(), self.links["b"].to_numpy())})
        return pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")])


def _ends(column: pa.Array, lengths: pa.Array, name: str) -> pa.Table:
    """One row per token: its document in the batch, the byte at which it ends, its id."""
    ids, doc = pc.list_flatten(column), pc.list_parent_indices(column)
    upto = pc.cumulative_sum(pc.take(lengths, ids)).to_numpy()
    counts = pc.list_value_length(column).to_numpy()
    first = np.cumsum(counts) - counts  # the document's first token
    before = np.concatenate([[0], upto])[first]
    segmented = upto - np.repeat(before, counts)
    return pa.table({"doc": doc.cast(pa.int64()), "end": pa.array(segmented), name: ids})


def _places(rows: pa.Table) -> np.ndarray:
    """Document and end of rows as one number, in the order of both."""
    return (rows["doc"].to_numpy() << PLACE_BITS) | rows["end"].to_numpy()


def joined(a: pa.Array, b: pa.Array, a_bytes: pa.Array, b_bytes: pa.Array) -> Joined:
    """Join the ends of two list columns of ids; in each row both lists cover the same bytes."""
    sides = _ends(a, a_bytes, "a"), _ends(b, b_bytes, "b")
    # Document and end as one number: one key is joined and sorted several times as fast as two.
    left, right = (
        pa.table({"place": pa.array(_places(t)), name: t[name]})
        for t, name in zip(sides, "ab", strict=True)
    )
    met = left.join(right, "place", join_type="full outer", use_threads=False)
    place = met["place"].to_numpy()
    order = np.argsort(place, kind="stable")
    met, place = met.select(["a", "b"]).take(pa.array(order)).combine_chunks(), place[order]
    both = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"]))
    # The token over a stretch is the next one to end; a document ends with an end of both.
    links = pa.table(
        {
            "doc": pa.array(place >> PLACE_BITS),
            "end": pa.array(place & ((1 << PLACE_BITS) - 1)),
            "a": pc.fill_null_backward(met["a"].combine_chunks()),
            "b": pc.fill_null_backward(met["b"].combine_chunks()),
            "both": both,
        }
    )
    return Joined(links, sides)


# What may follow an id in the text of a document's groups.
MARKS = (",", "|", ";", "")
_known_decimals: list[pa.Array] = []


def _decimals(most: int) -> pa.Array:
    """Decimal ids below ``most`` (at least), each with every mark behind it; kept by the worker."""
    if not _known_decimals or len(_known_decimals[0]) < most * len(MARKS):
        room = 1 << most.bit_length()
        made = pa.array([f"{i}{m}" for i in range(room) for m in MARKS], pa.large_string())
        _known_decimals[:] = [made]
    return _known_decimals[0]


def group_texts(rows: int, part: Joined) -> pa.Array:
    """Per document ``a1,a2|b1;a3|b2,b3``: the ids of each group, in order; without tokens empty."""
    links = part.links
    both = links["both"].combine_chunks().to_numpy(zero_copy_only=False)
    shared = links.filter(links["both"])
    ends = [_places(t) for t in part.sides]
    shared_ends = _places(shared)
    group = [np.searchsorted(shared_ends, e) for e in ends]  # group of each token
    size = [np.bincount(g, minlength=len(shared_ends)) for g in group]
    upto = [np.cumsum(s) for s in size]
    # Place of each token in the text: those of one side follow those of the other in a group.
    place_a = np.arange(len(ends[0])) + (upto[1] - size[1])[group[0]]
    place_b = np.arange(len(ends[1])) + upto[0][group[1]]
    total = len(place_a) + len(place_b)
    order = np.empty(total, np.int64)
    order[place_a] = np.arange(len(place_a))
    order[place_b] = len(place_a) + np.arange(len(place_b))
    ids = np.concatenate([t[k].to_numpy() for t, k in zip(part.sides, "ab", strict=True)])[order]
    mark = np.zeros(total, np.int64)  # the character behind a token
    mark[upto[0] + (upto[1] - size[1]) - 1] = 1
    mark[upto[0] + upto[1] - 1] = 2
    last = shared_ends >> PLACE_BITS
    closing = np.append(last[1:] != last[:-1], True) if len(last) else last.astype(bool)
    mark[(upto[0] + upto[1] - 1)[closing]] = 3
    words = _decimals(int(ids.max(initial=0)) + 1).take(pa.array(len(MARKS) * ids.astype(np.int64) + mark))
    docs = np.concatenate([t["doc"].to_numpy() for t in part.sides])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=rows))])
    assert both.sum() == len(shared_ends)
    lists = pa.LargeListArray.from_arrays(pa.array(bounds), words)
    return pc.binary_join(lists, pa.scalar("", pa.large_string())).cast(pa.string())


@dataclass
class Vocabulary:
    """What is needed to read ids: the bytes of each, and how the ids are written."""

    a_bytes: pa.Array
    b_bytes: pa.Array

    def __post_init__(self):
        self.kinds = id_type(len(self.a_bytes)), id_type(len(self.b_bytes))

    def slices(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
        """Parts of a batch with some ``SLICE_TOKENS``, and their lists of ids."""
        a, b = (
            pc.divide(pc.binary_length(batch.column(name)), kind.bit_width // 8)
            for name, kind in zip("ab", self.kinds, strict=True)
        )
        for at, end in chunks(pc.add(a, b).to_pylist(), SLICE_TOKENS):
            part = batch.slice(at, end - at)
            yield part, *(_of(part, name, kind) for name, kind in zip("ab", self.kinds, strict=True))

    def joined(self, a: pa.Array, b: pa.Array) -> Joined:
        return joined(a, b, self.a_bytes, self.b_bytes)


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def _vocabulary(one: str, two: str) -> Vocabulary:
    """Kept by the worker, in place of the tokenizers."""
    if (one, two) not in _vocabularies:
        sides = byte_entries(one), piece_entries(two)
        _vocabularies[one, two] = Vocabulary(
            *[pa.array([len(e) for e in entries], pa.int64()) for entries in sides]
        )
    release()
    return _vocabularies[one, two]


# Counts over the corpus ---------------------------------------------------------------------


def _partial(one: str, two: str):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(one, two)
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            sums = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            return sums.rename_columns(["pair", "n"])

        def passed_on(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            pair = rows["pair"].to_numpy()
            ids = [pa.array(x.astype(np.int32)) for x in (pair & 0xFFFFFFFF, pair >> 32)]
            yield from pa.table([*ids, rows["n"]], ["a", "b", "n"]).to_batches(1 << 16)

        for batch in batches:
            for _, a, b in known.slices(batch):
                own = known.joined(a, b).counts()
                held.append(own.rename_columns(["pair", "n"]))
                if sum(t.num_rows for t in held) > GATHERED_PAIRS:
                    held = [merged()]
                    if held[0].num_rows > GATHERED_PAIRS // 2:
                        yield from passed_on(held.pop())
        if held:
            yield from passed_on(merged())

    return partial


def pair_counts(ids: DataFrame, one: str = BYTE_TOKENIZER, two: str = PIECE_TOKENIZER) -> DataFrame:
    """Links of the whole corpus by pair of ids: ``a``, ``b``, ``n``."""
    partial = ids.select("a", "b").mapInArrow(_partial(one, two), "a int, b int, n bigint")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _store(folder: str):
    def store(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b, n = (rows[c].to_numpy() for c in ("a", "b", "n"))
        pair = _pair(a, b)
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.diff(pair >> 32, prepend=-1))
        highest = np.maximum.reduceat(n, first)
        best = n == np.repeat(highest, np.diff(np.append(first, len(n))))
        shard = key[0].as_py()
        return pa.table(
            {
                "shard": pa.array([shard], pa.int32()),
                "pairs": [save(own_file(folder, f"pairs-{shard}", "npy"), pair)],
                # The sign tells whether the count is the highest of its second id.
                "counts": [save(own_file(folder, f"counts-{shard}", "npy"), np.where(best, n, -n))],
            }
        )

    return store


@dataclass
class Counts:
    """Counts by pair in files of sorted arrays; a second id lies in one file."""

    pairs: list[str | None]
    counts: list[str | None]

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Signed counts of pairs that occur."""
        out = np.zeros(len(a), np.int64)
        shard = b % len(self.pairs)
        for number in np.unique(shard).tolist():
            own = np.flatnonzero(shard == number)
            place = np.searchsorted(mapped(self.pairs[number]), _pair(a[own], b[own]))
            out[own] = mapped(self.counts[number])[place]
        return out


def stored_counts(pairs: DataFrame) -> Counts:
    """Write counts by pair into files; a group is one shard of second ids, some ``SHARD_PAIRS``."""
    held = written(pairs, "align-pairs")
    shards = max(1, math.ceil(held.count() / SHARD_PAIRS))
    folder = scratch(held.sparkSession, "align-counts")
    files = held.withColumn("shard", F.pmod("b", F.lit(shards)).cast("int")).groupBy("shard")
    rows = files.applyInArrow(_store(folder), "shard int, pairs string, counts string").collect()
    named = {r.shard: r for r in rows}
    return Counts(
        [named[i].pairs if i in named else None for i in range(shards)],
        [named[i].counts if i in named else None for i in range(shards)],
    )


def _figures(one: str, two: str, counts: Counts):
    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(one, two)
        for batch in batches:
            for part, a, b in known.slices(batch):
                rows, met = part.num_rows, known.joined(a, b)
                doc = met.links["doc"].to_numpy()
                count = counts.look_up(met.links["a"].to_numpy(), met.links["b"].to_numpy())
                both = met.links["both"].to_numpy()
                sums = np.concatenate([[0], np.cumsum(np.abs(count))])
                upto = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pc.list_value_length(a).cast(pa.int64()),
                        pc.list_value_length(b).cast(pa.int64()),
                        pa.array(np.bincount(doc[both], minlength=rows)),
                        pa.array(np.diff(upto)),
                        pa.array(np.bincount(doc[count > 0], minlength=rows)),
                        pa.array(np.diff(sums[upto])),
                        group_texts(rows, met),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
                )

    return figures


def aligned(
    docs: DataFrame,
    one: str = BYTE_TOKENIZER,
    two: str = PIECE_TOKENIZER,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document the groups in which its two tokenisations agree, and figures of its links.

    Result: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is
    as frequent as any of its second id, ties included), ``count_sum`` (the pairs' counts over the
    links) and ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of each group in order).

    Every row gives a row, repeated ones and null ids too, and repeated texts count as often as they
    occur. Null and empty texts, and those that either tokenizer does not give back byte for byte,
    have no tokens: zeros and empty groups. Texts are whole, other columns are not read, and an
    empty table gives no rows.
    """
    ids = encoded(docs, one, two, key, text)
    counts = stored_counts(pair_counts(ids, one, two))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(
        _figures(one, two, counts),
        f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint,"
        " count_sum bigint, groups string",
    )
