"""Removal of repeated byte strings, by the common-prefix interval tree of a suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Suffixes of the
whole corpus never meet in one place; four steps bring together only those that can matter:

1. Whole copies of an earlier text are known by their digests.
2. Every other text is cut into segments: runs of windows of ``length`` bytes that share their least
   ``ANCHOR``-byte gram, the anchor. Equal windows have equal anchors wherever they stand. Segments
   are compared by digest; all but the first of equal ones are repeated as a whole.
3. First segments whose anchor has other contents too are read from the texts. Those of one anchor
   meet in one bucket, where an enhanced suffix array is built over them. One stack scan finds the
   intervals of common prefixes; those whose occurrences differ in the byte before are the maximal
   repeats. In each interval every occurrence but the earliest loses, once, at its longest match.
   An anchor with more contents than a bucket should hold (a passage that very many texts share, in
   different surroundings) is settled by the digests of its windows instead, spread over all tasks.
4. The covered places of a document are merged and cut out of its text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import small, written

LENGTH = 100
ANCHOR = 48
# Bytes of segments whose suffixes are sorted together.
BUCKET_BYTES = 1 << 18
# Bytes of different contents from which on an anchor is crowded: its windows are compared by digest.
CROWDED_BYTES = BUCKET_BYTES // 2
# Text bytes that are cut into segments at a time.
CUT_BYTES = 2 << 20
# Rows of a helper table that are still sent to every executor.
BROADCAST_ROWS = 1_500_000
# Long texts are cut into segments block by block.
BLOCK = 1 << 20
# The id that a null stands for: it comes last.
LAST_ID = (1 << 63) - 1

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base modulo 2**64, and their inverses."""
    if _powers.get("size", (0,))[0] < size:
        room = 1 << max(16, size.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(room, _U(base))
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=_U)
        _powers["size"] = np.array([room])
    return _powers["up"], _powers["down"]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours by doubling."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(text: bytes, length: int, anchor: int):
    """Segments of a text: anchor, digest of the content, first window, windows, repeats inside.

    ``repeats inside`` is set where the anchor stands at two places of one segment, as only then a
    window can be equal to another window of the same segment.
    """
    out = []
    width = length - anchor + 1
    for at in range(0, max(len(text) - length + 1, 0), BLOCK):
        block = np.frombuffer(text[at : at + BLOCK + length - 1], np.uint8).astype(_U)
        n = len(block)
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum((block + _U(1)) * power[:n], out=sums[1:])
        grams = _mix((sums[anchor:] - sums[:-anchor]) * inverse[: n - anchor + 1])
        least = _sliding_min(grams, width)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        start = np.concatenate([[0], cut])
        count = np.diff(np.concatenate([start, [len(least)]]))
        end = start + count + length - 1
        content = _mix((sums[end] - sums[start]) * inverse[start] + count.astype(_U) * _M1)
        # Places of grams that are the least of some window around them.
        around = ~_sliding_min(~np.pad(least, width - 1, mode="edge"), width)
        places = np.flatnonzero(grams == around)
        # Count them by value and place, to find segments in which their own gram stands twice.
        kinds, kind = np.unique(grams[places], return_inverse=True)
        sorted_places = np.sort((kind << 32) | places)
        own = np.searchsorted(kinds, least[start]) << 32
        found = np.searchsorted(sorted_places, own | (start + count + width - 1)) - np.searchsorted(
            sorted_places, own | start
        )
        inside = found > 1
        out.append((least[start], content, start + at, count, inside))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none.astype(_U), none, none, none.astype(bool)
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _bodies(column: pa.Array) -> list[bytes]:
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


_ROWS = "anchor bigint, content bigint, doc bigint, tie bigint, place bigint, state int"
_UNIQUE, _GONE = 0, 1  # states; from 2 on: needs its text even when alone


def _runs(
    batch: pa.RecordBatch, name: str = "text", most: int = CUT_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of a batch with some ``most`` bytes of the named column at a time."""
    raw = batch.column(name).cast(pa.binary())
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(raw), 0).to_pylist()):
        size += n
        if size >= most or i + 1 == len(raw):
            part = batch.slice(begin, i + 1 - begin)
            yield part, _bodies(part.column(name))
            begin, size = i + 1, 0


def _cut(length: int, anchor: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in _runs(batch):
                found = _segments_of(part, bodies, length, anchor)
                if found is not None:
                    yield found

    return cut


def _segments_of(batch: pa.RecordBatch, bodies: list[bytes], length: int, anchor: int):
    docs = batch.column("doc").to_numpy()
    ties = batch.column("tie").to_numpy()
    parts = []
    for doc, tie, body in zip(docs, ties, bodies, strict=True):
        anchors, contents, start, count, inside = segments(body, length, anchor)
        if len(start):
            place = (start << 32) | count
            parts.append((anchors, contents, np.full(len(start), doc), np.full(len(start), tie), place, inside))
    if not parts:
        return None
    anchors, contents, doc, tie, place, inside = (np.concatenate(p) for p in zip(*parts, strict=True))
    state = np.where(inside, 2, _UNIQUE).astype(np.int32)
    # Equal segments of one run: all but the first are settled here, so a crowded one reaches its
    # group once per run. Settled rows travel under keys of their own.
    gone = _later((anchors, contents), (doc, tie, place))
    state[gone] = _GONE
    anchors[gone] = _mix(doc[gone].view(_U) * _M2 + place[gone].view(_U))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchors.view(np.int64)),
            pa.array(contents.view(np.int64)),
            pa.array(doc),
            pa.array(tie),
            pa.array(place),
            pa.array(state),
        ],
        ["anchor", "content", "doc", "tie", "place", "state"],
    )


def _later(key: tuple[np.ndarray, np.ndarray], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows whose two-part key an earlier row has; rows that agree in all columns are one."""
    both = key[0] ^ _mix(key[1])
    by_key = np.argsort(both, kind="stable")
    same = both[by_key][1:] == both[by_key][:-1]
    crowd = by_key[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(crowd):
        return crowd
    crowd = crowd[np.lexsort((*[c[crowd] for c in order[::-1]], key[1][crowd], key[0][crowd]))]
    again = (key[0][crowd][1:] == key[0][crowd][:-1]) & (key[1][crowd][1:] == key[1][crowd][:-1])
    head = np.maximum.accumulate(np.where(np.concatenate([[False], again]), 0, np.arange(len(crowd))))
    lead = crowd[head]
    return crowd[np.any([c[lead] != c[crowd] for c in order], axis=0)]


def settled(rows: DataFrame) -> DataFrame:
    """Rows that matter: ``whole`` (repeated as a whole) or to be compared by their texts."""
    first = Window.partitionBy("anchor", "content").orderBy("doc", "tie", "place")
    group = Window.partitionBy("anchor")
    judged = (
        rows.withColumn("nth", F.dense_rank().over(first))
        .withColumn("few", F.min("content").over(group))
        .withColumn("many", F.max("content").over(group))
    )
    whole = (F.col("state") == _GONE) | (F.col("nth") > 1)
    return judged.where(whole | (F.col("few") != F.col("many")) | (F.col("state") > _GONE)).select(
        "anchor",
        "doc",
        "tie",
        F.shiftright("place", 32).cast("int").alias("start"),
        F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("count"),
        whole.alias("whole"),
    )


# The enhanced suffix array ------------------------------------------------------------------


class Suffixes:
    """Sorted suffixes of several contents, with the common prefixes of neighbours.

    A suffix ends with its content. Ranks by the first 7, 14, 28 ... bytes come from prefix
    doubling and are kept, so the common prefix of two suffixes takes one step per level.
    """

    def __init__(self, contents: list[bytes], least: int):
        sizes = np.array([len(c) for c in contents])
        self.firsts = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"".join(contents), np.uint8).astype(np.int16) + 1
        n = len(symbols)
        self.symbols = symbols
        self.owner = np.repeat(np.arange(len(contents)), sizes)
        self.left = (self.firsts + sizes)[self.owner] - np.arange(n)  # bytes up to the end
        key = np.zeros(n, np.int64)
        padded = np.concatenate([symbols, np.zeros(7, np.int16)])
        for i in range(7):
            key = key * 257 + np.where(self.left > i, padded[i : n + i], 0)
        self.levels: list[tuple[int, np.ndarray]] = []
        reach = 7
        order, rank = self._ranked(key)
        self.levels.append((reach, rank))
        while reach < sizes.max(initial=0) and rank.max(initial=0) < n - 1:
            ahead = np.minimum(np.arange(n) + reach, n - 1)
            key = rank.astype(np.int64) * (n + 1) + np.where(self.left > reach, rank[ahead] + 1, 0)
            order, rank = self._ranked(key)
            reach *= 2
            self.levels.append((reach, rank))
        # Only suffixes that hold a whole window can repeat one.
        self.order = order[self.left[order] >= least]
        self.common = self._common(self.order[:-1], self.order[1:])

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        rank = np.empty(len(key), np.int32)
        if len(key):
            rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        return order, rank

    def _common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        most = np.minimum(self.left[one], self.left[two])
        got = np.zeros(len(one), np.int64)
        last = len(self.symbols) - 1
        for reach, rank in reversed(self.levels):
            a, b = np.minimum(one + got, last), np.minimum(two + got, last)
            got += np.where((got < most) & (rank[a] == rank[b]), reach, 0)
        for _ in range(6):
            a, b = np.minimum(one + got, last), np.minimum(two + got, last)
            got += (got < most) & (self.symbols[a] == self.symbols[b])
        return np.minimum(got, most)

    def before(self, places: np.ndarray) -> np.ndarray:
        """The byte before a place, 0 at the start of a content."""
        previous = self.symbols[np.maximum(places - 1, 0)]
        return np.where(places == self.firsts[self.owner[places]], 0, previous)


def repeat_scan(suffixes: Suffixes, least: int, age: np.ndarray):
    """Stack scan over the intervals of common prefixes of ``least`` bytes or more.

    ``age`` orders the places. Returns the maximal repeats as (length, from, to) ranges of the
    suffix array, and for every place with an earlier equal the place and its longest such match.
    """
    order, common = suffixes.order, suffixes.common
    joined = np.concatenate([common >= least, [False]])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], joined]).astype(np.int8)))
    groups: list[tuple[int, int, int]] = []
    places: list[int] = []
    matches: list[int] = []
    for begin, stop in zip(edges[::2], edges[1::2], strict=True):
        run = order[begin : stop + 1]
        before = suffixes.before(run)
        low = before.min()
        if low > 0 and low == before.max():
            # The same byte stands before all: a longer repeat, one place to the left, holds this.
            continue
        ages, lengths = age[run].tolist(), common[begin:stop].tolist()
        run_list, before_list = run.tolist(), before.tolist()
        # Open intervals: length, first index, earliest member, byte before (-1: they differ).
        stack = [[0, 0, -1, -2]]

        def lose(length, one, two):
            early, late = (one, two) if ages[one] < ages[two] else (two, one)
            places.append(run_list[late])
            matches.append(length)
            return early

        def merged(one, two):
            return one if one == two and one > 0 else -1

        best, byte, index = 0, before_list[0], 0
        for i, length in enumerate([*lengths, 0]):
            # The suffix at i is (best, byte), alone; close the intervals that end with it.
            best, byte, index = i, before_list[i], i
            while stack[-1][0] > length:
                reach, first, early, seen = stack.pop()
                best = lose(reach, early, best)
                byte = merged(seen, byte)
                index = first
                if byte < 0:
                    groups.append((reach, int(begin) + first, int(begin) + i + 1))
            if length == 0:
                break
            if stack[-1][0] == length:
                top = stack[-1]
                top[2] = lose(length, top[2], best)
                top[3] = merged(top[3], byte)
            else:
                stack.append([length, index, best, byte if byte > 0 else -1])
    return groups, np.array(places, np.int64), np.array(matches, np.int64)


_CONTENTS = "anchor bigint, doc bigint, tie bigint, start int, body binary"
_SPANS = "doc bigint, tie bigint, start int, stop int"
_SPAN_TYPES = pa.schema(
    [("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]
)


def _grouped(rows: pa.Table) -> pa.Table:
    """The contents of a bucket by age; a segment that was read more than once is one."""
    order = [("doc", "ascending"), ("tie", "ascending"), ("start", "ascending")]
    table = rows.sort_by(order)
    columns = [table.column(name).to_numpy() for name, _ in order]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return table.filter(pa.array(new))


def _window_digests(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of each content: the content, the window's digest and its place there."""
    sizes = np.array([len(b) for b in bodies])
    whole = np.frombuffer(b"".join(bodies), np.uint8).astype(_U) + _U(1)
    n = len(whole)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(whole * power[:n], out=sums[1:])
    firsts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bodies)), sizes - length + 1)
    windows = np.arange(len(owner)) + owner * (length - 1)  # places of windows in the whole
    digest = _mix((sums[windows + length] - sums[windows]) * inverse[windows])
    return owner, digest, windows - firsts[owner]


def _repeating_parts(bodies: list[bytes], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The parts of contents that hold windows found twice in the bucket, by window digests.

    Returns the parts, the contents they come from and where they start in them. Windows outside
    the parts are found once only, so no repeat can reach beyond a part.
    """
    owner, digest, offset = _window_digests(bodies, length)
    ordered = np.sort(digest)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return [], owner[:0], owner[:0]
    at = np.minimum(np.searchsorted(twice, digest), len(twice) - 1)
    repeated = np.flatnonzero(twice[at] == digest)
    owner, places = owner[repeated], offset[repeated]
    # One part from the first to the last such window of a content.
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    end = np.concatenate([begin[1:], [len(owner)]]) - 1
    owner = owner[begin]
    start, stop = places[begin], places[end] + length
    parts = [bodies[k][a:b] for k, a, b in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True)]
    return parts, owner, start


def _covered(length: int):
    def covered(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        table = _grouped(rows)
        parts, source, start = _repeating_parts(table.column("body").to_pylist(), length)
        if not parts:
            return pa.table({"doc": [], "tie": [], "start": [], "stop": []}).cast(_SPAN_TYPES)
        suffixes = Suffixes(parts, length)
        # Contents are in order of age, so a smaller place is an earlier one.
        _, places, matches = repeat_scan(suffixes, length, np.arange(len(suffixes.symbols)))
        change = np.zeros(len(suffixes.symbols) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + matches, -1)
        inside = np.cumsum(change[:-1]) > 0
        # Parts lie side by side: a covered run ends with its part.
        first_of_part = np.zeros(len(inside), bool)
        first_of_part[suffixes.firsts] = True
        begin = np.flatnonzero(inside & (first_of_part | ~np.concatenate([[False], inside[:-1]])))
        last_of_part = np.concatenate([first_of_part[1:], [True]])
        end = np.flatnonzero(inside & (last_of_part | ~np.concatenate([inside[1:], [False]])))
        part = suffixes.owner[begin]
        row = source[part]
        offset = table.column("start").to_numpy()[row] + start[part] - suffixes.firsts[part]
        return pa.table(
            {
                "doc": table.column("doc").to_numpy()[row],
                "tie": table.column("tie").to_numpy()[row],
                "start": begin + offset,
                "stop": end + 1 + offset,
            }
        ).cast(_SPAN_TYPES)

    return covered


_PARTS = "anchor bigint, doc bigint, tie bigint, start int, stop int, twice boolean, body binary"
_WINDOWS = "anchor bigint, window bigint, doc bigint, tie bigint, start int, stop int, gone boolean"


def _finer(length: int, anchor: int):
    """Contents cut again by longer anchors; a part with an earlier equal in its run has no body.

    A window that is found twice lies in parts of one longer anchor, and few parts share theirs.
    """

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in (run for batch in batches for run in _runs(batch, "body", BUCKET_BYTES)):
            found = [segments(body, length, anchor) for body in bodies]
            row = np.repeat(np.arange(len(bodies)), [len(f[0]) for f in found])
            anchors, contents, first, count, twice = (np.concatenate(f) for f in zip(*found, strict=True))
            doc, tie, start = (batch.column(c).to_numpy()[row] for c in ("doc", "tie", "start"))
            start, size = start + first, count + length - 1
            gone = np.zeros(len(row), bool)
            gone[_later((anchors, contents), (doc, tie, start))] = True
            parts = [
                None if g else bodies[k][at : at + n]
                for k, at, n, g in zip(row.tolist(), first.tolist(), size.tolist(), gone.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors.view(np.int64)),
                    pa.array(doc),
                    pa.array(tie),
                    pa.array(start.astype(np.int32)),
                    pa.array((start + size).astype(np.int32)),
                    pa.array(twice),
                    pa.array(parts, pa.binary()),
                ],
                ["anchor", "doc", "tie", "start", "stop", "twice", "body"],
            )

    return finer


def _windows(length: int):
    """Digests of all windows of contents. Neighbours with earlier equals in the run are one row."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in (run for batch in batches for run in _runs(batch, "body", BUCKET_BYTES)):
            row, digest, offset = _window_digests(bodies, length)
            anchor, doc, tie, start = (part.column(c).to_numpy()[row] for c in ("anchor", "doc", "tie", "start"))
            start = start + offset
            gone = np.zeros(len(row), bool)
            gone[_later((anchor.view(_U), digest), (doc, tie, start))] = True
            joined = gone[1:] & gone[:-1] & (row[1:] == row[:-1])
            first = np.flatnonzero(np.concatenate([[True], ~joined]))
            last = np.concatenate([first[1:] - 1, [len(row) - 1]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[first]),
                    pa.array(digest[first].view(np.int64)),
                    pa.array(doc[first]),
                    pa.array(tie[first]),
                    pa.array(start[first].astype(np.int32)),
                    pa.array((start[last] + length).astype(np.int32)),
                    pa.array(gone[first]),
                ],
                ["anchor", "window", "doc", "tie", "start", "stop", "gone"],
            )

    return windows


def crowded_spans(contents: DataFrame, length: int) -> DataFrame:
    """Spans of contents of crowded anchors: every window but the earliest of its kind goes.

    The contents are cut again by anchors longer by three quarters of what a window has beside its
    anchor; parts that share theirs are compared window by window, grouped by anchor and digest. So
    an anchor's contents never meet in one task, and what many contents share reaches its group once
    per run.
    """
    longer = length - (length - ANCHOR) // 4 if length > ANCHOR + 4 else length
    parts = written(contents.mapInArrow(_finer(length, longer), _PARTS), "repeat-finer")
    anchors = parts.where("body IS NOT NULL").groupBy("anchor")
    shared = written(
        anchors.agg(F.count("doc").alias("parts"), F.max("twice").alias("twice"))
        .where("parts > 1 OR twice")
        .select("anchor"),
        "repeat-finer-shared",
    )
    rest = parts.where("body IS NOT NULL").join(small(shared, BROADCAST_ROWS), "anchor", "left_semi")
    windows = written(rest.select("anchor", "doc", "tie", "start", "body").mapInArrow(_windows(length), _WINDOWS), "repeat-windows")
    place = F.struct("doc", "tie", "start")
    first = (
        windows.where("NOT gone")
        .groupBy("anchor", "window")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .drop("last")
    )
    later = windows.where("NOT gone").join(first, ["anchor", "window"]).where(place != F.col("first"))
    columns = ["doc", "tie", "start", "stop"]
    return (
        parts.where("body IS NULL")
        .select(*columns)
        .unionByName(windows.where("gone").select(*columns))
        .unionByName(later.select(*columns))
    )


def _bodies_of_segments(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in (run for batch in batches for run in _runs(batch)):
            out = []
            columns = (part.column(c).to_pylist() for c in ("doc", "tie", "parts"))
            for doc, tie, parts, body in zip(*columns, bodies, strict=True):
                out += [
                    (p["anchor"], doc, tie, p["start"], body[p["start"] : p["start"] + p["count"] + length - 1])
                    for p in parts
                ]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                ["anchor", "doc", "tie", "start", "body"],
            )

    return cut


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the spans of each document."""
    for batch in batches:
        spans = []
        for pairs in batch.column("spans").to_pylist():
            out: list[list[int]] = []
            for pair in sorted((p["start"], p["stop"]) for p in pairs):
                if out and pair[0] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], pair[1])
                else:
                    out.append(list(pair))
            spans.append([{"start": a, "stop": b} for a, b in out])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tie"), pa.array(spans, kind)], ["doc", "tie", "spans"]
        )


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with the digest that tells documents of one id apart, and their sizes."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("n", F.octet_length("text").cast("int"))


def removed_spans(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Documents keyed by ``doc, tie``, and the merged spans of bytes that go: ``doc, tie, spans``.

    Null texts are empty; null ids come last; rows that share id and text are one document, and
    texts that share an id are ordered by digest.
    """
    rows = _keyed(docs, key, text)
    known = written(rows.select("doc", "n", F.md5("text").alias("digest")).distinct(), "repeat-docs")
    tied = not known.groupBy("doc").count().where("count > 1").isEmpty()
    tie = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long") if tied else F.lit(0)
    rows = rows.withColumn("tie", tie.cast("long"))
    long_ones = known.where(F.col("n") >= length).withColumn(
        "tie",
        (F.conv(F.substring("digest", 1, 15), 16, 10) if tied else F.lit(0)).cast("long"),
    )
    firsts = long_ones.groupBy("digest").agg(
        F.min(F.struct("doc", "tie")).alias("first"), F.count("doc").alias("copies")
    )
    firsts = written(firsts.where("copies > 1").select("digest", "first"), "repeat-firsts")
    copies = long_ones.join(small(firsts, BROADCAST_ROWS), "digest").where(
        F.struct("doc", "tie") != F.col("first")
    )
    copies = written(copies.select("doc", "tie", "n"), "repeat-copies")
    single = rows.where(F.col("n") >= length).join(
        small(copies.drop("n"), BROADCAST_ROWS), ["doc", "tie"], "left_anti"
    )
    cut = single.select("doc", "tie", "text").mapInArrow(_cut(length, anchor), _ROWS)
    marks = written(settled(cut), "repeat-marks")

    size = F.col("count") + length - 1
    every = marks.where("NOT whole")
    crowded = written(
        every.groupBy("anchor").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > CROWDED_BYTES).select("anchor"),
        "repeat-crowded",
    )
    hot = not crowded.isEmpty()
    open_parts = every.join(small(crowded, BROADCAST_ROWS), "anchor", "left_anti") if hot else every

    def contents_of(chosen: DataFrame, rows_most: int) -> DataFrame:
        parts = written(
            chosen.groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("parts")),
            "repeat-parts",
        )
        hint = F.broadcast(parts) if rows_most <= BROADCAST_ROWS else parts
        return (
            single.select("doc", "tie", "text")
            .join(hint, ["doc", "tie"])
            .mapInArrow(_bodies_of_segments(length), _CONTENTS)
        )

    open_bytes = open_parts.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("doc").alias("rows")
    ).first()
    buckets = max(1, math.ceil(open_bytes["bytes"] / BUCKET_BYTES))
    contents = contents_of(open_parts, open_bytes["rows"]).withColumn(
        "bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int")
    )
    # The same anchor only: others of the bucket differ in their anchors, hence in every window.
    found = contents.groupBy("bucket").applyInArrow(_covered(length), _SPANS)
    if hot:
        theirs = every.join(small(crowded, BROADCAST_ROWS), "anchor", "left_semi")
        found = found.unionByName(crowded_spans(contents_of(theirs, theirs.count()), length))
    spans = (
        marks.where("whole")
        .select("doc", "tie", "start", (F.col("start") + F.col("count") + length - 1).alias("stop"))
        .unionByName(found)
        .unionByName(copies.select("doc", "tie", F.lit(0).alias("start"), F.col("n").alias("stop")))
    )
    gathered = spans.groupBy("doc", "tie").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")
    )
    merged = gathered.mapInArrow(
        _merged, "doc bigint, tie bigint, spans array<struct<start:int,stop:int>>"
    )
    return rows, written(merged, "repeat-spans")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, bodies in (run for batch in batches for run in _runs(batch)):
        rows = []
        for body, spans in zip(bodies, part.column("spans").to_pylist(), strict=True):
            kept, at = hashlib.sha256(), 0
            for span in spans or ():
                kept.update(body[at : span["start"]])
                at = span["stop"]
            kept.update(body[at:])
            gone = sum(s["stop"] - s["start"] for s in spans or ())
            rows.append((len(body), gone, len(spans or ()), kept.hexdigest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def kept_bytes(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its size, bytes and spans removed, and the digest of what is kept.

    Every row gives a row; rows that share id and text share their figures; texts shorter than
    ``length`` bytes, empty and null ones lose nothing; an empty table gives no rows.
    """
    rows, spans = removed_spans(docs, length, key=key, text=text)
    total = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    hint = F.broadcast(spans) if total <= BROADCAST_ROWS else spans
    joined = rows.join(hint, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        _digested,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    )
