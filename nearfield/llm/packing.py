"""Packing of documents into sequences of fixed length: concatenate and cut.

Pass one encodes every document once, writes the ids and keeps a running total inside each
partition. A prefix sum over the partitions' totals gives every document its place in the endless
row of all ids. Pass two cuts that row at the multiples of the sequence length: a document lies in
one window or, with a boundary record on each side, in several. Nothing is shuffled by document, and
all sequences but the last are full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import small, written
from nearfield.llm.vocab import FOLDER, decoded, text_chunks, word_stretches

TOKENIZER = f"{FOLDER}/word_bpe_49k.json"
# The id behind every document, and the length of a sequence.
END = 2
LENGTH = 4096
# Partitions whose offsets are still sent to every executor (16 bytes each).
BROADCAST_PARTITIONS = 1_000_000


def _encode(tokenizer: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = word_stretches(tokenizer)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, bodies in text_chunks(batch.column("text")):
                (rows,), _ = stretches.texts(decoded(bodies))
                ids = np.insert(rows.ids, rows.bounds[1:], end).astype("<u4")
                bounds = rows.bounds + np.arange(b - a + 1)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.full(b - a, part, np.int32)),
                        pa.array(before + bounds[:-1]),
                        pa.array(n),
                        pa.Array.from_buffers(
                            pa.binary(),
                            b - a,
                            [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(ids)],
                        ),
                    ],
                    ["doc_id", "part", "before", "n", "ids"],
                )
                before += int(bounds[-1])

    return encode


def encoded(
    docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents as ids, written: ``doc_id``, ``ids`` (32-bit little-endian), ``n``, place in its ``part``."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(
        rows.mapInArrow(
            _encode(tokenizer, end), f"doc_id {kind}, part int, before bigint, n bigint, ids binary"
        ),
        "pack-ids",
    )


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            place = batch.column("place").to_numpy()
            column = batch.column("ids")
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(n) + 1]
            first, last = place // length, (place + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + nth
            start = np.maximum(sequence * length, place[row]) - place[row]
            stop = np.minimum((sequence + 1) * length - place[row], n[row])
            # Pieces lie side by side in the ids, document after document.
            edges = np.append(bounds[row].astype(np.int64) + 4 * start, bounds[-1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(start),
                    pa.array(stop - start),
                    pa.array(n[row]),
                    pa.array(sequence),
                    pa.array(place[row] + start - sequence * length),
                    pa.Array.from_buffers(
                        pa.binary(), len(row), [None, pa.py_buffer(edges), column.buffers()[2]]
                    ),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return cut


def packed(
    docs: DataFrame,
    length: int = LENGTH,
    tokenizer: str = TOKENIZER,
    end: int = END,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids.

    Result: ``doc_id``, ``start`` (ids of the document before the piece), ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` (ids of the sequence before it) and ``ids`` (32-bit
    little-endian). A null or empty text is the end id alone; every row is a document, repeated ones
    and null ids too; a long text fills as many sequences as it needs; other columns are not read;
    an empty table gives no rows. Which sequence a document lies in depends on the input partitions.
    """
    rows = encoded(docs, tokenizer, end, key, text)
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    bases = written(bases, "pack-parts")
    placed = rows.join(small(bases, BROADCAST_PARTITIONS), "part").select(
        "doc_id", "n", (F.col("base") + F.col("before")).alias("place"), "ids"
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(
        _cut(length),
        f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint,"
        " offset bigint, ids binary",
    )


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_tokens`` and ``ids``.

    A sequence is padded to ``length`` ids, unless the number of its ids is a power of two. A group
    holds ``length`` ids at most.
    """
    joined = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"),
    )
    digits = F.array_join(F.transform("parts", lambda p: p["ids"]), "")
    n = F.col("n_tokens")
    missing = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(length) - n).cast("int")
    filler = pad.to_bytes(4, "little").hex()
    return joined.select(
        "sequence_id", "n_tokens", F.unhex(F.concat(digits, F.repeat(F.lit(filler), missing))).alias("ids")
    )
