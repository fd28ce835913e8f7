"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but 16-bit token ids; a document ends with the end-of-document id. Files are
cut into blocks of equal size, each block is searched for that id with one vectorised comparison,
and a prefix scan over the blocks' summaries (separators, place of the last one) stitches documents
that cross block boundaries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import scratch, written
from nearfield.llm.files import output, own_file, read_range

# A public byte-level vocabulary of 50,256 entries; the next id is free and ends documents.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256
# Fixed value: the published split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Tokens of one block.
BLOCK = 1 << 20
# Blocks whose summaries are scanned together; their totals are scanned above them.
SPAN = 4096

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _encoders[path] = tiktoken.Encoding(
            "flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encoders[path]


def write_token_files(
    docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text"
) -> tuple[str, DataFrame]:
    """Tokenise documents into flat files, one per task: the folder, and where documents went.

    The second result has ``file`` (name), ``nth`` (place among the file's documents) and
    ``doc_id``. Strings that look like special tokens are ordinary text; null texts are empty.
    """
    folder = scratch(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        encode = encoder(tokenizer).encode_ordinary
        path = own_file(folder, "part", "bin")
        nth = 0
        done = []
        with output(path) as stream:
            batch = first
            while batch is not None:
                for value in batch.column("text").to_pylist():
                    stream.write(np.array([*encode(value or ""), END], "<u2").tobytes())
                done.append((nth, batch.column("doc_id")))
                nth += batch.num_rows
                batch = next(batches, None)
        name = path.rsplit("/", 1)[1]
        for start, ids in done:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(ids), pa.string()),
                    pa.array(np.arange(start, start + len(ids))),
                    ids,
                ],
                ["file", "nth", "doc_id"],
            )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = written(rows.mapInArrow(write, f"file string, nth bigint, doc_id {kind}"), "token-places")
    return folder, placed


def _scan(end: int, block: int):
    """Places of the separators of a block; what follows a file's last one is a document too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, length in zip(
                *(batch.column(c).to_pylist() for c in ("path", "block", "length")), strict=True
            ):
                tokens = np.frombuffer(read_range(path, 2 * number * block, 2 * block), "<u2")
                ends = np.flatnonzero(tokens == end).astype(np.int64) + number * block
                total = length // 2
                if number * block + len(tokens) == total and tokens[-1] != end:
                    ends = np.append(ends, total)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]),
                        pa.array([number], pa.int64()),
                        pa.array([len(ends)], pa.int64()),
                        pa.array([int(ends[-1]) if len(ends) else None], pa.int64()),
                        pa.array([ends], pa.list_(pa.int64())),
                    ],
                    ["path", "block", "n", "last", "ends"],
                )

    return scan


def _exclusive(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per row the separators before it and the place of the last of them, inside ``keys``."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "carried", F.max("last").over(before)
    )


def count_tokens(
    spark: SparkSession, folder: str, end: int = END, block: int = BLOCK, span: int = SPAN
) -> DataFrame:
    """Documents of the flat files in a folder: ``file``, ``nth``, ``start``, ``n_tokens``.

    Separators are no tokens of a document; two in a row enclose an empty document; tokens behind
    the last separator are a document; an empty file has none.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bin")
        .load(folder)
        .select("path", "length")
        .where("length > 1")
    )
    blocks = files.select(
        "path",
        "length",
        F.explode(
            F.sequence(F.lit(0), F.floor((F.floor(F.col("length") / 2) - 1) / block).cast("int"))
        ).alias("block"),
    )
    # Blocks of one large file are spread over all tasks.
    spread = blocks.withColumn("block", F.col("block").cast("long")).repartition("path", "block")
    found = written(
        spread.mapInArrow(
            _scan(end, block), "path string, block bigint, n bigint, last bigint, ends array<bigint>"
        ),
        "token-blocks",
    )
    summaries = found.select("path", "block", "n", "last", F.floor(F.col("block") / span).alias("span"))
    spans = _exclusive(
        summaries.groupBy("path", "span").agg(F.sum("n").alias("n"), F.max("last").alias("last")),
        ["path"],
        "span",
    ).select("path", "span", F.col("seen").alias("seen_above"), F.col("carried").alias("carried_above"))
    stitched = (
        _exclusive(summaries, ["path", "span"], "block")
        .join(spans, ["path", "span"])
        .select(
            "path",
            "block",
            (F.col("seen") + F.col("seen_above")).alias("before"),
            F.coalesce("carried", "carried_above", F.lit(-1)).alias("carry"),
        )
    )
    # A document starts behind the separator before it, which may be blocks away.
    documents = F.transform(
        "ends",
        lambda stop, i: F.struct(
            (F.coalesce(F.get("ends", i - 1), F.col("carry")) + 1).alias("start"),
            stop.alias("stop"),
        ),
    )
    return (
        found.select("path", "block", "ends")
        .join(stitched, ["path", "block"])
        .select("path", "before", F.posexplode(documents).alias("pos", "doc"))
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file"),
            (F.col("before") + F.col("pos")).alias("nth"),
            "doc.start",
            "doc.stop",
        )
        .select("file", "nth", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))
    )


def document_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts per document, read back from its flat file: ``doc_id``, ``n_tokens``.

    Every row gives a row, repeated ones too; null and empty texts have no tokens; an empty table
    gives no rows.
    """
    folder, placed = write_token_files(docs, tokenizer)
    if placed.isEmpty():
        return placed.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counted = count_tokens(docs.sparkSession, folder)
    # Files of repeated task attempts have no places.
    return placed.join(counted, ["file", "nth"]).select("doc_id", "n_tokens")
