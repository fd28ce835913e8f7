"""Encoders as batch functions, and the registry that names them.

An encoder is built once per Python worker and sees Arrow batches. Checkpoints are not part of
this package: ``register_encoder`` is the place to plug one in.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfield.schema import VECTOR, require_columns


class Encoder(Protocol):
    name: str

    def build(self) -> None: ...

    def encode_batch(
        self, texts: pa.Array | None = None, images: pa.Array | None = None
    ) -> np.ndarray:
        """(n, dim) float32 for one column of inputs."""


def one_input(texts: Any, images: Any) -> Any:
    """Encoders take texts or images: exactly one of them."""
    if (texts is None) == (images is None):
        raise ValueError("Provide either texts or images")
    return texts if images is None else images


class HashEncoder:
    """Signed token hashing: a deterministic stand-in where no checkpoint is available.

    Lower-cased words (or the 64-byte blocks of an image) vote +1 or -1 in one of ``dim``
    buckets, both taken from the digest of the word.
    """

    def __init__(self, dim: int = 64, normalize: bool = True, name: str = "hash"):
        if dim <= 0:
            raise ValueError("dim must be a positive integer")
        self.dim, self.normalize, self.name = int(dim), bool(normalize), name

    def build(self) -> None:
        """Nothing to load."""

    def _tokens(self, values: pa.Array) -> pa.ListArray:
        if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
            blocks = [
                [] if v is None else [v[i : i + 64] for i in range(0, len(v), 64)]
                for v in values.to_pylist()
            ]
            return pa.array(blocks, pa.list_(pa.binary()))
        return pc.ascii_split_whitespace(pc.utf8_lower(values.fill_null("")))

    def _votes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and sign of each distinct word; empty words do not vote."""
        raw = words.cast(pa.binary()).to_pylist()
        digests = b"".join([hashlib.md5(w).digest() for w in raw])
        parts = np.frombuffer(digests, np.uint8).reshape(-1, 16)
        bucket = np.ascontiguousarray(parts[:, :4]).view(">u4")[:, 0].astype(np.int64) % self.dim
        sign = np.where(parts[:, 4] < 128, 1.0, -1.0)
        sign[[i for i, w in enumerate(raw) if not w]] = 0.0
        return bucket, sign

    def encode_batch(self, texts=None, images=None) -> np.ndarray:
        tokens = self._tokens(one_input(texts, images))
        rows = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        out = np.zeros((len(tokens), self.dim))
        if len(words):
            bucket, sign = self._votes(words.dictionary)
            at = words.indices.to_numpy(zero_copy_only=False)
            flat = np.bincount(rows * self.dim + bucket[at], sign[at], minlength=out.size)
            out = flat.reshape(out.shape)
        if self.normalize:
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            out = out / np.where(norms == 0.0, 1.0, norms)
        return out.astype(np.float32)


# Bytes of contents that are encoded at a time: their words take several times that room.
ENCODE_BYTES = 8 << 20

ENCODERS: dict[str, Callable[..., Encoder]] = {"hash": HashEncoder}


def register_encoder(name: str, factory: Callable[..., Encoder]) -> None:
    ENCODERS[name] = factory


def collect_kwargs(config: Mapping[str, Any], key: str) -> dict[str, Any]:
    """Constructor arguments; a nested ``kwargs`` mapping wins over direct keys."""
    direct = {k: v for k, v in config.items() if k not in (key, "kwargs")}
    nested = config.get("kwargs")
    return {**direct, **nested} if isinstance(nested, Mapping) else direct


def get_encoder(config: Mapping[str, Any]) -> Encoder:
    model = config.get("model")
    if model not in ENCODERS:
        raise ValueError(f"Model {model} not found")
    return ENCODERS[model](**collect_kwargs(config, "model"))


def build_retry(
    build: Callable[[], None],
    *,
    attempts: int = 3,
    pause: Callable[[int], float] = lambda attempt: 2.0**attempt,
    sleep: Callable[[float], None] = time.sleep,
) -> None:
    """Call ``build`` up to ``attempts`` times, pausing in between; the last failure is raised."""
    for attempt in range(attempts):
        try:
            build()
            return
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(pause(attempt))


_built: dict[str, Encoder] = {}


def worker_encoder(encoder: Encoder) -> Encoder:
    """The built encoder of this Python worker; tasks that follow reuse it."""
    key = f"{type(encoder).__qualname__}:{sorted(vars(encoder).items(), key=str)}"
    if key not in _built:
        build_retry(encoder.build)
        _built[key] = encoder
    return _built[key]


def spread(scan: DataFrame) -> DataFrame:
    """Give a table that arrives in few splits to all cores.

    Meant for plain scans, whose split count is known without running anything. A table with
    enough splits is left alone: at scale there is no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch cut so that the contents of a piece take about ``most`` bytes."""
    step = max(1, batch.num_rows * most // max(most, batch[column].nbytes))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def encode_column(
    df: DataFrame, column: str, encoder: Encoder, output: str = "embedding"
) -> DataFrame:
    """Append the vectors of a text or binary column; all other columns ride along."""
    require_columns(df, column)
    images = isinstance(df.schema[column].dataType, T.BinaryType)
    out = T.StructType([*df.schema.fields, T.StructField(output, VECTOR)])

    most = ENCODE_BYTES

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = worker_encoder(encoder)
        for batch in (part for whole in batches for part in pieces(whole, column, most)):
            values = batch[column]
            matrix = (
                ready.encode_batch(images=values)
                if images
                else ready.encode_batch(texts=values)
            )
            if matrix.ndim != 2 or len(matrix) != batch.num_rows:
                raise ValueError("An encoder must return one vector per input")
            flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float32).reshape(-1))
            vectors = pa.FixedSizeListArray.from_arrays(flat, matrix.shape[1])
            yield batch.append_column(output, vectors.cast(pa.list_(pa.float32())))

    return df.mapInArrow(encode, out)
