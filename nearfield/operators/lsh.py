"""Hash tables of sign bits: the approximate family that stands in for graph indexes.

Each table projects a vector on ``bits`` fixed sign patterns; rows sharing a bucket with the query
in any table are candidates and are scored exactly. More tables raise recall and cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfield.operators.knn import Limits, check_metric, nearest
from nearfield.operators.topk import to_matrix
from nearfield.schema import require_positive


@dataclass(frozen=True)
class HashTables:
    tables: int = 4
    bits: int = 8
    seed: int = 42

    def __post_init__(self) -> None:
        require_positive(tables=self.tables, bits=self.bits)
        if self.bits > 32:
            raise ValueError("bits must be at most 32")

    def signs(self, dim: int) -> np.ndarray:
        """(tables, bits, dim) of +1 / -1 from the parity of a digest, repeatable in SQL."""
        out = np.empty((self.tables, self.bits, dim))
        for t, b, d in np.ndindex(out.shape):
            digest = hashlib.md5(f"{self.seed}:{t}:{b}:{d}".encode()).hexdigest()
            out[t, b, d] = 1.0 if digest[0] in "01234567" else -1.0
        return out


def with_buckets(df: DataFrame, config: HashTables) -> DataFrame:
    """Append ``cells``: one bucket per table, numbered so that tables never collide."""
    out = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = None
        weights = 1 << np.arange(config.bits, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = to_matrix(batch["embedding"]).astype(np.float64)
            if signs is None:
                signs = config.signs(matrix.shape[1])
            sides = np.einsum("nd,tbd->ntb", matrix, signs, optimize=True) >= 0
            codes = sides @ weights + (np.arange(config.tables, dtype=np.int64) << config.bits)
            cells = pa.FixedSizeListArray.from_arrays(
                pa.array(codes.reshape(-1)), config.tables
            ).cast(pa.list_(pa.int64()))
            yield batch.append_column("cells", cells)

    return df.mapInArrow(hash_rows, out)


def knn_lsh(
    gallery: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    config: HashTables | None = None,
    normalize: bool | None = None,
    limits: Limits | None = None,
    **options,
) -> DataFrame:
    config = config or HashTables()
    return nearest(
        with_buckets(gallery.select("id", "embedding"), config),
        with_buckets(queries.select("qid", "embedding"), config),
        k,
        check_metric(metric),
        normalize=normalize,
        routing="hash",
        cells=config.tables,
        limits=limits,
        **options,
    )
