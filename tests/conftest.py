from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from nearfield.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship_package(local_session("tests", 4))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    """``vectors(matrix, key, prefix)``: one row per matrix row, ids ``prefix0, prefix1, ...``"""
    from pyspark.sql import types as T

    def make(matrix, key="id", prefix="", ids=None, parts=None):
        names = ids or [f"{prefix}{i}" for i in range(len(matrix))]
        schema = T.StructType(
            [
                T.StructField(key, T.StringType()),
                T.StructField("embedding", T.ArrayType(T.FloatType())),
            ]
        )
        rows = [(n, [float(x) for x in row]) for n, row in zip(names, matrix, strict=True)]
        frame = spark.createDataFrame(rows, schema)
        return frame.repartition(parts) if parts else frame

    return make
