"""Tables that are folders of files, as Spark writes them, read the same as single files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import queries
from nearfield.catalog.base import TABLES


def written(spark, top, files):
    """A folder of tables whose names end in .parquet and that hold several files each."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(40)]
    vectors = spark.createDataFrame(rows, TABLES["embeddings"])
    vectors.repartition(files).write.parquet(f"{top}/embeddings.parquet")
    texts = [(i, f"word{i} other words", "en", "web", 10) for i in range(20)]
    documents = spark.createDataFrame(texts, TABLES["documents"])
    documents.repartition(files).write.parquet(f"{top}/documents.parquet")


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    written(spark, tmp_path, 3)
    answers = queries()["stream_search"](spark, str(tmp_path))
    wide = queries()["knn_flat"](spark, str(tmp_path)).where(F.col("rank") <= 5)
    assert sorted(answers.collect()) == sorted(wide.collect())
    assert answers.count() == 200
    stored = queries()["stream_ingest"](spark, str(tmp_path))
    assert stored.count() > 0
