"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check_sql import differences

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    count, _, problem = differences(spark, SF, name, queries()[name], SQL.get(name))
    assert problem is None
    assert count > 0


def test_entry(spark):
    row = entry(spark).first().asDict()
    assert list(row) == ["recall_1", "recall_5", "recall_10"]
    assert 0 <= row["recall_1"] <= row["recall_5"] <= row["recall_10"] <= 1


def test_the_comparison_notices_one_changed_row(spark):
    from pyspark.sql import functions as F

    def broken(session, sf_dir):
        hits = queries()["knn_flat"](session, sf_dir)
        changed = F.when((F.col("qid") == "7") & (F.col("rank") == 3), F.col("score") + 1e-5)
        return hits.withColumn("score", F.coalesce(changed, F.col("score")))

    _, _, problem = differences(spark, SF, "knn_flat", broken, SQL["knn_flat"])
    assert problem is not None


def test_registry_covers_sql():
    assert set(SQL) <= set(queries())
    assert len(queries()) > 100
