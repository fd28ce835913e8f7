"""Query preparation without a limit, and what a limit keeps."""

from __future__ import annotations

from check_sql import differences

from __spark_entry__ import oracle_sql, queries
from nearfield.functions.encoders import HashEncoder
from nearfield.plans.prepare import prepare_split

SF = "/root/testdata/sf0.001"


def test_every_item_is_prepared(spark):
    name = "prepare_queries"
    count, _, problem = differences(spark, SF, name, queries()[name], oracle_sql()[name])
    assert problem is None
    assert count == spark.read.parquet(f"{SF}/benchmark.parquet").count() > 30


def test_limit(spark):
    items = spark.createDataFrame(
        [(i, f"query {i}") for i in range(9)], "query_id bigint, query_text string"
    )
    labels = spark.createDataFrame([(8, "img/8.jpg")], "query_id bigint, image_path string")

    def ids(limit):
        rows = prepare_split(
            items, labels, HashEncoder(), split="a", dataset_name="d", limit=limit
        )
        return sorted(r["query_id"] for r in rows.select("query_id").collect())

    assert ids(None) == list(range(9)) and ids(4) == [0, 1, 2, 3]
