"""Registry of runnable queries over the test tables, with the SQL that must agree."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import ship_package, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL the result is checked by rows only."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(ship_package(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


# The test tables as declared; a declared schema spares the scan of file footers.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of files.

    The pattern matches that one name: a stream takes no plain file as its path, and a name filter
    would apply to the files inside a folder.
    """
    return spark.readStream.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.[p]arquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared scratch space."""
    return f"{shared_dir(spark)}/nearfield-{name}-{uuid.uuid4().hex}"


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding", "label"
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is also a query."""
    return gallery(spark, sf_dir).withColumnRenamed("id", "qid")


def rounded(hits: DataFrame, *more: str, score: str = "score") -> DataFrame:
    return hits.withColumn(score, F.round(score, 6)).select("qid", "rank", "id", score, *more)


def elements(df: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Long form of a vector column, for comparison by value."""
    return df.select(key, F.posexplode(vector).alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


# SQL fragments ------------------------------------------------------------------------------

VECTORS = """
e AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(embedding AS DOUBLE[]) AS v
      FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM e),
u AS (SELECT id, label, v, len,
             list_transform(v, lambda x: x / CASE WHEN len = 0 THEN 1 ELSE len END) AS w
      FROM n)"""


def score_sql(metric: str, left: str = "q", right: str = "g") -> str:
    if metric == "ip":
        return f"list_dot_product({left}.v, {right}.v)"
    if metric == "cosine":
        return f"list_dot_product({left}.w, {right}.w)"
    gap = f"list_transform(list_zip({left}.v, {right}.v), lambda p: p[1] - p[2])"
    return f"list_dot_product({gap}, {gap})"


def order_sql(metric: str, score: str = "score") -> str:
    return f"{score} {'ASC' if metric == 'l2' else 'DESC'}, id ASC"


def ranked_sql(pairs: str, metric: str, k: int) -> str:
    """Top k per query over a CTE of ``qid, id, score``."""
    return (
        f"SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY "
        f"{order_sql(metric)}) AS INTEGER) AS rank, id, score FROM {pairs}) WHERE rank <= {k}"
    )


def knn_ctes(metric: str, k: int, name: str = "h") -> str:
    """CTEs ending in ``name(qid, rank, id, score)``: every vector against every vector."""
    return f"""
{name}_p AS (SELECT q.id AS qid, g.id AS id, {score_sql(metric)} AS score FROM u q, u g),
{name} AS ({ranked_sql(f"{name}_p", metric, k)})"""


HITS = "SELECT qid, rank, id, round(score, 6) AS score FROM "


def encoded_ctes(name: str, source: str, key: str, text: str, dim: int = 64) -> str:
    """Signed token hashing in SQL: CTEs ending in ``name(id, v, len, w)``."""
    words = f"string_split_regex(lower({text}), '[\\s\\x0B]+')"
    return f"""
{name}_t AS (SELECT {key} AS id, unnest({words}) AS tok FROM {source}),
{name}_d AS (SELECT id, md5(tok) AS d FROM {name}_t WHERE tok <> ''),"""+ hashed_ctes(
        name, source, key, dim
    )


def block_ctes(name: str, source: str, key: str, text: str, dim: int) -> str:
    """The same over 64-byte blocks of the text's bytes."""
    return f"""
{name}_h AS (SELECT {key} AS id, hex(encode({text})) AS h FROM {source}),
{name}_t AS (SELECT id, unnest(list_transform(range((len(h) + 127) // 128),
                    lambda i: substr(h, CAST(i * 128 + 1 AS BIGINT), 128))) AS tok FROM {name}_h),
{name}_d AS (SELECT id, md5(unhex(tok)) AS d FROM {name}_t),""" + hashed_ctes(
        name, source, key, dim
    )


def hashed_ctes(name: str, source: str, key: str, dim: int) -> str:
    """From digests ``name_d(id, d)`` to unit vectors."""
    return f"""
{name}_b AS (SELECT id, ('0x' || substr(d, 1, 8))::BIGINT % {dim} AS b,
                    sum(CASE WHEN substr(d, 9, 1) < '8' THEN 1 ELSE -1 END) AS s
             FROM {name}_d GROUP BY 1, 2),
{name}_f AS (SELECT k.id, list(CAST(coalesce(s, 0) AS DOUBLE) ORDER BY r.b) AS c
             FROM (SELECT {key} AS id FROM {source}) k CROSS JOIN range({dim}) r(b)
             LEFT JOIN {name}_b x ON x.id = k.id AND x.b = r.b GROUP BY k.id),
{name}_l AS (SELECT id, c, sqrt(list_dot_product(c, c)) AS l FROM {name}_f),
{name}_v AS (SELECT id, list_transform(c, lambda x:
                    CAST(CAST(x / CASE WHEN l = 0 THEN 1 ELSE l END AS FLOAT) AS DOUBLE)) AS v
             FROM {name}_l),
{name}_n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS len FROM {name}_v),
{name} AS (SELECT id, v, len,
                  list_transform(v, lambda x: x / CASE WHEN len = 0 THEN 1 ELSE len END) AS w
           FROM {name}_n)"""


# Centroids shared by the list-based queries: the rounded mean vector of each label.
CENTROIDS_SQL = """
ce AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
cm AS (SELECT label, pos, CAST(CAST(round(avg(x), 6) AS FLOAT) AS DOUBLE) AS x
       FROM ce GROUP BY 1, 2),
cv AS (SELECT CAST(label AS BIGINT) AS list_id, list(x ORDER BY pos) AS v FROM cm GROUP BY 1),
cn AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM cv),
c AS (SELECT list_id, v, len,
             list_transform(v, lambda x: x / CASE WHEN len = 0 THEN 1 ELSE len END) AS w FROM cn)"""


def probes_sql(metric: str, name: str, n: int) -> str:
    """CTE ``name(id, list_id)``: the n best centroids of every vector."""
    direction = "ASC" if metric == "l2" else "DESC"
    return f"""
{name}_p AS (SELECT q.id, g.list_id, {score_sql(metric)} AS s FROM u q, c g),
{name} AS (SELECT id, list_id FROM (SELECT *, row_number() OVER (PARTITION BY id
           ORDER BY s {direction}, list_id) AS r FROM {name}_p) WHERE r <= {n})"""


def label_centroids(rows: DataFrame) -> DataFrame:
    """Mean vector per label, in long form first so that sums combine before the shuffle."""
    means = (
        rows.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).cast("float").alias("x"))
    )
    return means.groupBy(F.col("label").cast("long").alias("list_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(
            "embedding"
        )
    )
