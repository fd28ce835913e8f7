"""Queries on the relational tables: ids, labels, dedupe, joins, stores, sinks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.catalog.base import elements, gallery, query, scratch, table
from nearfield.functions.ids import (
    image_path,
    prompt_prefix,
    resolve_image_id,
    row_index,
    running_before,
)
from nearfield.functions.labels import (
    label_set,
    normalize_label,
    serialize_metadata,
    truth_info,
)
from nearfield.operators.dedup import (
    caption_limit,
    distinct_count,
    head_limit,
    keep_first_row,
    lookup,
    lookup_one,
    missing_one_side,
    running_limit,
    sample_seeded,
)
from nearfield.operators.search import captions_by_image, corpus_status
from nearfield.operators.store import (
    KeyedTable,
    MediaTable,
    VectorStore,
    delete_rows,
    upsert_rows,
)
from nearfield.sources.csv import (
    clean_queries,
    dedup_queries,
    fill_optional,
    join_annotations,
    read_csv_drop_index,
    relevant_ids_by_query,
)
from nearfield.sources.embeddings import project_relevance, read_split
from nearfield.sources.images import get_dataset, image_rows, image_rows_by_name
from nearfield.sources.shards import (
    checked_pairs,
    npy_manifest,
    convert_rows,
    convert_shards,
    pair_shards,
    read_npy_shards,
)
from nearfield.sources.sinks import (
    publish_configs,
    write_detail_tables,
    write_split_shards,
    write_summary_csv,
)

SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}|{SPACE}$', '', 'g')"


def label_sql(text: str) -> str:
    return f"regexp_replace({strip_sql(text)}, '\\.(jpg|jpeg|png|webp)$', '', 'i')"


# Reading ------------------------------------------------------------------------------------


@query(
    "read_split",
    "SELECT doc_id, source, lang AS split FROM documents WHERE lang = 'de'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "documents").withColumnRenamed("lang", "split")
    return read_split(parts, "de").select("doc_id", "source", "split")


@query(
    "project_relevance",
    f"""SELECT CAST(page_id AS VARCHAR) AS id, trim(url) AS label FROM pages
        UNION ALL SELECT CAST(doc_id AS VARCHAR), unnest([lang, source]) FROM documents""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    plain = project_relevance(table(spark, sf, "pages"), "url", "page_id")
    listed = table(spark, sf, "documents").withColumn("labels", F.array("lang", "source"))
    both = plain.unionByName(project_relevance(listed, "labels", "doc_id"))
    return both.select("id", F.explode("relevant_ids").alias("label"))


@query(
    "read_image_rows",
    "SELECT CAST(page_id AS VARCHAR) AS id, md5(html) AS digest FROM pages",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hosted = table(spark, sf, "pages").select(
        F.col("page_id").alias("inat24_image_id"), F.encode("html", "UTF-8").alias("image")
    )
    return image_rows(hosted).select("id", F.md5("image").alias("digest"))


@query(
    "read_image_rows_by_name",
    "SELECT string_split(regexp_extract(url, '[^/]*$'), '.')[1] AS id, md5(html) AS digest"
    " FROM pages",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "pages").select(
        F.regexp_extract("url", r"[^/]*\z", 0).alias("filename"),
        F.encode("html", "UTF-8").alias("image"),
    )
    return image_rows_by_name(named).select("id", F.md5("image").alias("digest"))


@query(
    "dataset_registry",
    "SELECT CAST(page_id AS VARCHAR) AS id, length(html) AS n FROM pages",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    config = {
        "dataset": "inquire",
        "path": f"{sf}/pages.parquet",
        "image_column": "url",
        "kwargs": {"id_column": "page_id", "image_column": "html"},
    }
    rows = get_dataset(spark, config)
    return rows.select("id", F.length("image").cast("long").alias("n"))


@query(
    "resolve_image_id",
    "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS VARCHAR)"
    " AS id FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    named = resolve_image_id(rows, None, fallback_order=["c_acctbal", "c_custkey"])
    return named.select("c_custkey", "id")


@query(
    "read_csv_drop_index",
    "SELECT CAST(doc_id AS VARCHAR) AS query_id, text AS query_text FROM documents",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    saved = table(spark, sf, "documents").select(
        F.col("doc_id").alias("Unnamed: 0"),
        F.col("doc_id").alias("query_id"),
        F.col("text").alias("query_text"),
    )
    saved.write.option("header", True).option("escape", '"').csv(path)
    return read_csv_drop_index(spark, path)


# Labels -------------------------------------------------------------------------------------

MESSY_SQL = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN chr(9) || url || '.JPG ' WHEN 1 THEN
  url || '.webp.png' WHEN 2 THEN chr(160) || url || '.jpeg' || chr(10) WHEN 3 THEN url || '.gif'
  WHEN 4 THEN '  ' ELSE url END AS raw FROM pages"""


def messy(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as labels with white space and suffixes around them."""
    url, part = F.col("url"), F.col("page_id") % 6
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(part == 0, F.concat(F.lit("\t"), url, F.lit(".JPG ")))
        .when(part == 1, F.concat(url, F.lit(".webp.png")))
        .when(part == 2, F.concat(F.lit(" "), url, F.lit(".jpeg\n")))
        .when(part == 3, F.concat(url, F.lit(".gif")))
        .when(part == 4, F.lit("  "))
        .otherwise(url)
        .alias("raw"),
    )


@query("normalize_label", f"SELECT page_id, {label_sql('raw')} AS label FROM ({MESSY_SQL})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf).select("page_id", normalize_label(F.col("raw")).alias("label"))


WORDS_SQL = f"""w AS (SELECT DISTINCT conv_id, turn, {strip_sql("x")} AS label FROM
  (SELECT conv_id, turn, unnest(string_split(text, '.')) AS x FROM conversations))"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.split("text", r"\.").alias("labels_raw")
    )


@query("label_set", f"WITH {WORDS_SQL} SELECT conv_id, turn, label FROM w")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = sentences(spark, sf)
    labels = label_set(rows, "labels_raw")
    return rows.select("conv_id", "turn", F.explode(labels).alias("label"))


@query(
    "truth_info",
    f"""WITH {WORDS_SQL}
    SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS n_labels,
           CAST(count(DISTINCT {label_sql("label")}) AS INTEGER) AS n_normalised,
           string_agg(label, '; ' ORDER BY label) AS joined FROM w GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    info = truth_info(sentences(spark, sf), "labels_raw")
    return info.select(
        "conv_id",
        "turn",
        F.size("labels").alias("n_labels"),
        F.size("normalised").alias("n_normalised"),
        "joined",
    )


@query(
    "serialize_metadata",
    """SELECT event_id, event_type || ', ' || user_id AS tags,
              '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS props, value
       FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "event_id",
        F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
        F.from_json("props", "map<string,int>").alias("props"),
        "value",
    )
    return rows.select(
        "event_id",
        *[serialize_metadata(rows, name).alias(name) for name in ("tags", "props", "value")],
    )


# Rows: dedupe, limits, lookups --------------------------------------------------------------


@query(
    "dedup_keep_first",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER"
    " (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    first = keep_first_row(table(spark, sf, "events"), ["user_id"], ["event_id"])
    return first.select("user_id", "event_id", "event_type")


@query(
    "distinct_count",
    "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_unique FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_count(table(spark, sf, "events"), "user_id")


QUERY_ROWS_SQL = """SELECT conv_id AS query_id, text AS query_text FROM (SELECT *, row_number()
  OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1"""


def conversation_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"),
        F.concat(F.lit(" \t"), "text", F.lit("\n")).alias("query_text"),
        "turn",
    )


@query(
    "dedup_queries",
    QUERY_ROWS_SQL.replace(
        "text AS query_text", "' ' || chr(9) || text || chr(10) AS query_text"
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_queries(conversation_queries(spark, sf), ["turn"]).drop("turn")


@query(
    "clean_queries",
    f"SELECT CAST(query_id AS INTEGER) AS query_id, {strip_sql('query_text')} AS query_text"
    f" FROM ({QUERY_ROWS_SQL})",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean_queries(conversation_queries(spark, sf), ["turn"]).drop("turn")


@query(
    "fill_optional",
    "SELECT doc_id, coalesce(nullif(lang, 'en'), '') AS category,"
    " CAST(n_chars AS VARCHAR) AS supercategory FROM documents",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.nullif(F.col("lang"), F.lit("en")).alias("category"),
        F.col("n_chars").alias("supercategory"),
    )
    return fill_optional(rows)


@query(
    "sample_seeded",
    "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 1000",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sample_seeded(table(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey")


@query("head_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return head_limit(table(spark, sf, "orders"), ["o_orderkey"], 500).select(
        "o_orderkey", "o_custkey"
    )


@query(
    "caption_limit",
    "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 60",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return caption_limit(rows, ["conv_id", "turn"], 12)


@query(
    "running_limit",
    """WITH s AS (SELECT conv_id AS shard, count(*) AS n_rows, conv_id % 7 = 0 AS skipped
                  FROM conversations GROUP BY 1),
    r AS (SELECT *, CASE WHEN skipped THEN 0 ELSE n_rows END AS used FROM s)
    SELECT shard, n_rows, skipped, CAST(greatest(0, least(used, 200 - coalesce(sum(used) OVER
      (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT)
      AS n_write FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    shards = (
        table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("shard"))
        .agg(F.count("*").alias("n_rows"))
        .withColumn("skipped", F.col("shard") % 7 == 0)
    )
    return running_limit(shards, 200)


@query(
    "lookup_by_id",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, keys = table(spark, sf, "documents"), table(spark, sf, "labels")
    return lookup(rows, keys, "doc_id").select("doc_id", "lang")


@query("lookup_one", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return lookup_one(table(spark, sf, "orders"), 77, "o_orderkey").select(
        "o_orderkey", "o_custkey"
    )


@query(
    "missing_one_side",
    """SELECT c_custkey AS key, 'left' AS only_in FROM customer
         WHERE c_custkey NOT IN (SELECT user_id FROM events)
       UNION ALL SELECT DISTINCT user_id, 'right' FROM events
         WHERE user_id NOT IN (SELECT c_custkey FROM customer)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    right = table(spark, sf, "events").select(F.col("user_id").alias("key"))
    return missing_one_side(left, right, "key")


@query(
    "row_index",
    "SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS index FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", "event_id")
    return row_index(rows, ["event_type", "event_id"]).select("event_id", "index")


# Joins and groups ---------------------------------------------------------------------------

PATHS_SQL = """SELECT CAST(o_custkey AS INTEGER) AS query_id,
  string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS paths
  FROM orders GROUP BY 1"""


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("image_path")
    )


@query("relevant_ids_by_query", PATHS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    grouped = relevant_ids_by_query(annotations(spark, sf))
    return grouped.select("query_id", F.array_join("relevant_ids", "|").alias("paths"))


@query(
    "join_annotations",
    f"""SELECT CAST(user_id AS INTEGER) AS query_id, coalesce(paths, '') AS paths FROM
        (SELECT DISTINCT user_id * 20 AS user_id FROM events) LEFT JOIN ({PATHS_SQL})
        ON query_id = user_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    queries = table(spark, sf, "events").select(
        (F.col("user_id") * 20).cast("int").alias("query_id")
    )
    joined = join_annotations(queries.distinct(), relevant_ids_by_query(annotations(spark, sf)))
    return joined.select("query_id", F.array_join("relevant_ids", "|").alias("paths"))


@query(
    "captions_by_image",
    """SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1
         AS position FROM conversations""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return captions_by_image(rows, ["turn"], "conv_id")


@query(
    "corpus_status",
    """SELECT (SELECT count(*) FROM embeddings) AS image_count, true AS images_loaded,
       (SELECT count(*) FROM conversations) AS caption_count,
       true AS caption_embeddings_loaded, (SELECT string_agg(id, ',' ORDER BY conv_id, turn) FROM
       (SELECT conv_id, turn, conv_id || '#' || turn AS id FROM conversations
        ORDER BY conv_id, turn LIMIT 5)) AS sample_captions""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    captions = table(spark, sf, "conversations").withColumn(
        "id", F.concat_ws("#", "conv_id", "turn")
    )
    status = corpus_status(gallery(spark, sf), captions, ["conv_id", "turn"])
    return status.withColumn("sample_captions", F.array_join("sample_captions", ","))


@query(
    "image_path",
    "SELECT page_id, '/data/images/' || page_id || '.jpg' AS image_path FROM pages",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = image_path("/data/images", "{id}.jpg", F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", path.alias("image_path"))


@query(
    "prompt_prefix",
    "SELECT doc_id, 'Query: ' || text AS query, 'Passage: ' || text AS passage FROM documents",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        prompt_prefix(F.col("text"), "query").alias("query"),
        prompt_prefix(F.col("text"), "passage").alias("passage"),
    )


# Keyed tables -------------------------------------------------------------------------------

LATEST_SQL = """SELECT user_id AS key, value FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""
UPSERT_SQL = f"""SELECT key, value FROM (SELECT c_custkey AS key, c_acctbal AS value FROM customer)
  WHERE key NOT IN (SELECT user_id FROM events) UNION ALL {LATEST_SQL}"""


def balances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")
    )


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("key"), "value", "ts", "event_id"
    )


NEWEST = (lambda: [F.col("ts").desc(), F.col("event_id").desc()])


@query("upsert", UPSERT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return upsert_rows(balances(spark, sf), feed(spark, sf), "key", NEWEST())


@query(
    "delete_ids",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN"
    " (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    toxic = table(spark, sf, "labels").where("toxic = 1")
    return delete_rows(table(spark, sf, "documents"), toxic, "doc_id").select("doc_id", "lang")


@query(
    "store_changes",
    f"SELECT * FROM ({UPSERT_SQL}) WHERE key NOT IN (SELECT s_suppkey FROM supplier)"
    " AND key NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT n_nationkey, 0.5 FROM nation",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert, upsert, delete, compact, upsert again: the final state of a keyed table."""
    schema = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("value", T.DoubleType())]
    )
    store = KeyedTable(spark, scratch(spark, "store"), schema, "key").create()
    store.upsert(balances(spark, sf))
    store.upsert(feed(spark, sf), newest=NEWEST())
    store.delete(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")))
    store.compact()
    store.upsert(
        table(spark, sf, "nation").select(
            F.col("n_nationkey").alias("key"), F.lit(0.5).alias("value")
        )
    )
    return store.read()


def vector_store(spark: SparkSession, sf: str) -> VectorStore:
    store = VectorStore(spark, scratch(spark, "vectors"), {"dim": 64}).create()
    store.add(
        gallery(spark, sf).select("id", "embedding"), model_name="given", dataset_name="vectors"
    )
    return store


STORE_SQL = """SELECT CAST(vec_id AS VARCHAR) AS id, 'given' AS model_name,
  'vectors' AS dataset_name, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings"""


@query("store_create", STORE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_store(spark, sf).read()
    return rows.select("id", "model_name", "dataset_name", F.size("vector").alias("dim"))


@query("store_validate", STORE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = VectorStore(spark, scratch(spark, "vectors"), {"dimension": 64})
    rows = gallery(spark, sf).select(
        "id",
        F.lit("given").alias("model_name"),
        F.lit("vectors").alias("dataset_name"),
        F.col("embedding").alias("vector"),
    )
    return store.validated(rows).select(
        "id", "model_name", "dataset_name", F.size("vector").alias("dim")
    )


@query("store_drop", "SELECT count(*) AS held, false AS exists_after FROM embeddings")
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = vector_store(spark, sf)
    held = store.count()
    store.drop()
    store.drop()
    return spark.createDataFrame([(held, store.exists())], "held long, exists_after boolean")


MEDIA_SQL = "SELECT CAST(page_id AS VARCHAR) AS key, md5(html) AS digest FROM pages"


def media(spark: SparkSession, sf: str) -> MediaTable:
    store = MediaTable(spark, scratch(spark, "media")).create()
    store.put(
        table(spark, sf, "pages").select(
            F.col("page_id").cast("string").alias("key"), F.encode("html", "UTF-8").alias("value")
        )
    )
    return store


def doc_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"))


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.md5("value").alias("digest"))


@query(
    "media_put",
    "SELECT CAST(page_id AS VARCHAR) AS key, md5(CASE WHEN page_id IN (SELECT doc_id FROM"
    " documents WHERE lang = 'de') THEN 'de' ELSE html END) AS digest FROM pages"
    " UNION ALL SELECT CAST(doc_id AS VARCHAR), md5('de') FROM documents WHERE lang = 'de'"
    " AND doc_id NOT IN (SELECT page_id FROM pages)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = media(spark, sf)
    german = table(spark, sf, "documents").where("lang = 'de'")
    store.put(
        german.select(
            F.col("doc_id").cast("string").alias("key"), F.encode("lang", "UTF-8").alias("value")
        )
    )
    return digests(store.read())


@query(
    "media_get",
    f"SELECT * FROM ({MEDIA_SQL}) WHERE key IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return digests(media(spark, sf).get(doc_keys(spark, sf)))


@query(
    "media_contains",
    "SELECT CAST(doc_id AS VARCHAR) AS key, doc_id IN (SELECT page_id FROM pages) AS present"
    " FROM labels",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return media(spark, sf).contains(doc_keys(spark, sf))


@query(
    "media_delete",
    f"SELECT * FROM ({MEDIA_SQL}) WHERE key NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = media(spark, sf)
    held = store.keys().join(doc_keys(spark, sf).distinct(), "key", "left_semi")
    store.remove(held)
    return digests(store.read())


@query("media_keys", "SELECT CAST(page_id AS VARCHAR) AS key FROM pages ORDER BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return media(spark, sf).keys()


@query("media_items", MEDIA_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return digests(media(spark, sf).items())


@query("media_len", "SELECT count(*) AS entries FROM pages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return media(spark, sf).read().agg(F.count("*").alias("entries"))


# Shards and sinks ---------------------------------------------------------------------------


@query(
    "pair_shards",
    """SELECT coalesce(p.page_id, d.doc_id) AS shard, p.page_id IS NOT NULL AS has_metadata,
              d.doc_id IS NOT NULL AS has_vectors
       FROM pages p FULL JOIN documents d ON p.page_id + 100 = d.doc_id + 100""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """One listed file per page on one side and per document on the other, zeros in front."""
    left = table(spark, sf, "pages").select(
        F.format_string("metadata_%06d.parquet", "page_id").alias("file")
    )
    right = table(spark, sf, "documents").select(
        F.format_string("img_emb_%d.npy", "doc_id").alias("file")
    )
    pairs = pair_shards(
        left.withColumn("path", F.concat(F.lit("/m/"), "file")),
        right.withColumn("path", F.concat(F.lit("/v/"), "file")),
    )
    checked_pairs(pairs)
    return pairs.select(
        "shard",
        F.col("meta_path").isNotNull().alias("has_metadata"),
        F.col("npy_path").isNotNull().alias("has_vectors"),
    )


def write_shards(spark: SparkSession, sf: str) -> tuple[str, str, list[str]]:
    """Metadata and matrix shards of the embeddings table, one pair per task."""
    meta, vectors = scratch(spark, "meta"), scratch(spark, "npy")
    files, root = pafs.FileSystem.from_uri(meta if ":" in meta else f"file://{meta}")
    files.create_dir(root)
    files.create_dir(pafs.FileSystem.from_uri(vectors if ":" in vectors else f"file://{vectors}")[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        number = TaskContext.get().partitionId()
        matrix = np.array(rows["embedding"].to_pylist(), dtype=np.float32)
        name = f"img_emb_{number:04d}.npy"
        buffer = io.BytesIO()
        np.save(buffer, matrix)
        for folder, file, data in (
            (vectors, name, buffer.getvalue()),
            (meta, f"metadata_{number}.parquet", None),
        ):
            fs, inner = pafs.FileSystem.from_uri(
                (folder if ":" in folder else f"file://{folder}") + "/" + file
            )
            with fs.open_output_stream(inner) as sink:
                if data is None:
                    pq.write_table(rows.select(["image_path"]), sink)
                else:
                    sink.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([f"{vectors}/{name}"])], names=["path"])

    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("img/"), "vec_id", F.lit(".jpg")).alias("image_path"), "embedding"
    )
    spread = rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")
    paths = [row["path"] for row in spread.mapInArrow(write, "path string").collect()]
    return meta, vectors, sorted(paths)


SHARD_SQL = """SELECT 'img/' || vec_id || '.jpg' AS id, 'img/' || vec_id || '.jpg' AS image_path,
  'm' AS model_name, 'd' AS dataset_name, CAST(pos - 1 AS INTEGER) AS pos,
  round(CAST(x AS DOUBLE), 6) AS value
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"""


@query(
    "read_npy_shards",
    """SELECT row, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 6) AS value FROM
       (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding FROM embeddings) r,
       LATERAL (SELECT unnest(r.embedding) AS x, generate_subscripts(r.embedding, 1) AS pos)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every element under the row of the whole table: the rows of earlier files, then those before it."""
    _, _, paths = write_shards(spark, sf)
    files = npy_manifest(spark.createDataFrame([(p,) for p in paths], "path string"))
    starts = running_before(files, ["path"], "rows", "start").select("path", "start")
    rows = read_npy_shards(spark, paths, 100).join(F.broadcast(starts), "path")
    return elements(rows.withColumn("row", F.col("start") + F.col("row_pos")), "row")


@query("convert_shards", SHARD_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    meta, vectors, _ = write_shards(spark, sf)
    whole = convert_shards(
        spark, meta, vectors, scratch(spark, "out"), model_name="m", dataset_name="d"
    )
    names = ["id", "image_path", "model_name", "dataset_name"]
    return whole.select(*names, F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


@query(
    "convert_rows",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_pos,
                         count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    s AS (SELECT DISTINCT label, n FROM o),
    b AS (SELECT label, greatest(0, least(n, 150 - coalesce(sum(n) OVER (ORDER BY label ROWS
          BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM s)
    SELECT CAST(vec_id AS VARCHAR) AS id, o.label AS shard FROM o JOIN b ON o.label = b.label
    WHERE row_pos < quota""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A budget of 150 rows over label shards, in shard order."""
    rows = table(spark, sf, "embeddings")
    placed = captions_by_image(rows.withColumn("shard", F.col("label")), ["vec_id"], "shard")
    placed = placed.withColumnRenamed("position", "row_pos")
    meta = placed.select("shard", "row_pos", F.col("vec_id").alias("image_path"))
    vectors = placed.select("shard", "row_pos", "embedding")
    zipped = convert_rows(meta, vectors, model_name="m", dataset_name="d", budget=150)
    return zipped.select("id", "shard")


@query(
    "write_query_shards",
    "SELECT lang AS split, count(*) AS n_rows, CAST(ceil(count(*) / 100.0) AS BIGINT) AS files"
    " FROM documents GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "split")
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("split"))
    # Chunks are dealt out whole, so that the file count shows the chunk size and no split has to
    # pass through one task.
    placed = captions_by_image(rows, ["doc_id"], "split").withColumn(
        "chunk", F.floor(F.col("position") / 100)
    )
    write_split_shards(
        placed.repartition("split", "chunk").select("doc_id", "split"), path, chunk_size=100
    )
    return (
        spark.read.parquet(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .groupBy("split")
        .agg(F.count("*").alias("n_rows"), F.count_distinct("file").alias("files"))
    )


@query(
    "publish_configs",
    """SELECT 'images' AS config, 'train' AS split, count(*) AS written, count(*) AS found
         FROM embeddings
       UNION ALL SELECT 'texts', lang, count(*), count(*) FROM documents GROUP BY lang""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").withColumnRenamed("lang", "split")
    configs = {"images": gallery(spark, sf), "texts": texts}
    return publish_configs(spark, configs, scratch(spark, "hub"))


@query(
    "write_summary_csv",
    """SELECT 'a' AS method, CAST(count(*) AS VARCHAR) AS ntotal, CAST(NULL AS VARCHAR) AS extra
         FROM orders
       UNION ALL SELECT 'b', CAST(count(*) AS VARCHAR), '1' FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "summary")
    counts = F.count("*").alias("ntotal")
    first = table(spark, sf, "orders").agg(counts).select(F.lit("a").alias("method"), "ntotal")
    second = table(spark, sf, "lineitem").agg(counts)
    second = second.select(F.lit("b").alias("method"), "ntotal", F.lit(1).alias("extra"))
    write_summary_csv([first, second], path)
    return spark.read.option("header", True).csv(path)


@query(
    "write_detail_tables",
    "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, o_totalprice AS distance,"
    " o_orderstatus AS aside FROM orders",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "tables")
    orders = table(spark, sf, "orders")
    details = orders.select(
        F.col("o_orderstatus").alias("aside"),
        F.col("o_totalprice").alias("distance"),
        F.col("o_orderkey").cast("string").alias("image_id"),
    )
    write_detail_tables(orders.agg(F.count("*").alias("ntotal")), details, path)
    return spark.read.parquet(f"{path}/details")
