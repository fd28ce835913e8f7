"""Queries on the text tables: captions, encoders, embedding jobs, text search, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.catalog.base import (
    VECTORS,
    arriving,
    asked,
    block_ctes,
    elements,
    encoded_ctes,
    gallery,
    knn_ctes,
    query,
    ranked_sql,
    rounded,
    scratch,
    table,
)
from nearfield.functions.encoders import HashEncoder, encode_column, get_encoder, spread
from nearfield.operators.knn import nearest
from nearfield.operators.search import (
    attach_captions,
    search_by_caption,
    search_by_text,
    search_results,
)
from nearfield.operators.store import VectorStore
from nearfield.plans.prepare import prepare_queries
from nearfield.plans.embed import embed_images, embed_texts
from nearfield.session import materialise
from nearfield.sources.captions import (
    caption_line,
    explode_captions,
    export_captions_jsonl,
    get_record,
    read_captions_jsonl,
)
from nearfield.sources.sinks import write_caption_embeddings, write_image_embeddings
from nearfield.streaming.jobs import stream_ingest, stream_search

ENCODER = {"model": "hash", "kwargs": {"dim": 64}}
# Vectors of whole counts tie often; equal to nine decimals is a tie.
TIES = 9

# Captions -----------------------------------------------------------------------------------

NAME = r"regexp_extract(regexp_replace({0}, '(/\.?)+$', ''), '([^/]*)$', 1)"
STEM_SQL = (
    "CASE WHEN {n} = '.' THEN '' ELSE regexp_replace({n}, '^(.+)\\.[^.]+$', '\\1', 's') END"
)


def image_id_sql(path: str) -> str:
    stem = STEM_SQL.format(n=NAME.format(path))
    return f"CASE WHEN {stem} = '' THEN 'unknown' ELSE {stem} END"


IMAGE_SQL = "'photos/' || conv_id || '.' || turn || '.jpg'"
CAPTIONS_SQL = f"""lines AS (SELECT conv_id, turn, {IMAGE_SQL} AS image, CASE WHEN role = 'user'
    THEN string_split(text, '. ') ELSE [text] END AS caps FROM conversations),
flat AS (SELECT conv_id, turn, image, unnest(caps) AS caption,
                generate_subscripts(caps, 1) - 1 AS pos FROM lines),
captions AS (SELECT row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS index, image,
             conv_id || '.' || turn AS image_id, conv_id || '.' || turn || '#' || pos AS caption_id,
             caption FROM flat)"""


def caption_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON line per turn: a list of sentences for users, one text for the others."""
    rows = table(spark, sf, "conversations").withColumn(
        "image", F.concat(F.lit("photos/"), "conv_id", F.lit("."), "turn", F.lit(".jpg"))
    )
    many = caption_line(F.col("image"), F.split("text", r"\. "))
    one = caption_line(F.col("image"), F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("role") == "user", many).otherwise(one).alias("value"))


def captions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "captions")
    # Blank lines at the end of a file are skipped by the reader.
    caption_lines(spark, sf).orderBy("conv_id", "turn").select(
        F.concat("value", F.lit("\n  "))
    ).write.text(path)
    return read_captions_jsonl(spark, path)


@query(
    "read_captions_jsonl",
    f"WITH {CAPTIONS_SQL} SELECT index, caption_id, caption, image, image_id FROM captions",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return captions(spark, sf)


@query(
    "get_record",
    f"WITH {CAPTIONS_SQL} SELECT index, caption_id, caption FROM captions WHERE index = 25",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return get_record(captions(spark, sf), 25).select("index", "caption_id", "caption")


@query(
    "export_captions_jsonl",
    "SELECT url AS image, unnest(string_split(html, '<')) AS caption FROM pages",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "export")
    rows = table(spark, sf, "pages").select(
        F.col("url").alias("image"), F.split("html", "<").alias("caption")
    )
    export_captions_jsonl(rows, path)
    back = spark.read.schema("caption array<string>, image string").json(path)
    return back.select("image", F.explode("caption").alias("caption"))


@query(
    "caption_ids",
    f"""SELECT page_id, pos, {image_id_sql("url")} AS image_id,
        {image_id_sql("url")} || '#' || pos AS caption_id, caption FROM
        (SELECT page_id, url, unnest(string_split(html, '</p>')) AS caption,
         CAST(generate_subscripts(string_split(html, '</p>'), 1) - 1 AS INTEGER) AS pos
         FROM pages)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "pages").select(
        "page_id", caption_line(F.col("url"), F.split("html", "</p>")).alias("value")
    )
    return explode_captions(lines, ["page_id"]).select(
        "page_id", F.col("_pos").alias("pos"), "image_id", "caption_id", "caption"
    )


# Encoders and embedding jobs ----------------------------------------------------------------

DOCS = "SELECT CAST(doc_id AS VARCHAR) AS doc, text FROM documents"
ELEMENTS_SQL = """SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) AS value FROM
  (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {0})"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents")
    return spread(rows.select(F.col("doc_id").cast("string").alias("id"), "text"))


HASH_SQL = f"WITH {encoded_ctes('h', f'({DOCS})', 'doc', 'text')} " + ELEMENTS_SQL.format("h")


@query("hash_encoder", HASH_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf)
    return elements(encode_column(rows, "text", get_encoder(ENCODER)).select("id", "embedding"))


@query(
    "encoder_registry",
    "SELECT CAST(doc_id AS VARCHAR) AS id, 24 AS dim FROM documents",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    encoder = get_encoder({"model": "hash", "dim": 8, "kwargs": {"dim": 24}})
    rows = encode_column(documents(spark, sf), "text", encoder)
    return rows.select("id", F.size("embedding").alias("dim"))


EMBED_SQL = (
    f"WITH {CAPTIONS_SQL}, {encoded_ctes('h', 'captions', 'index', 'caption')}"
    " SELECT c.index, c.caption_id AS id, c.image_id, 'hash' AS model_name,"
    " 'chat' AS dataset_name, list_position(v, list_max(v)) AS peak,"
    " round(list_max(v), 6) AS top FROM captions c JOIN h ON h.id = c.index"
)


def embedded_captions(spark: SparkSession, sf: str) -> DataFrame:
    return embed_texts([get_encoder(ENCODER)], captions(spark, sf), "chat")


def peaks(rows: DataFrame) -> DataFrame:
    top = F.array_max("embedding")
    return rows.select(
        "index",
        "id",
        "image_id",
        "model_name",
        "dataset_name",
        F.array_position("embedding", top).cast("int").alias("peak"),
        F.round(top.cast("double"), 6).alias("top"),
    )


@query("embed_texts", EMBED_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return peaks(embedded_captions(spark, sf))


@query("write_caption_embeddings", EMBED_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "caption-embeddings")
    write_caption_embeddings(embedded_captions(spark, sf), path)
    return peaks(spark.read.parquet(path))


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.encode("html", "UTF-8").alias("image")
    )


def document_images(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", F.encode("text", "UTF-8").alias("image"))


@query(
    "embed_images",
    "WITH "
    + block_ctes(
        "h", "(SELECT CAST(page_id AS VARCHAR) AS page, html FROM pages)", "page", "html", 16
    )
    + ELEMENTS_SQL.format("h"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = embed_images([HashEncoder(16)], {"pages": page_images(spark, sf)})
    return elements(rows)


@query(
    "write_image_embeddings",
    "SELECT CAST(page_id AS VARCHAR) AS id, 'hash' AS model_name, 'pages' AS dataset_name,"
    " 16 AS dim FROM pages",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "image-embeddings")
    write_image_embeddings(
        embed_images([HashEncoder(16)], {"pages": page_images(spark, sf)}), path
    )
    return spark.read.parquet(path).select(
        "id", "model_name", "dataset_name", F.size("embedding").alias("dim")
    )


@query(
    "model_dataset_sweep",
    " UNION ALL ".join(
        f"SELECT 'hash{dim}' AS model_name, '{name}' AS dataset_name, {dim} AS dim, count(*) AS"
        f" items FROM {name}"
        for dim in (16, 32)
        for name in ("pages", "documents")
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    models = [HashEncoder(dim, name=f"hash{dim}") for dim in (16, 32)]
    datasets = {"pages": page_images(spark, sf), "documents": document_images(spark, sf)}
    swept = embed_images(models, datasets)
    return swept.groupBy("model_name", "dataset_name", F.size("embedding").alias("dim")).agg(
        F.count("*").alias("items")
    )


# Search -------------------------------------------------------------------------------------


def text_search_sql(queries: str, key: str, k: int) -> str:
    return (
        f"WITH {encoded_ctes('g', f'({DOCS})', 'doc', 'text')},"
        f" {encoded_ctes('q', queries, key, 'text')},"
        " p AS (SELECT q.id AS qid, g.id AS id, round(list_dot_product(q.w, g.w), 9) AS score"
        " FROM q, g) SELECT qid, rank, id, round(score, 6) AS score FROM"
        f" ({ranked_sql('p', 'cosine', k)})"
    )


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded once: a search counts the vectors and then reads them."""
    rows = documents(spark, sf)
    return materialise(encode_column(rows, "text", get_encoder(ENCODER)).select("id", "embedding"))


@query("search_by_text", text_search_sql("benchmark", "item_id", 10))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages against all documents."""
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return rounded(
        search_by_text(
            document_vectors(spark, sf), texts, get_encoder(ENCODER), 10, tie_decimals=TIES
        )
    )


@query(
    "search_by_caption",
    text_search_sql(
        "(SELECT conv_id || '#' || turn AS cap, text FROM conversations)", "cap", 5
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of every conversation, named by its caption id, against all documents."""
    turns = spread(
        table(spark, sf, "conversations").select(
            F.concat_ws("#", "conv_id", "turn").alias("id"), "text"
        )
    )
    encoded = encode_column(turns, "text", get_encoder(ENCODER))
    ids = turns.select(F.col("id").alias("qid"), F.col("id").alias("caption_id"))
    return rounded(
        search_by_caption(document_vectors(spark, sf), encoded, ids, 5, tie_decimals=TIES)
    )


FIVE_SQL = """cap AS (SELECT *, conv_id || '#' || turn AS cid, row_number() OVER
    (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
five AS (SELECT CAST(conv_id AS VARCHAR) AS id, min(CASE WHEN r = 1 THEN text END) AS caption,
         string_agg(cid, ',' ORDER BY r) AS ids, count(*) AS n FROM cap WHERE r <= 5 GROUP BY 1)"""


def turns_as_captions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("image_id"),
        "turn",
        F.concat_ws("#", "conv_id", "turn").alias("id"),
        F.col("text").alias("caption"),
    )


@query(
    "attach_captions",
    f"WITH {VECTORS}, {knn_ctes('ip', 4)}, {FIVE_SQL}"
    " SELECT qid, rank, h.id, caption, coalesce(ids, '') AS caption_ids,"
    " CAST(coalesce(n, 0) AS INTEGER) AS n FROM h LEFT JOIN five ON five.id = h.id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = nearest(gallery(spark, sf), asked(spark, sf), 4, "ip")
    shown = attach_captions(hits, turns_as_captions(spark, sf), ["turn"])
    return shown.select(
        "qid",
        "rank",
        "id",
        "caption",
        F.array_join(F.col("captions.id"), ",").alias("caption_ids"),
        F.size("captions").alias("n"),
    )


@query(
    "search_results",
    f"WITH {VECTORS}, {knn_ctes('l2', 4)}, {FIVE_SQL}"
    " SELECT qid, rank, h.id, round(score, 6) AS distance, round(0 - score, 6) AS score,"
    " 'l2' AS metric, caption, coalesce(ids, '') AS caption_ids,"
    " 'data/images/' || h.id || '.jpg' AS image_path FROM h LEFT JOIN five ON five.id = h.id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = nearest(gallery(spark, sf), asked(spark, sf), 4, "l2")
    shown = search_results(
        hits, turns_as_captions(spark, sf), ["turn"], metric="l2", root="data/images"
    )
    return shown.withColumns(
        {
            "distance": F.round("distance", 6),
            "score": F.round("score", 6),
            "caption_ids": F.array_join(F.col("captions.id"), ","),
        }
    ).drop("captions")


# Streams ------------------------------------------------------------------------------------


@query("stream_ingest", HASH_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive as a file stream and end up in a vector store."""
    store = VectorStore(spark, scratch(spark, "ingest"), {"dim": 64}).create()
    source = arriving(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text"
    )
    stream_ingest(
        source,
        store,
        scratch(spark, "ingest-progress"),
        encoder=get_encoder(ENCODER),
        content="text",
        dataset_name="documents",
    ).awaitTermination()
    return elements(store.read(), vector="vector")


@query(
    "stream_search",
    f"WITH {VECTORS}, {knn_ctes('cosine', 5)} SELECT qid, rank, id, round(score, 6) AS score FROM h",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    source = arriving(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("qid"), "embedding"
    )
    output = scratch(spark, "answers")
    stream_search(
        source, gallery(spark, sf), 5, output, scratch(spark, "answers-progress")
    ).awaitTermination()
    return rounded(spark.read.parquet(output))


# Query preparation --------------------------------------------------------------------------


@query(
    "prepare_queries",
    """WITH q AS (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN 'train' ELSE 'test' END AS split
      FROM benchmark),
    a AS (SELECT page_id % (SELECT max(item_id) + 1 FROM benchmark) AS item_id,
          'img/' || page_id || '.jpg' AS path FROM pages)
    SELECT CAST(q.item_id AS VARCHAR) AS id, q.item_id AS query_id,
           regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query_text, 'hash' AS model_name,
           'pages' AS dataset_name, split, '' AS category,
           CAST(count(path) AS INTEGER) AS labels, min(path) AS first_label, CAST(1 AS DOUBLE) AS norm
    FROM q LEFT JOIN a USING (item_id) GROUP BY q.item_id, text, split""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All benchmark items as queries, with annotations over the whole range of their ids."""
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query_text"),
        F.lit(None).cast("string").alias("category"),
    )
    ids = items.agg((F.max("query_id") + 1).alias("ids")).first()["ids"]
    labels = table(spark, sf, "pages").select(
        (F.col("page_id") % F.lit(ids)).alias("query_id"),
        F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("image_path"),
    )
    return _prepared(spark, items, labels)


def _prepared(spark: SparkSession, items: DataFrame, labels: DataFrame) -> DataFrame:
    """The prepared rows of both splits, read back from their shards."""
    even = F.col("query_id") % 2 == 0
    path = scratch(spark, "prepared")
    prepare_queries(
        {"train": (items.where(even), labels), "test": (items.where(~even), labels)},
        get_encoder(ENCODER),
        path,
        dataset_name="pages",
        chunk_size=4,
    )
    rows = spark.read.parquet(path)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x * x))
    return rows.select(
        "id",
        "query_id",
        "query_text",
        "model_name",
        "dataset_name",
        "split",
        "category",
        F.size("image_id").alias("labels"),
        F.array_min("image_id").alias("first_label"),
        F.round(norm, 4).alias("norm"),
    )
