"""Search by text, by item and by caption, and the result rows shown to people."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.encoders import Encoder, encode_column, spread
from nearfield.functions.ids import image_path, row_index
from nearfield.functions.labels import strip
from nearfield.functions.vectors import similarity_score
from nearfield.operators.knn import nearest
from nearfield.operators.rerank import join_popular
from nearfield.session import materialise, short_table

Search = Callable[..., DataFrame]
CAPTIONS_PER_HIT = 5


def search_by_text(
    gallery: DataFrame,
    texts: DataFrame,
    encoder: Encoder,
    k: int,
    metric: str = "cosine",
    *,
    search: Search = nearest,
    **options,
) -> DataFrame:
    """Encode ``qid, text`` rows and search; a blank text is an error."""
    asked = texts.select("qid", strip(F.col("text")).alias("text"))
    if asked.where((F.col("text") == "") | F.col("text").isNull()).head(1):
        raise ValueError("Text query must not be empty")
    # Encoded once; the search reads the vectors more than one time.
    queries = materialise(encode_column(asked, "text", encoder).select("qid", "embedding"))
    return search(gallery, queries, k, metric, **options)


def vectors_of(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``qid, embedding`` of the named rows; an unknown id is a KeyError."""
    named = ids.select("qid", F.col(key).alias("_key"))
    held = table.select(F.col("id").alias("_key"), "embedding")
    found = materialise(named.join(held, "_key", "left"))
    absent = found.where(F.col("embedding").isNull()).head(1)
    if absent:
        raise KeyError(absent[0]["_key"])
    # A join of short rows ends in few partitions, each of which one core would search.
    return spread(found.select("qid", "embedding"))


def search_by_image(
    gallery: DataFrame, ids: DataFrame, k: int, metric: str = "cosine", *, search=nearest, **options
) -> DataFrame:
    """Neighbours of gallery rows named by ``qid, image_id``; a row is its own neighbour."""
    return search(gallery, vectors_of(gallery, ids, "image_id"), k, metric, **options)


def search_by_caption(
    gallery: DataFrame,
    captions: DataFrame,
    ids: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    search: Search = nearest,
    **options,
) -> DataFrame:
    """Gallery neighbours of captions named by ``qid, caption_id``."""
    return search(gallery, vectors_of(captions, ids, "caption_id"), k, metric, **options)


def captions_by_image(
    captions: DataFrame, order: Sequence[str], image: str = "image_id"
) -> DataFrame:
    """Captions with their position inside their image, in source order.

    Long form instead of one list per image: rows are range partitioned on (image, order), so an
    image that owns a third of the captions is spread over many tasks.
    """
    named = captions.where(F.col(image).isNotNull() & (F.col(image).cast("string") != ""))
    placed = row_index(named, [image, *order], "_row")
    # One row per image: broadcast while short, so the crowded image is not hashed to one task.
    first = short_table(placed.groupBy(image).agg(F.min("_row").alias("_first")))
    return (
        placed.join(first, image)
        .withColumn("position", F.col("_row") - F.col("_first"))
        .drop("_row", "_first")
    )


def first_captions(
    captions: DataFrame, order: Sequence[str], image: str = "image_id", n: int = CAPTIONS_PER_HIT
) -> DataFrame:
    """The first captions of each image as a list of at most ``n``, plus the primary one."""
    window = Window.partitionBy(image).orderBy(*order)
    few = captions.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n)
    return (
        few.groupBy(image)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "id", "caption"))).alias("_list"))
        .select(
            F.col(image).cast("string").alias("id"),
            F.col("_list")[0]["caption"].alias("caption"),
            F.transform(
                "_list", lambda c: F.struct(c["id"].alias("id"), c["caption"].alias("caption"))
            ).alias("captions"),
        )
    )


def attach_captions(
    hits: DataFrame, captions: DataFrame, order: Sequence[str], image: str = "image_id"
) -> DataFrame:
    """Up to five captions per hit; only captions of images that were hit are ranked."""
    wanted = hits.select(F.col("id").alias(image)).distinct()
    needed = captions.withColumn(image, F.col(image).cast("string")).join(
        wanted, image, "left_semi"
    )
    lists = first_captions(needed, order, image)
    none = F.array().cast(lists.schema["captions"].dataType)
    # A popular image is hit by many queries: its captions travel to the hits.
    joined = join_popular(hits, lists, "id", "left")
    return joined.withColumn("captions", F.coalesce("captions", none))


def search_results(
    hits: DataFrame,
    captions: DataFrame,
    order: Sequence[str],
    *,
    metric: str,
    root: str,
    pattern: str = "{id}.jpg",
    image: str = "image_id",
) -> DataFrame:
    """Rank, id, distance, score (larger is better), metric, captions and image path."""
    shown = attach_captions(hits, captions, order, image)
    return shown.select(
        "qid",
        "rank",
        "id",
        F.col("score").alias("distance"),
        similarity_score(F.col("score"), metric).alias("score"),
        F.lit(metric).alias("metric"),
        "caption",
        "captions",
        image_path(root, pattern, F.col("id").cast("string")).alias("image_path"),
    )


def corpus_status(
    images: DataFrame, captions: DataFrame | None, order: Sequence[str], samples: int = 5
) -> DataFrame:
    """Counts, loaded flags and the first few captions in one row."""
    held, first = 0, []
    if captions is not None:
        held = captions.count()
        first = [row["id"] for row in captions.orderBy(*order).limit(samples).collect()]
    row = (images.count(), True, held, captions is not None, [str(name) for name in first])
    return images.sparkSession.createDataFrame(
        [row],
        "image_count long, images_loaded boolean, caption_count long,"
        " caption_embeddings_loaded boolean, sample_captions array<string>",
    )
