"""Second pass: score candidates exactly and keep the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import (
    l2_normalize,
    pair_score,
    pair_score_scaled,
    safe_norm,
)
from nearfield.operators.knn import check_metric, merge_hits
from nearfield.session import short_table


# A sketch of the keys that many rows share: keys it returns and keys it tracks, and the share of a
# task's even part from which on a key counts as heavy.
HEAVY_KEYS, TRACKED_KEYS, HEAVY_SHARE = 64, 4096, 0.5
# Below so many rows a task copes with any key.
HEAVY_ROWS = 10_000


def heavy_keys(df: DataFrame, key: str, least: int = HEAVY_ROWS) -> list:
    """The few keys that would crowd a task of a shuffle by ``key``; from one pass, unshuffled.

    A frequent-items sketch finds them. Its error is a small part of a task's even share, and a key
    that is missed or named without need only changes which join handles it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.where(F.col(key).isNotNull())
    row = named.agg(
        F.count("*").alias("n"),
        F.expr(f"approx_top_k(`{key}`, {HEAVY_KEYS}, {TRACKED_KEYS})").alias("top"),
    ).first()
    bound = max(least, HEAVY_SHARE * row["n"] / parts)
    return [item["item"] for item in row["top"] or () if item["count"] > bound]


def join_popular(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = HEAVY_ROWS
) -> DataFrame:
    """``left`` joined with the rows of ``right`` on a key that few values may crowd on the left.

    Rows of heavy keys stay where they are: the right rows of those keys (named in a filter that
    reaches the scan) travel to them if they are short enough. The rest is joined as usual.
    """
    heavy = heavy_keys(left, key, least)
    if not heavy:
        return left.join(right, key, how)
    crowded = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    popular = left.where(crowded).join(short_table(right.where(F.col(key).isin(heavy))), key, how)
    return popular.unionByName(left.where(~crowded).join(right.where(~crowded), key, how))


def rerank_exact(
    candidates: DataFrame,
    gallery: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    normalize: bool | None = None,
) -> DataFrame:
    """Rescore ``qid, id`` candidates with equi joins and built-in array functions.

    Only the candidates' vectors travel: the gallery joins on its id, and Catalyst broadcasts the
    candidate side when its measured size allows it. Ids that a large part of the hits share are
    joined apart, so none of them crowds a task.
    """
    metric = check_metric(metric)
    unit = metric == "cosine" if normalize is None else bool(normalize)

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        # The float vector and its norm travel through the joins, not a unit vector of doubles.
        scale = safe_norm(F.col("embedding")) if unit else F.lit(1.0)
        return df.select(key, F.col("embedding").alias(f"{name}_vector"), scale.alias(f"{name}_norm"))

    pairs = join_popular(
        candidates.select("qid", "id"), side(gallery, "id", "g"), "id"
    ).join(side(queries, "qid", "q"), "qid")
    left, right = F.col("q_vector"), F.col("g_vector")
    if not unit:
        score = pair_score(left, right, metric)
    elif metric == "l2":
        score = pair_score(l2_normalize(left), l2_normalize(right), "l2")
    else:
        score = pair_score_scaled(left, right, F.col("q_norm"), F.col("g_norm"))
    return merge_hits(pairs.select("qid", "id", score.alias("score")), k, metric)
