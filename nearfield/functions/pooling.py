"""Token vectors to one vector per item, as long-form aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import l2_normalize
from nearfield.session import short_table

# Token ids that open and close an image span.
VISION_START, VISION_END = 151652, 151653


def mean_pool(
    tokens: DataFrame, key: str = "id", vector: str = "embedding", *, normalize: bool = True
) -> DataFrame:
    """Mean of an item's token vectors, then unit length.

    Sums are per (item, dimension), so they combine before the shuffle and an item with a huge
    number of tokens is never gathered in one place.
    """
    means = (
        tokens.select(key, F.posexplode(vector).alias("dim", "x"))
        .groupBy(key, "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    pooled = means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias(
            vector
        )
    )
    return pooled.withColumn(vector, l2_normalize(F.col(vector))) if normalize else pooled


def span_tokens(
    tokens: DataFrame,
    key: str = "id",
    position: str = "token_pos",
    token: str = "token_id",
    start: int = VISION_START,
    end: int = VISION_END,
) -> DataFrame:
    """Tokens from the first start marker to the first end marker, both included.

    Items without a start marker keep all their tokens.
    """
    def marked(value: int, name: str) -> Column:
        return F.min(F.when(F.col(token) == value, F.col(position))).alias(name)

    # Two numbers per item: broadcast while short, so a huge item stays where its tokens are.
    marks = short_table(tokens.groupBy(key).agg(marked(start, "_from"), marked(end, "_to")))
    inside = F.col("_from").isNull() | F.col(position).between(F.col("_from"), F.col("_to"))
    return tokens.join(marks, key).where(inside).drop("_from", "_to")


def span_pool(tokens: DataFrame, key: str = "id", vector: str = "embedding", **marks) -> DataFrame:
    return mean_pool(span_tokens(tokens, key, **marks), key, vector)
