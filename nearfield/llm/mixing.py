"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. Inside a source, a document of ``g`` size bits is wanted
``min(cap, k * g)`` times, with ``k`` such that the wanted words make up the target. The whole part
is allocated for certain; the fraction ``p`` is drawn by Pareto order sampling: documents are ranked
by the odds of a uniform number over the odds of ``p``, and the ranking is taken until it has the
words that are left. Uniform numbers come from a digest of seed, id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import own_name, small, words_in, written

CAP = 3
# Bins of the ranking that are summed before single rows are looked at.
BINS = 16_384
# Sources whose figures are still sent to every executor (below 100 bytes each).
BROADCAST_SOURCES = 200_000


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest."""
    part = F.concat_ws(
        "|",
        F.lit(str(seed)),
        F.coalesce(key.cast("string"), F.lit("")),
        F.md5(F.coalesce(text, F.lit(""))),
    )
    bits = F.conv(F.substring(F.md5(part), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(classes: DataFrame) -> DataFrame:
    """Targets of the sources, from words by source and size class.

    Sources in code point order, null last, weigh 1, 2, 3 and so on again; they share all words by
    weight, and what exceeds ``CAP`` times a source's words is shared again among the rest. The
    closed form: with sources ordered by cap over weight, the level is that of the first source
    whose cap is not below it. One row per source, hence windows without a partition.
    """
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.select(
        "source",
        "source_size",
        ((F.row_number().over(order) - 1) % 3 + 1).cast("long").alias("weight"),
        (F.col("source_size") * CAP).alias("cap"),
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    # Levels fall again behind the first that holds, so that one is the greatest of those that do.
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything)
    return levels.withColumn("common", level).select(
        "source",
        "source_size",
        F.least(
            F.col("cap").cast("double"),
            F.col("weight") * F.coalesce(F.col("common"), F.col("cap").cast("double")),
        ).alias("target"),
    )


def class_copies(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """Copies wanted of each document of a source and size class: ``min(CAP, k * bits)``."""
    named = targets.withColumnRenamed("source", "of")
    rows = classes.where("bits > 0").join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    by_bits = Window.partitionBy("source").orderBy(F.col("bits").desc())
    before = by_bits.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_bits.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("source")
    factors = rows.withColumn(
        "k",
        (F.col("target") - CAP * F.coalesce(F.sum("words").over(before), F.lit(0)))
        / F.sum(F.col("words") * F.col("bits")).over(onward),
    ).withColumn(
        # The first class, from the largest down, that the cap does not reach sets the factor.
        "factor",
        F.max_by(
            F.when(F.col("k") * F.col("bits") <= CAP, F.col("k")),
            F.when(F.col("k") * F.col("bits") <= CAP, F.col("bits")),
        ).over(whole),
    )
    wanted = F.least(
        F.lit(float(CAP)), F.coalesce(F.col("factor") * F.col("bits"), F.lit(float(CAP)))
    )
    return factors.select(
        "source",
        "bits",
        "words",
        "source_size",
        "target",
        F.floor(wanted).alias("certain"),
        (wanted - F.floor(wanted)).alias("p"),
    )


def rank_value(u: Column, p: Column) -> Column:
    """Pareto rank: odds of the uniform number over odds of the fraction; null if nothing is drawn."""
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def rank_bin(q: Column) -> Column:
    return F.floor(q / (1 + q) * BINS)


def _key(source: Column) -> Column:
    """Sources as join keys, null included."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(
    docs: DataFrame,
    seed: int = 20,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Every row of ``docs`` with the copies the mix takes of it.

    Result: ``rec`` (the whole input row), ``size`` (words), ``source_size``, ``target`` and
    ``copies`` (0 to ``CAP``). A null or empty text has no words and is taken 0 times; null is a
    source of its own; repeated rows are drawn one by one; an empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"),
        words_in(F.col(text)).alias("size"),
        F.col(source).cast("string").alias("source"),
        uniform(F.col(key), F.col(text), seed).alias("u"),
    ).withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(F.lit(0)))
    narrow = written(rows.select("source", "bits", "size", "u"), "mix-sizes")
    classes = narrow.groupBy("source", "bits").agg(F.sum("size").alias("words"))
    classes = written(classes, "mix-classes")
    wanted = class_copies(classes, source_targets(classes))
    wanted = written(wanted.withColumn("key", _key(F.col("source"))), "mix-wanted")

    drawn = (
        narrow.withColumn("key", _key(F.col("source")))
        .drop("source")
        .join(small(wanted.select("key", "bits", "p"), 32 * BROADCAST_SOURCES), ["key", "bits"])
        .withColumn("q", rank_value(F.col("u"), F.col("p")))
        .where("q IS NOT NULL")
        .withColumn("bin", rank_bin(F.col("q")))
    )
    left = wanted.groupBy("key").agg(
        (F.max("target") - F.sum(F.col("certain") * F.col("words"))).alias("budget")
    )
    # Sum the bins of every source, find the bin in which the budget ends, and look at its rows.
    running = Window.partitionBy("key").orderBy("bin")
    sums = drawn.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    edges = (
        sums.withColumn("upto", F.sum("words").over(running))
        .join(left, "key")
        .where(F.col("upto") > F.col("budget"))
        .groupBy("key", "budget")
        .agg(
            F.min("bin").alias("bin"),
            F.min_by(F.col("upto") - F.col("words"), "bin").alias("before"),
        )
    )
    edges = written(edges, "mix-edges")
    inside = Window.partitionBy("key").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    edge_rows = drawn.join(small(edges, BROADCAST_SOURCES), ["key", "bin"]).withColumn(
        "upto", F.col("before") + F.sum("size").over(inside)
    )
    taken = F.col("upto") - F.col("size") / 2 <= F.col("budget")
    last = edge_rows.groupBy("key").agg(
        F.min("bin").alias("bin"),
        F.max(F.when(taken, F.col("q"))).alias("cut"),
    )
    ties = (
        edge_rows.join(last.select("key", "cut"), "key")
        .where(F.col("q") == F.col("cut"))
        .groupBy("key")
        .agg(F.sum(F.when(taken, 1).otherwise(0)).alias("of_cut"))
    )
    # No edge: every fraction is taken. No cut: nothing of the edge bin is.
    cuts = last.join(ties, "key", "left").select(
        "key", F.col("bin").alias("edge"), "cut", F.coalesce("of_cut", F.lit(0)).alias("of_cut")
    )
    figures = wanted.join(cuts, "key", "left").select(
        "key", "bits", "source_size", "target", "certain", "p", "edge", "cut", "of_cut"
    )
    figures = written(figures, "mix-figures")
    totals = written(
        figures.groupBy("key").agg(
            F.max("source_size").alias("source_size"), F.max("target").alias("target")
        ),
        "mix-totals",
    )
    keyed = rows.withColumn("key", _key(F.col("source"))).drop("source")
    known = (
        keyed.join(
            small(figures.drop("source_size", "target"), 32 * BROADCAST_SOURCES),
            ["key", "bits"],
            "left",
        )
        .join(small(totals, BROADCAST_SOURCES), "key", "left")
        .withColumn("q", rank_value(F.col("u"), F.col("p")))
    )
    below = F.col("edge").isNull() | (rank_bin(F.col("q")) < F.col("edge"))
    at_edge = rank_bin(F.col("q")) == F.col("edge")
    is_cut = F.coalesce(at_edge & (F.col("q") == F.col("cut")), F.lit(False))
    extra = F.when(
        F.col("q").isNotNull() & (below | (at_edge & (F.col("q") < F.col("cut")))), 1
    ).otherwise(0)
    plain = known.where(~is_cut).withColumn("extra", extra)
    # Rows equal to the cut are repeated rows as a rule; exactly ``of_cut`` of them are taken.
    tied = known.where(is_cut).withColumn(
        "nth", F.row_number().over(Window.partitionBy("key").orderBy("q"))
    )
    tied = tied.withColumn("extra", F.when(F.col("nth") <= F.col("of_cut"), 1).otherwise(0))
    columns = [
        "rec",
        "size",
        F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.coalesce("certain", F.lit(0)) + F.col("extra")).cast("int").alias("copies"),
    ]
    return plain.select(*columns).unionByName(tied.select(*columns))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    names = mixed.schema["rec"].dataType.names
    copy = own_name(names, "copy")
    rows = mixed.where("copies > 0").select(
        "rec", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy)
    )
    return rows.select("rec.*")
