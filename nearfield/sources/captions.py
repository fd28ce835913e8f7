"""Caption files: one JSON object per line with an image name and one or more captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.ids import caption_id, image_id_of, running_before
from nearfield.schema import CAPTION_ROW
from nearfield.session import materialise, short_table


def read_captions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``index, caption_id, caption, image, image_id`` in file order."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    return number_in_file_order(
        explode_captions(lines.where(F.col("value").rlike(r"\S")), ["_file", "_block"])
    ).select(*CAPTION_ROW.fieldNames())


def number_in_file_order(rows: DataFrame) -> DataFrame:
    """Global 0-based ``index`` of scanned rows, without moving them.

    A task reads its splits one after the other and keeps their line order, so a row's place is
    its place in the split plus the rows of all splits before it. The rows are written once
    first: the numbers must come from the very splits that are counted.
    """
    held = materialise(rows.withColumn("_at", F.monotonically_increasing_id()))
    splits = held.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("low"))
    # One row per split of the input, summed in two levels: no task gets all of them.
    starts = running_before(splits, ["_file", "_block"], "n", "start").drop("n")
    return (
        held.join(short_table(starts), ["_file", "_block"])
        .withColumn("index", F.col("start") + F.col("_at") - F.col("low"))
        .drop("_file", "_block", "_at", "low", "start")
    )


def explode_captions(lines: DataFrame, keep: list[str]) -> DataFrame:
    """One row per caption without the global index."""
    parsed = lines.select(*keep, _payload(F.col("value")).alias("p"))
    named = parsed.select(
        *keep,
        F.coalesce(F.col("p.image"), F.lit("")).alias("image"),
        F.posexplode(_captions(F.col("p.caption"))).alias("_pos", "caption"),
    )
    image_id = image_id_of(F.col("image"))
    return named.withColumn("image_id", image_id).withColumn(
        "caption_id", caption_id(F.col("image_id"), F.col("_pos"))
    )


def _payload(line: Column) -> Column:
    """``image, caption`` with the caption kept as raw JSON; a broken line fails the job."""
    parsed = F.from_json(line, "image string, caption variant", {"mode": "FAILFAST"})
    return parsed


def _captions(caption: Column) -> Column:
    """A string is a list of one; a missing caption is an empty list."""
    text = F.expr("variant_get(p.caption, '$', 'string')")
    kind = F.schema_of_variant(caption)
    many = F.try_variant_get(caption, "$", "array<string>")
    return (
        F.when(caption.isNull(), F.array().cast("array<string>"))
        .when(kind.startswith("ARRAY"), many)
        .when(kind == "VOID", F.array().cast("array<string>"))
        .otherwise(F.array(text))
    )


def caption_line(image: Column, captions: Column) -> Column:
    """The JSON line of one image."""
    return F.to_json(F.struct(captions.alias("caption"), image.alias("image")))


def export_captions_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``image, caption`` rows as JSON lines (many files; read back as one folder)."""
    df.select(caption_line(F.col("image"), F.col("caption"))).write.mode(mode).text(path)


def get_record(captions: DataFrame, index: int) -> DataFrame:
    return captions.where(F.col("index") == int(index))
