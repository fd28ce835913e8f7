"""Benchmark decontamination by templates.

Texts are canonicalised: numbers, names and units become typed placeholders, so a question with
other numbers or names in it has the same template. Windows of the benchmark's templates are joined
by hash with those of the documents. Matched windows of neighbouring alignments count together, so
an edited copy is found, and a verbatim run counts whatever the item's length. Slots are consistent
if along one alignment every value of the benchmark answers to one value of the document; where one
does not, the windows without its slots are left. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import own_name, small, written

# Tokens of a template window; shorter items are one window, down to LEAST tokens.
WINDOW = 8
LEAST = 5
# Share of an item's windows that must match along neighbouring alignments.
SHARE = 0.3
# Tokens in a row that count as a leak of any item, if their slots hold the item's own values.
RUN = 13
# Benchmark windows that are still sent to every executor (about 100 bytes each).
BROADCAST_WINDOWS = 400_000
BROADCAST_TEXTS = 1_000_000

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"  # private characters, one token each
# Units that follow a number, and numbers written out.
UNITS = (
    "kg|g|mg|lb|lbs|km|m|cm|mm|mi|mile|miles|meter|meters|metre|metres|feet|foot|ft|inch|inches|"
    "litre|litres|liter|liters|l|ml|hour|hours|hr|hrs|minute|minutes|min|second|seconds|sec|day|"
    "days|week|weeks|month|months|year|years|dollar|dollars|euro|euros|cent|cents|percent"
)
WRITTEN = (
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|"
    "hundred|thousand|million"
)
_PLACE = f"[{NAME}-{UNIT}]"
# Everything but letters with their marks, digits and placeholders.
_GAP = rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}-{UNIT}]+"
_ALONE = r"(?![\p{L}\p{M}\p{N}])"
# A number with its unit or the ending of an ordinal written to it.
_ATTACHED = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])([0-9]++)(?=(?i:{UNITS}|st|nd|rd|th){_ALONE})"


def _plain(text: Column) -> Column:
    """Numbers without marks inside and apart from their units, so that each is one token."""
    joined = F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", "")
    return F.regexp_replace(joined, _ATTACHED, "$1 ")


def template(text: Column) -> Column:
    """Tokens of the canonical text: lower case, placeholders for numbers, names and units.

    A name is a capitalised word behind a lower-case letter, digit, comma or semicolon and a space.
    """
    named = F.regexp_replace(
        _plain(text), r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}++" + _ALONE, NAME
    )
    figures = F.regexp_replace(
        F.lower(named), rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]++|(?:{WRITTEN})){_ALONE}", NUMBER
    )
    return _cut(F.regexp_replace(figures, rf"(?<={NUMBER} )(?:{UNITS}){_ALONE}", UNIT))


def values(text: Column) -> Column:
    """The same tokens with their own values, place by place."""
    return _cut(F.lower(_plain(text)))


def _cut(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda token: token != "")


def window_keys(tokens: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` tokens; none if there are fewer tokens."""
    last = F.size(tokens) - width
    keys = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(width)]),
    )
    return F.when(last >= 0, keys).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """One row per window of an item that has at least half of its tokens outside slots."""
    items = benchmark.where(F.col(text).isNotNull()).select(
        F.col(item).alias("item_id"),
        F.xxhash64(F.col(text)).alias("item_mark"),
        template(F.col(text)).alias("tokens"),
        values(F.col(text)).alias("values"),
    )
    long_enough = items.where(F.size("tokens") >= LEAST).withColumn(
        "width", F.least(F.size("tokens"), F.lit(WINDOW))
    )
    keyed = None
    for width in range(LEAST, WINDOW + 1):
        part = long_enough.where(F.col("width") == width)
        keys = window_keys(F.col("tokens"), width)
        # Whether an item's first word is a name depends on what stands before it in a document,
        # so its first window has a second key.
        opening = F.xxhash64(F.lit(NAME), *[F.get("tokens", F.lit(j)) for j in range(1, width)])
        for rows in (
            part.withColumn("keys", keys),
            part.withColumn("keys", F.array(opening)),
        ):
            keyed = rows if keyed is None else keyed.unionByName(rows)
    windows = keyed.select(
        "item_id", "item_mark", "tokens", "values", "width", F.posexplode("keys").alias("at", "key")
    )
    literal = F.size(
        F.filter(F.slice("tokens", F.col("at") + 1, F.col("width")), lambda t: ~t.rlike(_PLACE))
    )
    return windows.where(literal * 2 >= F.col("width"))


def _mark(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains.

    Result, one row per pair: ``doc_id``, ``mark`` (digest of id and text), ``item_id``,
    ``matched`` and ``windows`` (those of the item that match along the best neighbourhood of
    alignments, and all it has). Alignments are neighbours if they are less than the item's tokens
    apart. Windows whose slots are contradicted do not count; a neighbourhood counts from ``share``
    of the windows on, or with ``RUN`` tokens in a row as the item has them. Null and empty texts on either side match nothing; items below ``LEAST`` tokens, or
    without a window that is half literal, cannot be told from ordinary text and match nothing;
    repeated rows give one row; equal items match alike; an empty side gives no rows.
    """
    windows = written(item_windows(benchmark, item, item_text), "bench-windows")
    windows = windows.dropDuplicates(["item_id", "item_mark", "at", "key"])
    keys = small(windows.select("item_id", "item_mark", "width", "key", "at"), BROADCAST_WINDOWS)
    widths = [row["width"] for row in windows.select("width").distinct().collect()]
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("doc_id"),
        _mark(key, text).alias("mark"),
        template(F.col(text)).alias("tokens"),
    )
    hits = None
    for width in sorted(widths) or [WINDOW]:
        exploded = rows.select(
            "doc_id", "mark", F.posexplode(window_keys(F.col("tokens"), width)).alias("pos", "key")
        ).withColumn("width", F.lit(width))
        part = exploded.join(keys, ["width", "key"]).select(
            "doc_id", "mark", "item_id", "item_mark", "at", (F.col("pos") - F.col("at")).alias("shift")
        )
        hits = part if hits is None else hits.unionByName(part)
    # A window that an item repeats matches at several shifts; an alignment is one shift.
    pair = ["doc_id", "mark", "item_id", "item_mark"]
    lines = hits.groupBy(*pair, "shift").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    sizes = windows.groupBy("item_id", "item_mark").agg(
        F.count_distinct("at").alias("windows"),
        F.first("width").alias("width"),
        F.first("tokens").alias("tokens"),
        F.first("values").alias("values"),
    )
    # What cannot count with all its windows, wherever they are, goes before slots are looked at.
    grouped = lines.groupBy(*pair).agg(F.collect_list(F.struct("shift", "ats")).alias("lines"))
    able = grouped.join(
        small(written(sizes, "bench-sizes"), BROADCAST_TEXTS), ["item_id", "item_mark"]
    ).where(
        (F.size(F.array_distinct(F.flatten("lines.ats"))) >= F.col("windows") * share)
        | F.exists("lines", lambda line: _in_a_row(line["ats"], F.col("width")))
    )
    lines = able.select(
        *pair, "windows", "width", "tokens", "values", F.explode("lines").alias("line")
    ).select("*", "line.shift", "line.ats")
    lines = written(
        lines.select(
            *pair,
            "shift",
            "ats",
            "windows",
            "width",
            F.size("tokens").alias("length"),
            slots().alias("slots"),
        ),
        "bench-lines",
    )
    held = _held(docs, lines, key, text)
    # Neighbouring alignments are those of one stretch of the document.
    order = Window.partitionBy(*pair).orderBy("shift")
    far = F.coalesce(F.col("shift") - F.lag("shift").over(order) >= F.col("length"), F.lit(False))
    stretches = (
        held.withColumn("far", far.cast("int"))
        .withColumn("stretch", F.sum("far").over(order))
        .groupBy(*pair, "stretch")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("left")))).alias("left"),
            F.max("run").alias("run"),
            F.first("windows").alias("windows"),
        )
    )
    return (
        stretches.where((F.col("left") >= F.col("windows") * share) | F.col("run"))
        .groupBy("doc_id", "mark", "item_id")
        .agg(F.max("left").alias("matched"), F.max("windows").alias("windows"))
    )


def _in_a_row(ats: Column, width: Column) -> Column:
    """Whether sorted distinct places hold ``RUN`` tokens in a row."""
    more = F.lit(RUN) - width
    starts = F.sequence(F.lit(0), F.greatest(F.size(ats) - more - 1, F.lit(0)))
    return (F.size(ats) > more) & F.exists(starts, lambda i: F.get(ats, i + more) - F.get(ats, i) == more)


def slots() -> Column:
    """Places and values of the item's placeholders that its matched windows cover."""
    places = F.transform(
        F.col("tokens"),
        lambda token, i: F.struct(
            i.alias("at"), token.alias("kind"), F.get(F.col("values"), i).alias("value")
        ),
    )
    return F.filter(
        places,
        lambda s: s["kind"].rlike(_PLACE)
        & F.exists("ats", lambda a: (a <= s["at"]) & (s["at"] < a + F.col("width"))),
    )


def _held(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """The windows of each alignment that its slots allow.

    ``left`` has no window with a slot whose value answers to two values of the document; ``run``
    says whether ``RUN`` tokens in a row are as the item has them.
    """
    plain = lines.where(F.size("slots") == 0).select(
        "*", F.col("ats").alias("left"), F.col("ats").alias("same")
    )
    slotted = lines.where(F.size("slots") > 0)
    marks = written(slotted.select("mark").distinct(), "bench-marks")
    texts = (
        docs.where(F.col(text).isNotNull())
        .select(_mark(key, text).alias("mark"), F.col(text).alias("text"))
        .join(small(marks, BROADCAST_TEXTS), "mark", "left_semi")
        .dropDuplicates(["mark"])
        .select("mark", values(F.col("text")).alias("own"))
    )
    pairs = F.transform(
        "slots",
        lambda s: F.struct(
            s["at"].alias("at"),
            s["kind"].alias("kind"),
            s["value"].alias("theirs"),
            F.get(F.col("own"), s["at"] + F.col("shift")).alias("ours"),
        ),
    )

    def same_value(one: Column, two: Column) -> Column:
        return (one["kind"] == two["kind"]) & (one["theirs"] == two["theirs"])

    def outside(windows: str, places: str) -> Column:
        """The windows that hold none of the places."""
        return F.filter(
            windows,
            lambda a: ~F.exists(places, lambda s: (a <= s["at"]) & (s["at"] < a + F.col("width"))),
        )

    checked = (
        slotted.join(texts, "mark")
        .withColumn("pairs", pairs)
        .withColumn(
            "answers",
            F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["theirs"], p["ours"]))),
        )
        .withColumn(
            "torn",
            F.filter(
                "answers",
                lambda one: F.size(F.filter("answers", lambda two: same_value(one, two))) > 1,
            ),
        )
        .withColumn(
            "odd", F.filter("pairs", lambda p: F.exists("torn", lambda one: same_value(one, p)))
        )
        .withColumn("changed", F.filter("pairs", lambda p: ~p["theirs"].eqNullSafe(p["ours"])))
        .withColumn("left", outside("ats", "odd"))
        .withColumn("same", outside("left", "changed"))
    )
    return (
        plain.unionByName(checked.select(*plain.columns))
        .where(F.size("left") > 0)
        .withColumn("run", _in_a_row(F.col("same"), F.col("width")))
    )


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns as they are."""
    found = contaminated(docs, benchmark, key, text).select("mark").distinct()
    found = written(found, "bench-found")
    mark = own_name(docs.columns, "mark")
    marked = docs.withColumn(mark, _mark(key, text))
    found = found.withColumnRenamed("mark", mark)
    return marked.join(small(found, BROADCAST_TEXTS), mark, "left_anti").drop(mark)
