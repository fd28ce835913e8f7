"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. A pattern's matches and the gaps between them come from one ``split`` and
one ``regexp_extract_all``; aggregates over the two turn lengths into positions in code points.
Patterns are possessive wherever what follows cannot match inside, so matching takes linear time and
constant stack for texts of any length. n matches are gathered in blocks of the square root of n, so
lists are copied n to the power 1.5 times at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Added kinds count from this score on; the base kinds always do.
ACCEPT_FROM = 0.6
# Characters before a span in which context words are looked for.
CONTEXT = 48
# What a context word adds to the score.
CONTEXT_BONUS = 0.3
# Bits a character of a secret needs at least, over the secret's own characters.
SECRET_BITS = 3.0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a digit string: every second digit from the right counts double."""
    backward = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    weighted = F.transform(
        backward,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")
        ),
    )
    return F.aggregate(weighted, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(account: Column) -> Column:
    """The account check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    characters = F.filter(F.split(moved, ""), lambda c: c != "")
    remainder = F.aggregate(
        characters,
        F.lit(0),
        lambda rest, c: F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise(
            (rest * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return remainder == 1


def _octets(hit: Column) -> Column:
    """Four parts of at most 255 each; leading zeros do not count."""
    return F.forall(
        F.transform(F.split(hit, "\\."), lambda part: F.ltrim(part, F.lit("0"))),
        lambda part: (F.length(part) <= 3)
        & (F.coalesce(F.substring(part, 1, 3).try_cast("int"), F.lit(0)) <= 255),
    )


def entropy(word: Column) -> Column:
    """Bits a character by the word's own counts of characters."""
    size = F.length(word)
    kinds = F.array_distinct(F.filter(F.split(word, ""), lambda c: c != ""))
    share = F.transform(kinds, lambda c: (size - F.length(F.replace(word, c, F.lit("")))) / size)
    return F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))


@dataclass(frozen=True)
class Kind:
    """A pattern, the check that confirms a match, its score, and words that raise the score."""

    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    words: str


_LOCAL = "[A-Za-z0-9._%+-]"
BASE = (
    Kind(
        "email",
        # A match may start where the last one ended, or where no local part goes on.
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda hit: F.lit(True),
        0.9,
        "mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _octets,
        0.7,
        "ip|host|server|address",
    ),
    Kind(
        "card",
        # Whole chains of digits only; chains below twelve digits are passed over.
        r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){11})[0-9](?:[ -]?[0-9])++",
        lambda hit: F.length(_digits(hit)).between(12, 19) & luhn(_digits(hit)),
        0.8,
        "card|visa|credit|pay",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda hit: F.length(_digits(hit)).between(9, 15),
        0.7,
        "phone|tel|call|mobile|fax",
    ),
)
ADDED = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
        mod97,
        0.9,
        "iban|account|konto|compte|cuenta",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda hit: F.lit(True),
        0.4,
        "ssn|social security",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
        lambda hit: F.lit(True),
        0.4,
        "phone|tel|call|mobile|fax",
    ),
    Kind(
        "secret",
        # What is assigned to a name for secrets; the value alone is the span.
        r"(?<=[\"'=: ])(?=[A-Za-z0-9+/_=-]{16})"
        r"(?<=(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)"
        r"[\"']? ?[=:] ?[\"']?)[A-Za-z0-9+/_=-]{16,512}+(?![A-Za-z0-9+/_=-])",
        lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (entropy(hit) >= SECRET_BITS),
        0.7,
        "token|secret|passw|pwd|key",
    ),
)

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"
_PLACED = "array<struct<start:int,hit:string,before:string>>"


def _tail(*parts: Column) -> Column:
    return F.right(F.concat(*parts), F.lit(CONTEXT))


def _state(at: Column, tail: Column, found: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), tail.alias("tail"), found.alias("found"))


def _placed(pairs: Column) -> Column:
    """Every match with its start and the ``CONTEXT`` characters before it.

    The list of a block grows by copying, and so does the list of blocks; both are short.
    """
    none = F.lit(None).cast(_PLACED)

    def follow(seen: Column, pair: Column) -> Column:
        start = (seen["at"] + F.length(pair["gap"])).cast("int")
        before = _tail(seen["tail"], pair["gap"])
        one = F.array(
            F.struct(start.alias("start"), pair["hit"].alias("hit"), before.alias("before"))
        )
        return F.when(pair["hit"].isNull(), seen).otherwise(
            _state(
                start + F.length(pair["hit"]),
                _tail(before, pair["hit"]),
                F.when(seen["found"].isNull(), one).otherwise(F.concat(seen["found"], one)),
            )
        )

    def block(seen: Column, part: Column) -> Column:
        inner = F.aggregate(part, _state(seen["at"], seen["tail"], none), follow)
        one = lambda got: F.array(F.coalesce(got["found"], F.array().cast(_PLACED)))
        # One element, so that the inner list is made once and used three times.
        joined = F.transform(
            F.array(inner),
            lambda got: _state(
                got["at"],
                got["tail"],
                F.when(seen["found"].isNull(), one(got)).otherwise(
                    F.concat(seen["found"], one(got))
                ),
            ),
        )
        return F.get(joined, F.lit(0))

    def in_blocks(all_pairs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_pairs))).cast("int")
        return F.transform(
            F.sequence(F.lit(1), F.size(all_pairs), width),
            lambda first: F.slice(all_pairs, first, width),
        )

    blocks = F.get(F.transform(F.array(pairs), in_blocks), F.lit(0))
    nothing = _state(F.lit(0), F.lit(""), F.lit(None).cast(f"array<{_PLACED}>"))
    return F.aggregate(blocks, nothing, block, lambda seen: F.flatten(seen["found"]))


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind in order, with their scores."""
    pairs = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"),
    )
    found = _placed(pairs)
    near = rf"(?i)\b(?:{kind.words})"

    def scored(span: Column) -> Column:
        bonus = F.when(span["before"].rlike(near), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            span["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind.name).alias("kind"),
            (span["start"] + F.length(span["hit"])).cast("int").alias("end"),
            F.least(F.lit(1.0), F.lit(kind.score) + bonus).alias("score"),
        )

    kept = F.transform(F.filter(found, lambda span: kind.confirmed(span["hit"])), scored)
    none = F.array().cast(_SPANS)
    return F.coalesce(F.when(text.rlike(kind.pattern), kept), none).cast(_SPANS)


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its ``doc_id``, the spans of every kind, and ``base`` and ``spans`` over all.

    Every base match that its check confirms is a span whatever its score; an added kind needs
    ``ACCEPT_FROM`` and must not touch a base span. Positions count code points, the end is
    exclusive. A null text is empty; repeated rows stay; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("body"))
    found = rows.select(
        "doc_id",
        *[spans_of(F.col("body"), k, i).alias(k.name) for i, k in enumerate(BASE + ADDED)],
    )
    whole = found.withColumn("base", F.concat(*[F.col(k.name) for k in BASE]))
    added = F.filter(
        F.concat(*[F.col(k.name) for k in ADDED]),
        lambda a: (a["score"] >= ACCEPT_FROM)
        & ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])),
    )
    return whole.withColumn("spans", F.array_sort(F.concat("base", added)))
