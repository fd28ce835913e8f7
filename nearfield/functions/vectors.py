"""Vector expressions built from Spark's array functions (scores in DOUBLE)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def squared_norm(vector: Column) -> Column:
    return _sum(F.transform(vector, lambda x: x.cast("double") * x.cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(squared_norm(vector))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return _divide(vector, safe_norm(vector))


def l2_normalize_eps(vector: Column, eps: float = 1e-9) -> Column:
    """Unit length with the norm clamped from below."""
    return _divide(vector, F.greatest(norm(vector), F.lit(eps)))


def _divide(vector: Column, by: Column) -> Column:
    # zip_with over a repeated divisor computes the norm once, not once per element.
    return F.zip_with(vector, F.array_repeat(by, F.size(vector)), lambda x, n: x.cast("double") / n)


def pair_score_ip(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")))


def pair_score_l2(left: Column, right: Column) -> Column:
    """Squared distance, never below zero."""

    def square(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.greatest(_sum(F.zip_with(left, right, square)), F.lit(0.0))


def pair_score_cosine(left: Column, right: Column) -> Column:
    """Dot product of the unit vectors; 0 when either side is a zero vector."""
    return pair_score_ip(l2_normalize(left), l2_normalize(right))


def pair_score_scaled(left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
    """``pair_score_cosine`` for norms that are already known (zero vectors carry norm 1)."""
    products = F.zip_with(
        left,
        right,
        lambda x, y: (x.cast("double") / left_norm) * (y.cast("double") / right_norm),
    )
    return _sum(products)


def safe_norm(vector: Column) -> Column:
    """The divisor that normalises a vector: its norm, or 1 for a zero vector."""
    length = norm(vector)
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def pair_score(left: Column, right: Column, metric: str) -> Column:
    scores = {"l2": pair_score_l2, "ip": pair_score_ip, "cosine": pair_score_cosine}
    if metric not in scores:
        raise ValueError("metric must be 'l2', 'ip', or 'cosine'")
    return scores[metric](left, right)


def similarity_score(distance: Column, metric: str) -> Column:
    """Larger is better for every metric (a distance of zero scores 0.0, not -0.0)."""
    return distance if metric in ("ip", "cosine") else F.lit(0.0) - distance


# Half precision: 11 significant bits, exponents from -14, largest value 65504.
_HALF_LEAST, _HALF_BITS, _HALF_OVER = -14, 10, 65520.0


def _half_step(value: Column) -> Column:
    """Spacing of half-precision numbers around a value, a power of two."""
    # A zero has no logarithm. An exponent one too low (at a power of two) rounds the same.
    power = F.greatest(F.coalesce(F.floor(F.log2(F.abs(value))), F.lit(_HALF_LEAST)), F.lit(_HALF_LEAST))
    return F.pow(F.lit(2.0), power - _HALF_BITS)


def half(value: Column) -> Column:
    """The nearest half-precision number, ties to even; held as float, as Spark has no half type."""
    exact = value.cast("double")
    step = _half_step(exact)
    # From halfway between 65504 and the next power of two on, a value is infinite.
    infinite = F.abs(exact) >= _HALF_OVER
    return (
        F.when(F.isnan(exact), exact)
        .when(infinite, F.signum(exact) * F.lit(float("inf")))
        .otherwise(F.rint(exact / step) * step)
        .cast("float")
    )


def cast_half(vector: Column | str) -> Column:
    """Values rounded to half precision (held as float); null elements stay null."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(vector, half)


def _half_bits(value: Column) -> Column:
    """The 16 bits of the nearest half-precision number."""
    exact = value.cast("double")
    step = _half_step(exact)
    # Exponent and fraction add up: a fraction that rounds up to a power of two carries over.
    power = F.log2(step) + _HALF_BITS - _HALF_LEAST
    size = F.round(power) * 1024 + F.rint(F.abs(exact) / step)
    # A negative zero has a sign of its own.
    negative = (exact < 0) | ((exact == 0) & (exact.cast("string") == "-0.0"))
    return (
        F.when(F.isnan(exact), F.lit(0x7E00))
        .otherwise(
            F.when(F.abs(exact) >= _HALF_OVER, F.lit(0x7C00)).otherwise(size.cast("int"))
            + F.when(negative, F.lit(0x8000)).otherwise(F.lit(0))
        )
        .cast("int")
    )


def pack_half(vector: Column | str) -> Column:
    """A vector as two bytes per element (little-endian half precision); no null elements."""
    vector = F.col(vector) if isinstance(vector, str) else vector

    def digits(value: Column) -> Column:
        four = F.lpad(F.hex(_half_bits(value).cast("long")), 4, "0")
        return F.concat(F.substring(four, 3, 2), F.substring(four, 1, 2))

    return F.unhex(F.array_join(F.transform(vector, digits), ""))


def unpack_half(packed: Column | str) -> Column:
    """The vector that ``pack_half`` packed, as floats."""
    packed = F.col(packed) if isinstance(packed, str) else packed

    def element(four: Column) -> Column:
        bits = F.conv(F.concat(F.substring(four, 3, 2), F.substring(four, 1, 2)), 16, 10).cast("int")
        power, fraction = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
        size = (
            F.when(power == 0, fraction * F.lit(2.0**-24))
            .when((power == 31) & (fraction > 0), F.lit(float("nan")))
            .when(power == 31, F.lit(float("inf")))
            .otherwise((fraction + 1024) * F.pow(F.lit(2.0), power - 25))
        )
        return F.when(bits >= 0x8000, -size).otherwise(size).cast("float")

    # Cut into elements once; an expression per element would read the whole vector each time.
    return F.transform(F.regexp_extract_all(F.hex(packed), F.lit("(.{4})"), F.lit(1)), element)
