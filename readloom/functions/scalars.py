"""Numbers in text, and logarithms of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_number(token: Column) -> Column:
    """Decimal digits without a leading zero, or a single zero. An empty token is none."""
    return token.rlike("^(0|[1-9][0-9]*)$")


def to_number(token: Column) -> Column:
    """The token as a BIGINT; null if it is no number or too large."""
    return F.when(is_number(token), token.try_cast("bigint"))


def to_text(number: Column) -> Column:
    return number.cast("string")


def bit_length(x: Column) -> Column:
    """The least i with x < 2**i, so 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.conv(x.cast("string"), 10, 2)))


def int_log(x: Column, base: int) -> Column:
    """floor(log(x)) to the base, exactly, by counting the powers that x reaches; 1 for base 0 and 2 for base 1."""
    if base in (0, 1):
        return F.lit(base + 1)
    powers, p = [], base
    while p < 1 << 63:
        powers.append(p)
        p *= base
    return F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), lambda n, p: n + F.when(x >= p, 1).otherwise(0))


def ends_with(text: Column, suffix: str) -> Column:
    return text.endswith(suffix)
