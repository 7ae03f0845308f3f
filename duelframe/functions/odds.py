"""Column functions on American odds and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def implied(odds: str | Column) -> Column:
    """The probability that American odds imply, with the margin."""
    o = _c(odds).cast("double")
    return F.when(o > 0, 100.0 / (o + 100.0)).otherwise(F.abs(o) / (F.abs(o) + 100.0))


def decimal(odds: str | Column) -> Column:
    o = _c(odds).cast("double")
    return F.when(o > 0, o / 100.0 + 1.0).when(o < 0, 100.0 / F.abs(o) + 1.0)


def vig_free(p: Column, *others: Column) -> Column:
    """A probability without the margin; null unless all are present."""
    total = p
    for x in others:
        total = total + x
    return F.try_divide(p, total)


def parse(text: str | Column) -> Column:
    """EVEN is 100; +265 and -110 as they stand; anything else is null."""
    t = F.trim(_c(text))
    return F.when(F.upper(t) == "EVEN", F.lit(100)).otherwise(F.regexp_replace(t, r"^\+", "").try_cast("int"))


def kelly(p: Column, d: Column) -> Column:
    return F.try_divide(p * (d - 1.0) - (1.0 - p), d - 1.0)
