"""Rounding and other column functions whose semantics matter for results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Rounds to a whole number, halves to even."""
    return F.bround(x.cast("double"), 0).cast("int")


def absolute(relative: Column, scale: float = 2) -> Column:
    """Copy number of a relative one (1.0: two copies); scale 1 where it is absolute already."""
    return half_even(relative * scale)


def half_even_mean(total: Column, n: Column) -> Column:
    """half_even(total / n) of whole numbers, by whole numbers alone: a mean in floating point can miss a half."""
    twice, floor = 2 * total, F.floor(total / n).cast("long")
    rest = twice - 2 * n * floor  # twice the remainder
    return (floor + F.when(rest > n, 1).when((rest == n) & (F.pmod(floor, F.lit(2)) == 1), 1).otherwise(0)).cast("long")


def clamped(cn: Column, low: int = 0, high: int = 6) -> Column:
    return F.greatest(F.lit(low), F.least(cn, F.lit(high)))


def chrom(name: Column, sex_as_number: bool = True) -> Column:
    """One name for each chromosome: without `chr`; X as 23 and Y as 24, or as letters."""
    bare = F.upper(F.regexp_replace(name.cast("string"), "(?i)^chr", ""))
    if sex_as_number:
        return F.when(bare == "X", "23").when(bare == "Y", "24").otherwise(bare)
    return F.when(bare == "23", "X").when(bare == "24", "Y").otherwise(bare)


def clean_name(name: Column) -> Column:
    """Cell names without blanks, hyphens and dots."""
    return F.regexp_replace(name, r"[ .\-]", "_")


def direction(score: Column) -> Column:
    return F.when(score < 0, "DEL").otherwise("AMP")
