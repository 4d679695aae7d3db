"""Rounding rules. Five coexist; none is exchangeable for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """To the nearest integer, ties to even."""
    return F.rint(value)


def half_away(value: Column) -> Column:
    """To the nearest integer, ties away from zero."""
    return F.signum(value) * F.floor(F.abs(value) + 0.5)


def truncated(value: Column) -> Column:
    """Toward zero, as bigint."""
    return value.cast("bigint")


def floored_quotient(a: Column, b: Column) -> Column:
    """Floor division of doubles."""
    return F.floor(a / b)


def five_places(value: Column) -> Column:
    """To five decimal places in single precision, ties to even."""
    scaled = F.rint((value.cast("float") * F.lit(100000.0).cast("float")).cast("float"))
    return (scaled.cast("float") / F.lit(100000.0).cast("float")).cast("float")


def rescaled(value: Column, source: Column, target: Column) -> Column:
    """A coordinate moved from one extent to another in single precision, ties to even, clamped to 0 .. target."""
    moved = ((value.cast("float") / source.cast("float")).cast("float") * target.cast("float")).cast("float")
    return F.least(F.greatest(F.rint(moved.cast("double")), F.lit(0.0)), target.cast("double")).cast("int")
