"""Scalar functions with the reference's number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_division(a: Column, b: Column) -> Column:
    """Largest integer not above a / b, in whole numbers: exact for all of them; null for b = 0."""
    a, b = a.cast("long"), b.cast("long")
    whole = F.call_function("div", a, F.when(b != 0, b))
    off = (F.try_mod(a, b) != 0) & ((a < 0) != (b < 0))
    return F.when(b != 0, F.when(off, whole - 1).otherwise(whole))


def ceil_division(a: Column, b: Column) -> Column:
    """Smallest integer not below a / b, for integers of any sign; null for b = 0."""
    a, b = a.cast("long"), b.cast("long")
    off = (F.try_mod(a, b) != 0) & ((a < 0) == (b < 0))
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)) + F.when(off, 1).otherwise(0))


def floor_modulo(a: Column, b: Column) -> Column:
    """Modulo that takes the sign of the divisor."""
    return F.when(b != 0, F.when((a % b != 0) & ((a % b > 0) != (b > 0)), a % b + b).otherwise(a % b))


def iteration_count(lo: Column, hi: Column, step: Column) -> Column:
    return F.greatest(F.lit(0), floor_division(hi - lo + step, step)).cast("long")


def iteration_number(i: Column, lo: Column, step: Column) -> Column:
    return floor_division(i - lo + step, step)


def iteration_index(n: Column, lo: Column, step: Column) -> Column:
    return (lo + (n - 1) * step).cast("long")


def truncated(text: Column, length: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - len(tail)), F.lit(tail))).otherwise(text)


def compact_name(text: Column) -> Column:
    """Names are equal if their lower-cased, space-free forms are."""
    return F.regexp_replace(F.lower(text), " +", "")
