"""Numeric expressions: number-likeness of text, rounding, short formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an integer or a floating number in a text cell.
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|(?i)^([+-]?(inf|infinity)|nan)$"


def is_float_text(text: Column) -> Column:
    return text.rlike(FLOAT_PATTERN)


def is_long_text(text: Column) -> Column:
    """Whole number that fits 64 bits; larger ones are floating numbers."""
    return text.rlike(INTEGER_PATTERN) & text.try_cast("bigint").isNotNull()


def to_double(text: Column) -> Column:
    """Text cell to double, NULL unless it reads as a number."""
    return F.when(is_float_text(text), text.try_cast("double"))


def to_long(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))


def round_two(value: Column) -> Column:
    """Two decimals, halves away from zero; huge values have no decimals to round."""
    cents = F.signum(value) * F.floor(F.abs(value) * 100 + 0.5) / 100 + F.lit(0.0)
    return F.when(F.abs(value) < 9e13, cents).otherwise(value)


def short_text(value: Column) -> Column:
    """At most three decimals, without trailing zeros."""
    fixed = F.replace(F.format_number(value.cast("double"), 3), F.lit(","), F.lit(""))
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))


def percent(part: Column, whole: Column) -> Column:
    return part * F.lit(100.0) / whole
