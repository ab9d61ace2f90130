"""Statistics over the numbers found in free text: every text is one row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import column, computed
from tabulens.functions.numbers import round_two

# What a number in a text looks like, and the quantiles reported for a text.
NUMBER_PATTERN = r"-?\d*\.?\d+"
TEXT_QUANTILES = {
    "p01": 0.01,
    "p025": 0.025,
    "p10": 0.1,
    "q1": 0.25,
    "q3": 0.75,
    "p90": 0.9,
    "p975": 0.975,
    "p99": 0.99,
}
FENCE = 1.5


def numbers_in(text: Column) -> Column:
    """All numbers of a text in order; every other character, commas and line feeds too, separates.

    Runs of characters no number contains shrink to one space first, which is much faster
    than trying the number pattern at each of them.
    """
    spaced = F.regexp_replace(text, r"[^0-9.\-]+", " ")
    found = F.regexp_extract_all(spaced, F.lit(NUMBER_PATTERN), F.lit(0)).cast("array<double>")
    return F.filter(found, lambda n: F.abs(n) < float("inf"))


def extract_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per number of every text."""
    return df.select(column(key), F.explode(numbers_in(column(text))).alias("num"))


def route(df: DataFrame, text: str) -> DataFrame:
    """Whether a text goes to the number statistics."""
    return df.withColumn("has_numbers", F.size(numbers_in(column(text))) > 0)


def _with_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per text with numbers: the numbers in order of appearance and of size, and the quartiles."""
    found = computed(df, [key], _n=numbers_in(column(text))).filter(F.size("_n") > 0)
    ordered = computed(found, [key, "_n"], _s=F.sort_array("_n"))
    quartiles = {q: round_two(_quantile(F.col("_s"), TEXT_QUANTILES[q])) for q in ("q1", "q3")}
    return computed(ordered, [key, "_n", "_s"], **quartiles)


def _quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation in an ordered array."""
    position = F.lit(p) * (F.size(ordered) - 1)
    low = F.floor(position).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.ceil(position).cast("int"))
    return below + (position - low) * (above - below)


def _median(ordered: Column) -> Column:
    """The middle value, or the mean of the middle two."""
    size = F.size(ordered)
    below = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    return (below + F.get(ordered, F.floor(size / 2).cast("int"))) / 2


def text_number_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Count, average, median, range, quantiles and interquartile range, two decimals each.

    Texts without numbers give no row.
    """
    ordered = F.col("_s")
    total = F.aggregate("_n", F.lit(0.0), lambda acc, n: acc + n)
    others = [n for n in TEXT_QUANTILES if n not in ("q1", "q3")]
    return _with_numbers(df, key, text).select(
        column(key),
        F.size(ordered).cast("bigint").alias("cnt"),
        round_two(total / F.size(ordered)).alias("average"),
        round_two(_median(ordered)).alias("median"),
        round_two(F.get(ordered, F.lit(0))).alias("min"),
        round_two(F.get(ordered, F.size(ordered) - 1)).alias("max"),
        *[round_two(_quantile(ordered, TEXT_QUANTILES[n])).alias(n) for n in others],
        "q1",
        "q3",
        round_two(F.col("q3") - F.col("q1")).alias("iqr"),
    )


def text_number_outliers(df: DataFrame, key: str, text: str, k: float = FENCE) -> DataFrame:
    """The numbers outside the fences of their own text, in text order; texts without any give no row."""
    reach = k * (F.col("q3") - F.col("q1"))
    outside = F.filter("_n", lambda n: (n < F.col("q1") - reach) | (n > F.col("q3") + reach))
    found = computed(_with_numbers(df, key, text), [key], outlier_values=outside).filter(F.size("outlier_values") > 0)
    return found.select(column(key), F.size("outlier_values").cast("bigint").alias("outliers"), "outlier_values")
