"""Profile of a string column, missing values, and what the texts of a column look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import column, string_columns
from tabulens.functions.datetimes import parse_moment
from tabulens.functions.numbers import is_float_text, percent
from tabulens.operators.cardinality import SKETCH_BITS, text_key

# Date shapes of the date-likeness test, and the share that must look alike.
DATE_SHAPES = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{2}\.\d{2}\.\d{4}$",
    r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}$",
)
LIKENESS = 0.8


def string_profile(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Totals, distinct, empty and blank values, and byte lengths of one string column."""
    value = column(name)
    length = F.octet_length(value).cast("bigint")
    # Values are counted per distinct key first, so one frequent value stays small.
    per_value = (
        df.groupBy(text_key(df, name).alias("_v")).agg(
            F.count("*").alias("_rows"),
            F.count_if(value == "").alias("_empty"),
            F.count_if(F.trim(value) == "").alias("_blank"),
            F.min(length).alias("_min"),
            F.max(length).alias("_max"),
            F.sum(length).alias("_sum"),
        )
        if exact
        else df.select(
            F.lit(1).alias("_rows"),
            F.when(value == "", 1).otherwise(0).alias("_empty"),
            F.when(F.trim(value) == "", 1).otherwise(0).alias("_blank"),
            length.alias("_min"),
            length.alias("_max"),
            length.alias("_sum"),
            F.when(value.isNotNull(), F.xxhash64(value)).alias("_v"),
        )
    )
    unique = F.count("_v") if exact else F.hll_sketch_estimate(F.hll_sketch_agg("_v", SKETCH_BITS))
    filled = F.sum(F.when(F.col("_min").isNotNull(), F.col("_rows")))
    totals = per_value.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_count"),
        unique.alias("unique_count"),
        F.coalesce(F.sum("_empty"), F.lit(0)).alias("empty_count"),
        F.coalesce(F.sum("_blank"), F.lit(0)).alias("whitespace_count"),
        F.min("_min").alias("min_length"),
        F.max("_max").alias("max_length"),
        (F.sum("_sum") / filled).alias("avg_length"),
    )
    shares = [
        percent(F.col(c), F.nullif(F.col("total_count"), F.lit(0))).alias(c.replace("_count", "_percent"))
        for c in ("unique_count", "empty_count", "whitespace_count")
    ]
    return totals.select("*", *shares)


def length_distribution(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The ``n`` shortest byte lengths of the non-empty values, with their counts."""
    value = column(name)
    lengths = df.filter(value != "").groupBy(F.octet_length(value).cast("bigint").alias("str_length"))
    return lengths.agg(F.count("*").alias("cnt")).orderBy("str_length").limit(n)


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column, all columns in one aggregate."""
    names = list(columns) if columns is not None else df.columns
    counts = [F.struct(F.lit(n).alias("column_name"), F.count_if(column(n).isNull()).alias("missing")) for n in names]
    return df.agg(F.array(*counts).alias("_rows")).select(F.inline("_rows"))


def _stripped(value: Column) -> Column:
    return F.trim(value, F.lit(" \t\r\n"))


def is_date_shape(value: Column) -> Column:
    return F.greatest(*[_stripped(value).rlike(p) for p in DATE_SHAPES])


def likeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per string column: share of numbers and of dates among all rows, and both verdicts.

    ``all_dates`` asks more: every value has to parse as a date or a moment.
    """
    names = list(columns) if columns is not None else string_columns(df)
    rows = []
    for name in names:
        value = column(name)
        numeric = F.avg(F.when(is_float_text(_stripped(value)), 1.0).otherwise(0.0))
        dates = F.avg(F.when(is_date_shape(value), 1.0).otherwise(0.0))
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                numeric.alias("numeric_share"),
                dates.alias("date_share"),
                (numeric >= LIKENESS).alias("numeric_like"),
                (dates >= LIKENESS).alias("date_like"),
                ((F.count(value) > 0) & (F.count(parse_moment(value)) == F.count(value))).alias("all_dates"),
            )
        )
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))
