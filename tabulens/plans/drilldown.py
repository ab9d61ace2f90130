"""Drill-downs: everything about one column, by its class."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabulens.functions.columns import date_columns, first_numeric_column, numeric_columns
from tabulens.operators import distribution, frequency, numeric, rollups, strings


def numeric_drilldown(df: DataFrame, name: str, exact: bool = True) -> dict[str, DataFrame]:
    histogram = distribution.adaptive_histogram(df, name)
    return {
        "stats": numeric.numeric_detail(df, name, exact),
        "outliers": distribution.iqr_outliers(df, name, exact),
        "deciles": distribution.decile_buckets(df, name, exact),
        "histogram": histogram,
        "density": distribution.density(histogram),
    }


def string_drilldown(df: DataFrame, name: str, exact: bool = True) -> dict[str, DataFrame]:
    return {
        "stats": strings.string_profile(df, name, exact),
        "categories": frequency.category_counts(df, name),
        "extremes": frequency.most_least_common(df, name),
        "lengths": strings.length_distribution(df, name),
    }


def date_drilldown(df: DataFrame, name: str, unit: str) -> dict[str, DataFrame]:
    parts = {
        "counts": rollups.rollup_count(df, name, unit).orderBy("date"),
        "summary": rollups.rollup_summary(df, name, unit),
    }
    if first_numeric_column(df):
        parts["sums"] = rollups.rollup_sum(df, name, unit, drop_null=True).orderBy("date")
    return parts


def drilldown(df: DataFrame, name: str, unit: str = "day") -> dict[str, DataFrame]:
    """The drill-down that fits the column's type."""
    if name in date_columns(df):
        return date_drilldown(df, name, unit)
    if name in numeric_columns(df):
        return numeric_drilldown(df, name)
    return string_drilldown(df, name)
