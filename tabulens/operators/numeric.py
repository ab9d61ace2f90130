"""Numeric profile of a table: wide, long, summed, and the drill-down of one column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import column, numeric_columns, total
from tabulens.operators.quantiles import summarize

# The quantiles of the profile under their output names, and of the drill-down.
PROFILE_QUANTILES = {"quantile001": 0.01, "quantile099": 0.99, "quantile01": 0.1, "quantile09": 0.9, "median": 0.5}
SUM_QUANTILES = {"quantile04": 0.4, "quantile06": 0.6}
DETAIL_QUANTILES = {
    "p01": 0.01,
    "p05": 0.05,
    "p10": 0.1,
    "q1": 0.25,
    "median_value": 0.5,
    "q3": 0.75,
    "p90": 0.9,
    "p95": 0.95,
    "p99": 0.99,
}


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("cnt"))


def named_quantiles(names: Sequence[str]) -> list[Column]:
    """The elements of ``q`` under their names."""
    return [F.col("q").getItem(i).alias(name) for i, name in enumerate(names)]


def profile_long(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per numeric column: count, average, minimum, maximum, sum and the quantiles."""
    names = list(columns) if columns is not None else numeric_columns(df)
    summary = summarize(df, names, list(PROFILE_QUANTILES.values()), exact=exact)
    return summary.select(
        "column_name", "cnt", "avg", "min", "max", "sum", *named_quantiles(list(PROFILE_QUANTILES))
    )


def _wide(long: DataFrame, columns: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """One row, columns named ``<method>__<column>``; the input has one row per column."""
    picked = [
        F.max(F.when(F.col("column_name") == name, F.col(method))).alias(f"{method}__{name}")
        for name in columns
        for method in methods
    ]
    return long.agg(*picked)


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """All aggregates of all numeric columns in one row."""
    names = list(columns) if columns is not None else numeric_columns(df)
    return _wide(profile_long(df, names, exact), names, [*PROFILE_QUANTILES, "avg", "max", "min"])


def numeric_sum(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Sum and the central quantiles (40 % and 60 %) of every numeric column in one row."""
    names = list(columns) if columns is not None else numeric_columns(df)
    long = summarize(df, names, list(SUM_QUANTILES.values()), exact=exact)
    long = long.select("column_name", "sum", *named_quantiles(list(SUM_QUANTILES)))
    return _wide(long, names, ["sum", *SUM_QUANTILES])


def numeric_detail(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Drill-down of one numeric column: range, average, non-null count and nine quantiles."""
    summary = summarize(df, [name], list(DETAIL_QUANTILES.values()), exact=exact)
    return summary.select(
        F.col("min").alias("min_value"),
        F.col("max").alias("max_value"),
        F.col("avg").alias("avg_value"),
        F.col("cnt").alias("total_count"),
        *named_quantiles(list(DETAIL_QUANTILES)),
    )


def group_summary(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Rows and rounded sums per combination of the keys."""
    totals = [F.round(total(df, c).cast("double"), 2).alias(f"total_{c}") for c in sums]
    return df.groupBy(*[column(k) for k in keys]).agg(F.count("*").alias("quantity"), *totals)
