"""Quick overview of a table: types, fill, distinct values, ranges, sample values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import column, counted_columns, numeric_columns
from tabulens.operators.cardinality import cardinality, columns_within
from tabulens.operators.numeric import named_quantiles
from tabulens.operators.quantiles import summarize

# Samples are shown for columns with fewer distinct values than this, so many of them.
SAMPLE_LIMIT, SAMPLES = 10, 5


def describe(df: DataFrame) -> DataFrame:
    """Column names and types, sorted by name."""
    schema = "name string, type string"
    return df.sparkSession.createDataFrame(df.dtypes, schema).orderBy("name")


def table_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


def column_overview(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: type, non-null and distinct values; range, mean and median of numbers."""
    names = list(columns) if columns is not None else df.columns
    numeric = [n for n in numeric_columns(df) if n in names]
    countable = [n for n in counted_columns(df) if n in names]
    kinds = df.sparkSession.createDataFrame(
        [(n, t) for n, t in df.dtypes if n in names], "column_name string, type string"
    )
    filled = [F.struct(F.lit(n).alias("column_name"), F.count(column(n)).alias("non_null")) for n in names]
    parts = [df.agg(F.array(*filled).alias("_rows")).select(F.inline("_rows"))]
    if countable:
        parts.append(cardinality(df, countable, exact))
    if numeric:
        numbers = summarize(df, numeric, [0.5], exact=exact)
        parts.append(
            numbers.select("column_name", "min", "max", F.col("avg").alias("mean"), *named_quantiles(["median"]))
        )
    result = kinds
    for part in parts:  # every side has one row per column of the table
        result = result.join(F.broadcast(part), "column_name", "left")
    return result


def describe_numbers(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per numeric column: count, mean, sample deviation, minimum, quartiles and maximum."""
    names = list(columns) if columns is not None else numeric_columns(df)
    spread = [F.struct(F.lit(n).alias("column_name"), F.stddev_samp(column(n)).alias("std")) for n in names]
    deviations = df.agg(F.array(*spread).alias("_rows")).select(F.inline("_rows"))
    summary = summarize(df, names, [0.25, 0.5, 0.75], exact=exact)
    both = summary.join(F.broadcast(deviations), "column_name")  # one row per column
    quartiles = named_quantiles(["p25", "p50", "p75"])
    return both.select("column_name", "cnt", F.col("avg").alias("mean"), "std", "min", *quartiles, "max")


def sample_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Up to five smallest values of every column with few distinct ones."""
    names = list(columns) if columns is not None else counted_columns(df)
    few = columns_within(df, names, 0, SAMPLE_LIMIT)
    if not few:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    texts = df.select(*[column(n).cast("string").alias(n) for n in few])
    distinct = texts.unpivot([], [column(n) for n in few], "column_name", "value").filter("value IS NOT NULL")
    sets = distinct.groupBy("column_name").agg(F.collect_set("value").alias("_values"))
    return sets.select("column_name", F.explode(F.slice(F.array_sort("_values"), 1, SAMPLES)).alias("value"))
