"""Frequent and rare values, single and combined, with their share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import column, string_columns
from tabulens.functions.numbers import percent
from tabulens.operators.cardinality import columns_within

# A column is grouped when it has more than LEAST and fewer than MOST values.
LEAST_VALUES, MOST_VALUES = 1, 1000


def groupable_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> list[str]:
    """String columns whose number of distinct values makes grouping worthwhile."""
    names = list(columns) if columns is not None else string_columns(df)
    return columns_within(df, names, LEAST_VALUES, MOST_VALUES, exact)


def _ordering(rare: bool, ties: Sequence[str]) -> list[Column]:
    count = F.col("cnt").asc() if rare else F.col("cnt").desc()
    return [count, *[column(t) for t in ties]]


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = 10, rare: bool = False, min_count: int = 1
) -> DataFrame:
    """The ``n`` most (or least) frequent values of every groupable column, in one pass.

    The share is of all rows, NULLs included; they are counted apart, without reading a column.
    """
    names = groupable_columns(df) if columns is None else list(columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, cnt bigint, percentage double")
    texts = df.select(*[column(c).cast("string").alias(c) for c in names])
    counts = (
        texts.unpivot([], [column(c) for c in names], "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("cnt"))
    )
    return best_values(counts, df.select(F.count("*")).scalar(), n, rare, min_count)


def best_values(counts: DataFrame, total: Column, n: int = 10, rare: bool = False, min_count: int = 1) -> DataFrame:
    """The ``n`` first of each column's counted values and their share of ``total``."""
    kept = counts.filter(F.col("value").isNotNull() & (F.col("cnt") >= min_count))
    ranking = Window.partitionBy("column_name").orderBy(*_ordering(rare, ["value"]))
    ranked = kept.withColumn("_rank", F.row_number().over(ranking)).filter(F.col("_rank") <= n)
    return ranked.select("column_name", "value", "cnt", percent(F.col("cnt"), total).alias("percentage"))


def value_lines(top: DataFrame) -> DataFrame:
    """The rows of ``top_values`` as text lines: value, count and share."""
    share = F.replace(F.format_number("percentage", 2), F.lit(","), F.lit(""))
    line = F.concat("value", F.lit(" ("), F.col("cnt").cast("string"), F.lit(", "), share, F.lit("%)"))
    return top.select("column_name", line.alias("line"))


def top_combos(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = 10, rare: bool = False, min_count: int = 1
) -> DataFrame:
    """The ``n`` most (or least) frequent combinations over the groupable columns."""
    names = groupable_columns(df) if columns is None else list(columns)
    if len(names) < 2:
        raise ValueError("a combination needs at least two groupable columns")
    return best_combos(combo_counts(df, names), names, df.select(F.count("*")).scalar(), n, rare, min_count)


def combo_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The combinations of values of some columns with their rows, ``_cnt``."""
    return df.groupBy(*[column(c) for c in names]).agg(F.count("*").alias("_cnt"))


def values_of_combos(combos: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts of single values from those of combinations."""
    texts = combos.select("_cnt", *[column(c).cast("string").alias(c) for c in names])
    rows = texts.unpivot(["_cnt"], [column(c) for c in names], "column_name", "value")
    return rows.groupBy("column_name", "value").agg(F.sum("_cnt").alias("cnt"))


def best_combos(
    combos: DataFrame, names: Sequence[str], total: Column, n: int = 10, rare: bool = False, min_count: int = 1
) -> DataFrame:
    """The ``n`` first counted combinations and their share of ``total``."""
    counts = combos.withColumnRenamed("_cnt", "cnt")
    best = counts.filter(F.col("cnt") >= min_count).orderBy(*_ordering(rare, names)).limit(n)
    return best.select("cnt", *[column(c) for c in names], percent(F.col("cnt"), total).alias("percentage"))


def category_counts(df: DataFrame, name: str, n: int = 20, rare: bool = False, skip_empty: bool = True) -> DataFrame:
    """The ``n`` most (or least) frequent values of one column of any cardinality."""
    value = column(name)
    rows = df.filter(value.isNotNull() & (value != "")) if skip_empty else df
    counts = rows.groupBy(value.alias("category")).agg(F.count("*").alias("cnt"))
    return counts.orderBy(*_ordering(rare, ["category"])).limit(n)


def most_least_common(df: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The ``n`` most and the ``n`` least frequent non-empty values, tagged."""
    most = category_counts(df, name, n).withColumn("type", F.lit("most_common"))
    least = category_counts(df, name, n, rare=True).withColumn("type", F.lit("least_common"))
    return most.unionByName(least).withColumnRenamed("category", "value")


def extreme_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The most frequent value of every column, and the rarest that occurs more than once."""
    names = groupable_columns(df) if columns is None else list(columns)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, most_frequent string, most_count bigint, most_rare string, rare_count bigint"
        )
    texts = df.select(*[column(c).cast("string").alias(c) for c in names])
    counts = (
        texts.unpivot([], [column(c) for c in names], "column_name", "value")
        .filter("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("cnt"))
    )
    # min_by over (order, value) breaks ties by the smaller value.
    most = F.struct((-F.col("cnt")).alias("o"), F.col("value"))
    rare = F.when(F.col("cnt") > 1, F.struct(F.col("cnt").alias("o"), F.col("value")))
    best = counts.groupBy("column_name").agg(F.min(most).alias("most"), F.min(rare).alias("rare"))
    return best.select(
        "column_name",
        F.col("most.value").alias("most_frequent"),
        (-F.col("most.o")).alias("most_count"),
        F.col("rare.value").alias("most_rare"),
        F.col("rare.o").alias("rare_count"),
    )


def group_table(rows: DataFrame) -> DataFrame:
    """A group report with its columns in name order."""
    return rows.select(*[column(c) for c in sorted(rows.columns)])
