"""Column classes: which operators apply to which columns of a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of key-like columns that carry no statistics.
EXCLUDED_NAMES = ("id", "slug")

_PREFIX = re.compile(r"^\d{4}_")


def column(name: str) -> Column:
    """The column of that exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def bare_name(name: str) -> str:
    """Column name without the four-digit position prefix that loading adds."""
    return _PREFIX.sub("", name)


def is_excluded(name: str) -> bool:
    return bare_name(name) in EXCLUDED_NAMES


def _of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and not is_excluded(f.name)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.NumericType)


def string_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.StringType)


def date_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.DateType, T.TimestampType, T.TimestampNTZType)


def counted_columns(df: DataFrame) -> list[str]:
    """Columns whose distinct values are counted: everything atomic but dates."""
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType, T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema if not isinstance(f.dataType, dates) and not is_excluded(f.name)]


def first_numeric_column(df: DataFrame) -> str | None:
    """First numeric column in declaration order."""
    return next(iter(numeric_columns(df)), None)


def total(df: DataFrame, name: str) -> Column:
    """The sum of a column; of integers as decimals, which no number of rows overflows."""
    values = column(name)
    whole = isinstance(df.schema[name].dataType, T.IntegralType)
    return F.sum(values.cast("decimal(20,0)") if whole else values)


def has_time(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, T.DateType)


def computed(df: DataFrame, keep: list[str], **expressions: Column) -> DataFrame:
    """The kept columns and costly expressions, each evaluated once per row.

    Going through a generator keeps the optimizer from copying the expressions into later
    filters and lambdas, where they would be evaluated again and again.
    """
    row = F.struct(*[e.alias(n) for n, e in expressions.items()])
    return df.select(*[column(k) for k in keep], F.inline(F.array(row)))
