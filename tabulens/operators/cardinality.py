"""Distinct values per column, exact or by HyperLogLog, and their distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import column, counted_columns

# Text longer than this many bytes is compared by its length and SHA-256 digest.
DIGEST_BYTES = 64
# Registers of a HyperLogLog sketch as a power of two; the relative error is about 1.6 %.
SKETCH_BITS = 12


def text_key(df: DataFrame, name: str) -> Column:
    """A short key equal exactly when the values are equal, so that long texts do not shuffle."""
    value = column(name)
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # both zeros are one value
    text = value.cast("string")
    if not isinstance(kind, (T.StringType, T.BinaryType)):
        return text
    long = F.octet_length(value) > DIGEST_BYTES
    # A digest follows the length and a line feed, so no short value can look like one.
    digest = F.concat(F.octet_length(value).cast("string"), F.lit("\n"), F.sha2(value, 256))
    return F.when(long, digest).otherwise(text)


def distinct_sketch(df: DataFrame, name: str) -> Column:
    """HyperLogLog sketch over hashes, so that every type is sketched alike."""
    value = column(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # both zeros are one value
    return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), SKETCH_BITS)


def cardinality(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """One row per column: ``column_name`` and its number of distinct non-null values."""
    names = list(columns) if columns is not None else counted_columns(df)
    if not names:
        raise ValueError("no column to count")
    if not exact:
        counts = [
            F.struct(F.lit(n).alias("column_name"), F.hll_sketch_estimate(distinct_sketch(df, n)).alias("uniq")) for n in names
        ]
        return df.agg(F.array(*counts).alias("_rows")).select(F.inline("_rows"))
    keys = df.select(*[text_key(df, n).alias(n) for n in names])
    rows = keys.unpivot([], [column(n) for n in names], "column_name", "_v")
    # Two levels: distinct values first, so a frequent value never travels more than once per task.
    return rows.groupBy("column_name", "_v").agg(F.lit(1)).groupBy("column_name").agg(F.count("_v").alias("uniq"))


def cardinality_quantiles(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """Median, 20 % and 80 % quantile of the distinct counts of the columns."""
    counts = cardinality(df, columns, exact)
    points = F.percentile("uniq", [0.5, 0.2, 0.8])  # one row per column, whatever the table's size
    q = counts.agg(points.alias("q"))
    return q.select(*[F.col("q").getItem(i).alias(n) for i, n in enumerate(("med", "p20", "p80"))])


def columns_within(
    df: DataFrame, columns: Sequence[str], least: int, most: int, exact: bool = False
) -> list[str]:
    """Columns with more than ``least`` and fewer than ``most`` distinct values.

    A sketch settles the clear cases in one pass; only columns near a limit are counted exactly.
    """
    names = list(columns)
    if not names:
        return []
    counts = {r["column_name"]: r["uniq"] for r in cardinality(df, names, exact=exact).collect()}
    unsure = [] if exact else [n for n in names if any(0.8 * x <= counts[n] <= 1.25 * x + 1 for x in (least, most))]
    if unsure:
        counts.update({r["column_name"]: r["uniq"] for r in cardinality(df, unsure).collect()})
    return [n for n in names if least < counts[n] < most]
