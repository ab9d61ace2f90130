"""Stored sketches of columns: kept per day, file or key, merged later, with bounds of their errors.

One pass gives one row for each key and column: the count, a HyperLogLog sketch of the distinct
values and, for numbers, a KLL sketch of the quantiles. Rows of any tables merge, so a month is
the sum of its days without reading them again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import column, counted_columns, numeric_columns
from tabulens.operators.cardinality import SKETCH_BITS, distinct_sketch

# Size of a quantile sketch.
KLL_SIZE = 1_000
# Relative standard error of a distinct count, and the rank error of a quantile that 99 of 100 sketches keep to.
DISTINCT_ERROR = 1.04 / math.sqrt(1 << SKETCH_BITS)
RANK_ERROR = 2.296 / KLL_SIZE**0.9021


def sketch(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(keys, column_name, cnt, distinct, quantiles) of each column; no quantiles for what is no number."""
    names = list(columns) if columns is not None else [c for c in counted_columns(df) if c not in by]
    if not names:
        raise ValueError("no column to sketch")
    numbers = set(numeric_columns(df))
    rows = []
    for name in names:
        value = column(name).cast("double")
        quantiles = F.kll_sketch_agg_double(value, KLL_SIZE) if name in numbers else F.lit(None).cast("binary")
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(column(name)).alias("cnt"),
                distinct_sketch(df, name).alias("distinct"),
                quantiles.alias("quantiles"),
            )
        )
    keys = [column(k) for k in by]
    return df.groupBy(*keys).agg(F.array(*rows).alias("_rows")).select(*keys, F.inline("_rows"))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of one column of all rows, or of those with the same keys, as one."""
    return sketches.groupBy(*[column(k) for k in by], "column_name").agg(
        F.sum("cnt").alias("cnt"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double(F.when(F.col("cnt") > 0, F.col("quantiles")), KLL_SIZE).alias("quantiles"),
    )


def estimates(sketches: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """The counts of distinct values with the range that three standard errors span, and the quantiles in the order asked for."""
    uniq = F.hll_sketch_estimate("distinct")
    points = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))) for p in probabilities])
    known = F.col("quantiles").isNotNull() & (F.coalesce(F.kll_sketch_get_n_double("quantiles"), F.lit(0)) > 0)
    rest = [column(c) for c in sketches.columns if c not in ("distinct", "quantiles")]
    return sketches.select(
        *rest,
        uniq.alias("uniq"),
        F.floor(uniq / (1 + 3 * DISTINCT_ERROR)).alias("uniq_low"),
        F.ceil(uniq / (1 - 3 * DISTINCT_ERROR)).alias("uniq_high"),
        F.when(known, points).alias("q"),
    )
