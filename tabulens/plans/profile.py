"""The whole-table profile: partial profiles of the columns, merged, and their report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import column, counted_columns, date_columns, numeric_columns, string_columns
from tabulens.functions.numbers import short_text
from tabulens.operators.cardinality import cardinality, text_key
from tabulens.operators.frequency import (
    LEAST_VALUES,
    MOST_VALUES,
    best_combos,
    best_values,
    combo_counts,
    groupable_columns,
    values_of_combos,
)
from tabulens.operators.numeric import PROFILE_QUANTILES, named_quantiles, profile_long
from tabulens.operators.quantiles import INDEX, spread, summarize_counted
from tabulens.operators.rollups import all_measures, all_rollups
from tabulens.session import cut_lineage, partitions_for

# Name of the row about the whole table, and the fields of a profile in order.
WHOLE_TABLE = "all"
COUNTS = ("cnt", "uniq")
NUMBERS = ("avg", "min", "max", *PROFILE_QUANTILES)


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """Partial profiles to one row per column: the first value that is present wins.

    NULL is missing, zero is a value; ``is_numeric`` holds when any part says so.
    """
    stacked = None
    for order, part in enumerate(profiles):
        part = part.withColumn("_order", F.lit(order))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    fields = [c for c in stacked.columns if c not in ("column_name", "_order", "is_numeric")]
    first = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in fields
    ]
    if "is_numeric" in stacked.columns:
        first.append(F.coalesce(F.bool_or("is_numeric"), F.lit(False)).alias("is_numeric"))
    return stacked.groupBy("column_name").agg(*first)


def count_profile(df: DataFrame) -> DataFrame:
    """The number of rows, as the profile of the whole table; an empty table has none."""
    counted = df.agg(F.lit(WHOLE_TABLE).alias("column_name"), F.count("*").alias("cnt"))
    return counted.filter("cnt > 0")


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct counts; columns without any value are left out."""
    return cardinality(df, columns, exact).filter("uniq > 0")


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    long = profile_long(df, columns, exact).filter("cnt > 0")
    return long.drop("cnt", "sum").withColumn("is_numeric", F.lit(True))


def profile_table(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column, and one for the whole table."""
    parts = [count_profile(df)]
    if counted_columns(df):
        parts.append(distinct_profile(df, exact=exact))
    if numeric_columns(df):
        parts.append(numeric_profile(df, exact=exact))
    return _whole(parts)


def _whole(parts: Sequence[DataFrame]) -> DataFrame:
    """Partial profiles as one with all fields."""
    merged = merge_profiles(*parts)
    for name in (*COUNTS, *NUMBERS):
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(None).cast("double"))
    if "is_numeric" not in merged.columns:
        merged = merged.withColumn("is_numeric", F.lit(False))
    return merged.select("column_name", *COUNTS, *NUMBERS, "is_numeric")


def profile_report(profile: DataFrame) -> DataFrame:
    """The profile as texts: at most three decimals, sorted by column."""
    numbers = [F.coalesce(short_text(F.col(c)), F.lit("0")).alias(c) for c in NUMBERS]
    counts = [F.coalesce(F.col(c).cast("string"), F.lit("0")).alias(c) for c in COUNTS]
    return profile.select("column_name", *counts, *numbers, "is_numeric").orderBy("column_name")


def shared_counts(df: DataFrame) -> DataFrame:
    """The distinct values of every counted column with their rows, from one scan, written once.

    ``_column`` is the place among the counted columns, ``_key`` a short text equal exactly when values
    are, ``_v`` the number of a numeric column.
    """
    names, numbers = counted_columns(df), set(numeric_columns(df))
    cells = []
    for i, name in enumerate(names):
        number = column(name) if name in numbers else F.lit(None)
        cells += [F.lit(i), text_key(df, name), number.cast("double")]
    partitions = partitions_for(df.count() * len(names))
    narrow = spread(df.select(*[column(n) for n in names]), partitions)
    rows = narrow.select(F.stack(F.lit(len(names)), *cells).alias(INDEX, "_key", "_v"))
    counted = rows.groupBy(INDEX, "_key", "_v").agg(F.count("_v").alias("_copies"), F.count("*").alias("_rows"))
    return cut_lineage(counted, partitions)


def _profile_of_counts(df: DataFrame, shared: DataFrame) -> DataFrame:
    """The profile of the columns from the shared counts."""
    names, numbers = counted_columns(df), set(numeric_columns(df))
    # Every row has one cell in the first column.
    first = shared.filter(F.col(INDEX) == 0)
    counted = first.agg(F.lit(WHOLE_TABLE).alias("column_name"), F.sum("_rows").alias("cnt")).filter("cnt > 0")
    label = F.get(F.array(*[F.lit(n) for n in names]), INDEX).alias("column_name")
    parts = [counted, shared.groupBy(INDEX).agg(F.count("_key").alias("uniq")).filter("uniq > 0").select(label, "uniq")]
    places = [i for i, n in enumerate(names) if n in numbers]
    if places:
        numeric = shared.filter(F.col(INDEX).isin(places))
        partitions = partitions_for(numeric.count())
        long = summarize_counted(numeric, names, list(PROFILE_QUANTILES.values()), partitions=partitions).filter("cnt > 0")
        fields = ["column_name", "avg", "min", "max", *named_quantiles(list(PROFILE_QUANTILES))]
        parts.append(long.select(*fields, F.lit(True).alias("is_numeric")))
    return _whole(parts)


def _gated(df: DataFrame, shared: DataFrame) -> list[str]:
    """String columns with a groupable number of distinct values, by the shared counts."""
    names, texts = counted_columns(df), set(string_columns(df))
    uniq = {r[INDEX]: r["uniq"] for r in shared.groupBy(INDEX).agg(F.count("_key").alias("uniq")).collect()}  # one row a column
    return [n for i, n in enumerate(names) if n in texts and LEAST_VALUES < uniq.get(i, 0) < MOST_VALUES]


def full_profile(df: DataFrame, exact: bool = True) -> dict[str, DataFrame]:
    """Everything the profile consists of, by section.

    The exact profile reads the table a fixed number of times: the counts of the columns' values, the
    counts of the combinations of groupable columns and the time rollups. Columns and top lists come from
    these counts, which are written while the profile is built.
    """
    if exact and counted_columns(df):
        shared = shared_counts(df)
        parts = {"columns": _profile_of_counts(df, shared)}
        grouped = _gated(df, shared)
    else:
        parts = {"columns": profile_table(df, exact)}
        grouped = groupable_columns(df) if string_columns(df) else []
    if grouped:
        combos = cut_lineage(combo_counts(df, grouped))
        total = combos.select(F.sum("_cnt")).scalar()
        values = values_of_combos(combos, grouped)
        parts["frequent"] = best_values(values, total)
        parts["rare"] = best_values(values, total, rare=True, min_count=2)
        if len(grouped) > 1:
            parts["frequent_combinations"] = best_combos(combos, grouped, total)
            parts["rare_combinations"] = best_combos(combos, grouped, total, rare=True, min_count=2)
    if date_columns(df):
        parts["rollups"] = all_measures(df, exact=exact)
        parts["graphs"] = all_rollups(df)
    return parts


# The columns of a section that name a row, and the columns that tell its rows apart; of combinations all others do.
_NAMES = {"columns": "column_name", "frequent": "column_name", "rare": "column_name", "rollups": "rollup", "graphs": "rollup"}
_ITEMS = {"frequent": "value", "rare": "value", "rollups": "datetime", "graphs": "datetime"}


def profile_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """A full profile as one long table: ``section``, ``name``, ``item``, ``measure`` and its ``value``.

    A combination is named after its columns, joined by ``+``; its item is its values, joined by ``|``,
    with ``\\N`` for NULL. Measures without a value have no row.
    """
    stacked = None
    for section, part in parts.items():
        if section in _NAMES:
            name, item = column(_NAMES[section]), column(_ITEMS[section]) if section in _ITEMS else F.lit(None)
            told = {_NAMES[section], _ITEMS.get(section), "common"}
        else:
            told = set(part.columns) - {"cnt", "percentage"}
            grouped = [c for c in part.columns if c in told]
            name = F.lit("+".join(grouped))
            item = F.concat_ws("|", *[F.coalesce(column(c).cast("string"), F.lit("\\N")) for c in grouped])
        cells = [
            F.struct(F.lit(c).alias("measure"), column(c).cast("double").alias("value")) for c in part.columns if c not in told
        ]
        labels = [F.lit(section).alias("section"), name.alias("name"), item.cast("string").alias("item")]
        rows = part.select(*labels, F.inline(F.array(*cells))).filter("value IS NOT NULL")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked
