"""Time rollups: counts and number summaries per hour, day, week, month or year."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import column, date_columns, first_numeric_column, has_time, numeric_columns, total
from tabulens.functions.datetimes import UNITS, bucket_label, bucket_text, check_unit
from tabulens.operators.quantiles import INDEX, summarize, summarize_counted, value_counts
from tabulens.session import cut_lineage, partitions_for

# Points that still fit a chart, and the window of the pair choice.
MOST_POINTS = 20
PAIR_LEAST, PAIR_MOST = 10, 10_000
# Text that marks a rollup row.
ROW_TAG = "info"
MEASURES = ("min", "max", "median", "avg", "sum")


def _truncated(name: str, unit: str) -> Column:
    return F.date_trunc(check_unit(unit), column(name))


def _bucketed(df: DataFrame, date: str, unit: str, drop_null: bool, others: Sequence[str] = ()) -> DataFrame:
    rows = df.filter(column(date).isNotNull()) if drop_null else df
    return rows.select(_truncated(date, unit).alias("_bucket"), *[column(c) for c in others])


def rollup(
    df: DataFrame,
    date: str,
    unit: str,
    columns: Sequence[str] | None = None,
    measures: Sequence[str] = MEASURES,
    drop_null: bool = False,
    exact: bool = True,
) -> DataFrame:
    """Rows per bucket with the measures of every numeric column, named ``<measure>__<column>``.

    Rows without a date form a bucket of their own unless ``drop_null``.
    """
    names = numeric_columns(df) if columns is None else list(columns)
    rows = _bucketed(df, date, unit, drop_null, names)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("cnt"))
    tagged = counts.withColumn("common", F.lit(ROW_TAG))
    if names and measures:
        probabilities = [0.5] if "median" in measures else []
        long = summarize(rows, names, probabilities, ["_bucket"], exact)
        long = long.withColumn("median", F.get("q", F.lit(0)))
        picked = [
            F.max(F.when(F.col("column_name") == name, F.col(m))).alias(f"{m}__{name}")
            for name in names
            for m in measures
        ]
        wide = long.groupBy("_bucket").agg(*picked).withColumnRenamed("_bucket", "_other")
        same = F.col("_bucket").eqNullSafe(F.col("_other"))
        tagged = tagged.join(wide, same, "left").drop("_other")
    text = bucket_text(F.col("_bucket"), unit).alias("datetime")
    return tagged.select(text, *[column(c) for c in tagged.columns if c != "_bucket"])


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("datetime").desc())


def oldest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("datetime")


def rollup_sum(
    df: DataFrame, date: str, unit: str, value: str | None = None, drop_null: bool = False
) -> DataFrame:
    """Rows per bucket and the sum of one numeric column, by default the first of the table."""
    name = value or first_numeric_column(df)
    if name is None:
        raise ValueError("the table has no numeric column")
    rows = _bucketed(df, date, unit, drop_null, [name])
    totals = rows.groupBy("_bucket").agg(F.count("*").alias("cnt"), total(df, name).cast("double").alias("sum_value"))
    return totals.select(bucket_text(F.col("_bucket"), unit).alias("date"), "cnt", "sum_value")


def rollup_count(df: DataFrame, date: str, unit: str) -> DataFrame:
    """Rows per bucket among the rows with a date."""
    rows = _bucketed(df, date, unit, drop_null=True).groupBy("_bucket").agg(F.count("*").alias("cnt"))
    return rows.select(bucket_text(F.col("_bucket"), unit).alias("date"), "cnt")


def rollup_summary(df: DataFrame, date: str, unit: str) -> DataFrame:
    """One row: rows with a date, number of buckets, first and last bucket."""
    counts = _bucketed(df, date, unit, drop_null=True).groupBy("_bucket").agg(F.count("*").alias("cnt"))
    return counts.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("buckets"),
        F.date_format(F.min("_bucket"), "yyyy-MM-dd").alias("first_bucket"),
        F.date_format(F.max("_bucket"), "yyyy-MM-dd").alias("last_bucket"),
    )


def buckets_per_unit(
    df: DataFrame, dates: Sequence[str] | None = None, units: Sequence[str] = UNITS
) -> DataFrame:
    """Counts per date column, unit and bucket.

    The rows are counted once per finest bucket; coarser units add up those counts.
    """
    names = date_columns(df) if dates is None else list(dates)
    finest = _finest(units)
    stacked = None
    for name in names:
        rows = df.select(F.lit(name).alias("column_name"), _truncated(name, finest).alias("_fine"))
        counted = rows.groupBy("column_name", "_fine").agg(F.count("*").alias("cnt"))
        stacked = counted if stacked is None else stacked.unionByName(counted)
    each = F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "_fine").alias("bucket")) for u in units])
    exploded = stacked.select("column_name", "cnt", F.inline(each))
    return exploded.groupBy("column_name", "unit", "bucket").agg(F.sum("cnt").alias("cnt"))


def rollup_spans(df: DataFrame, dates: Sequence[str] | None = None, units: Sequence[str] = UNITS) -> DataFrame:
    """Per date column and unit: number of buckets, first and last bucket."""
    spans = buckets_per_unit(df, dates, units).groupBy("column_name", "unit")
    return spans.agg(
        F.count("bucket").alias("row_count"),
        F.date_format(F.min("bucket"), "yyyy-MM-dd HH:mm:ss").alias("start_date"),
        F.date_format(F.max("bucket"), "yyyy-MM-dd HH:mm:ss").alias("end_date"),
    )


def _ranked(spans: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col("unit"))
    return spans.withColumn("_rank", order)


def auto_granularity(df: DataFrame, date: str, most: int = MOST_POINTS) -> DataFrame:
    """The finest unit whose rollup has between one and ``most`` points."""
    spans = _ranked(rollup_spans(df, [date]))
    fitting = spans.filter(F.col("row_count").between(1, most)).orderBy("_rank").limit(1)
    return fitting.select("unit", F.col("row_count").alias("n"))


def auto_rollup(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """Counts and sums at the granularity chosen automatically; no row when none fits."""
    choice = auto_granularity(df, date).first()
    if choice is None:
        return rollup_sum(df, date, UNITS[-1], value).limit(0)
    return rollup_sum(df, date, choice["unit"], value)


def auto_granularity_pair(df: DataFrame, date: str) -> DataFrame:
    """One row: the coarsest unit with more than 10 points and the finest with at most 10,000."""
    spans = _ranked(rollup_spans(df, [date]).filter("row_count > 0"))
    coarse = F.when(F.col("row_count") > PAIR_LEAST, F.col("_rank"))
    fine = F.when(F.col("row_count") <= PAIR_MOST, F.col("_rank"))
    return spans.agg(
        F.max_by("unit", coarse).alias("coarse_unit"),
        F.min_by("unit", fine).alias("fine_unit"),
    )


def bucket_labels(df: DataFrame, date: str, unit: str) -> DataFrame:
    """Label and epoch seconds of every bucket."""
    buckets = _bucketed(df, date, unit, drop_null=True).distinct()
    seconds = F.unix_timestamp("_bucket").alias("epoch_s")
    return buckets.select(bucket_label(F.col("_bucket"), unit).alias("label"), seconds)


def units_of(df: DataFrame, date: str) -> tuple[str, ...]:
    """Units that make sense for a date column: no hours for plain dates."""
    return UNITS if has_time(df, date) else UNITS[1:]


def all_rollups(
    df: DataFrame, dates: Sequence[str] | None = None, value: str | None = None
) -> DataFrame:
    """The count-and-sum rollups of every date column and unit in one long table.

    ``rollup`` is ``<column>__<unit>``; one scan per date column counts the finest buckets,
    and all coarser units are built from those.
    """
    names = date_columns(df) if dates is None else list(dates)
    number = value or first_numeric_column(df)
    whole = total(df, number) if number else F.lit(None).cast("double")
    stacked = None
    for name in names:
        units = units_of(df, name)
        fine = df.groupBy(_truncated(name, units[0]).alias("_fine")).agg(
            F.count("*").alias("cnt"), whole.alias("sum_value")
        )
        each = [
            F.struct(
                F.lit(f"{name}__{u}").alias("rollup"),
                F.date_trunc(u, "_fine").alias("_bucket"),
                bucket_text(F.date_trunc(u, "_fine"), u).alias("datetime"),
            )
            for u in units
        ]
        coarse = (
            fine.select("cnt", "sum_value", F.inline(F.array(*each)))
            .groupBy("rollup", "_bucket", "datetime")
            .agg(F.sum("cnt").alias("cnt"), F.sum("sum_value").cast("double").alias("sum_value"))
            .drop("_bucket")
        )
        stacked = coarse if stacked is None else stacked.unionByName(coarse)
    if stacked is None:
        raise ValueError("the table has no date column")
    return stacked


def _finest(units: Sequence[str]) -> str:
    """The unit whose buckets all the wanted ones consist of; weeks do not nest in months."""
    nested = ["day" if check_unit(u) == "week" else u for u in units]
    return min(nested, key=UNITS.index)


def _fine_values(df: DataFrame, dates: Sequence[str], columns: Sequence[str], unit: str, partitions: int) -> DataFrame:
    """The counted values of every column per date column and finest bucket, from one scan."""
    buckets = F.array(
        *[F.struct(F.lit(i).alias("_date"), _truncated(d, unit).cast("timestamp_ntz").alias("_fine")) for i, d in enumerate(dates)]
    )
    numbers = [column(c).cast("double").alias(f"_n{i}") for i, c in enumerate(columns)]
    narrow = df.select(F.inline(buckets), *numbers)
    return value_counts(narrow, [f"_n{i}" for i in range(len(numbers))], ["_date", "_fine"], partitions)


def all_measures(
    df: DataFrame,
    dates: Sequence[str] | None = None,
    units: Sequence[str] = UNITS,
    columns: Sequence[str] | None = None,
    measures: Sequence[str] = MEASURES,
    exact: bool = True,
) -> DataFrame:
    """The measure rollups of every date column and unit in one long table, NULL buckets kept.

    One scan counts the values per finest bucket of every date column. These counts are written once
    and ranked together for the buckets of all units; a value of a coarse bucket keeps a row for each of its
    finest ones, as a ranking needs no merged copies.
    Without ``exact`` (or without medians) the rows are aggregated at once, without counted values.
    """
    dates = date_columns(df) if dates is None else list(dates)
    if not dates:
        raise ValueError("the table has no date column")
    names = numeric_columns(df) if columns is None else list(columns)
    levels = [(i, u) for i in range(len(dates)) for u in units]
    keys = ["_rollup", "_bucket"]
    if exact and names and "median" in measures:
        partitions = partitions_for(df.count() * len(names) * len(levels))
        finest = _finest(units)
        leveled = _leveled(cut_lineage(_fine_values(df, dates, names, finest, partitions), partitions), levels, finest)
        long = summarize_counted(leveled, names, [0.5], keys, partitions=partitions).withColumn("median", F.get("q", F.lit(0)))
        counts = leveled.filter(F.col(INDEX) == 0).groupBy(*keys).agg(F.sum("_rows").alias("cnt"))
    else:
        each = [
            F.struct(F.lit(n).alias("_rollup"), _truncated(dates[i], u).cast("timestamp_ntz").alias("_bucket"))
            for n, (i, u) in enumerate(levels)
        ]
        rows = df.select(F.inline(F.array(*each)), *[column(c) for c in names])
        counts = rows.groupBy(*keys).agg(F.count("*").alias("cnt"))
        long = None
        if names and measures:
            long = summarize(rows, names, [0.5] if "median" in measures else [], keys, exact)
            long = long.withColumn("median", F.get("q", F.lit(0)))
    return _as_rollups(counts, long, [(dates[i], u) for i, u in levels], names, measures)


def _leveled(fine: DataFrame, levels: Sequence[tuple[int, str]], finest: str) -> DataFrame:
    """The finest buckets, once for each wanted level of their date column."""
    several = len({i for i, _ in levels}) > 1
    each = []
    for n, (i, u) in enumerate(levels):
        bucket = F.col("_fine") if u == finest else F.date_trunc(u, "_fine").cast("timestamp_ntz")
        level = F.struct(F.lit(n).alias("_rollup"), bucket.alias("_bucket"))
        each.append(F.when(F.col("_date") == i, level) if several else level)
    rows = fine.select(F.inline(F.array(*each)), INDEX, "_v", "_copies", "_rows")
    return rows.filter(F.col("_rollup").isNotNull()) if several else rows


def _as_rollups(
    counts: DataFrame,
    long: DataFrame | None,
    levels: Sequence[tuple[str, str]],
    names: Sequence[str],
    measures: Sequence[str],
) -> DataFrame:
    """Counts and long measures as one row per rollup and bucket, in one aggregate."""
    rows = counts
    if long is not None and measures:
        rows = counts.unionByName(long.drop("cnt", "q"), allowMissingColumns=True)
        picked = [
            F.max(F.when(F.col("column_name") == name, F.col(m))).alias(f"{m}__{name}")
            for name in names
            for m in measures
        ]
        rows = rows.groupBy("_rollup", "_bucket").agg(F.max("cnt").alias("cnt"), *picked)
    text, label = F.lit(None).cast("string"), F.array(*[F.lit(f"{d}__{u}") for d, u in levels])
    for n, (_, unit) in enumerate(levels):
        text = F.when(F.col("_rollup") == n, bucket_text(F.col("_bucket"), unit)).otherwise(text)
    kept = [column(c) for c in rows.columns if c not in ("_rollup", "_bucket", "cnt")]
    return rows.select(
        text.alias("datetime"), "cnt", F.lit(ROW_TAG).alias("common"), *kept, F.get(label, F.col("_rollup")).alias("rollup")
    )
