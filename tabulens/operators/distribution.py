"""Outliers, buckets between quantiles, histograms and densities of a numeric column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import column
from tabulens.operators.quantiles import equi_depth, summarize

# Border quantiles of the two bucket reports, fence width, decimals of a border.
DECILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
BORDER_QUANTILES = (0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99)
FENCE = 1.5
BORDER_DECIMALS = 6
# Runs of equal size that are merged to one bin of an adaptive histogram, on average.
FINENESS = 10


def iqr_fences(df: DataFrame, name: str, exact: bool = True, k: float = FENCE) -> DataFrame:
    """One row: the values ``k`` interquartile ranges outside the quartiles."""
    q = summarize(df, [name], [0.25, 0.75], exact=exact)
    q1, q3 = F.col("q").getItem(0), F.col("q").getItem(1)
    return q.select(
        F.round(q1 - k * (q3 - q1), BORDER_DECIMALS).alias("lo"),
        F.round(q3 + k * (q3 - q1), BORDER_DECIMALS).alias("hi"),
    )


def _literals(row_of_borders: DataFrame, size: int) -> list[Column]:
    """The fields of a one-row table as literals, which reach the scan as pushed filters."""
    row = row_of_borders.first()
    return [F.lit(None if row is None else row[i]).cast("double") for i in range(size)]


def iqr_outliers(df: DataFrame, name: str, exact: bool = True, k: float = FENCE) -> DataFrame:
    """Number and range of the values outside the fences."""
    lo, hi = _literals(iqr_fences(df, name, exact, k), 2)
    value = column(name)
    outside = df.filter((value < lo) | (value > hi))
    return outside.agg(
        F.count("*").alias("outliers_count"),
        F.min(value).alias("min_outlier"),
        F.max(value).alias("max_outlier"),
    )


def bucket_counts(df: DataFrame, name: str, borders: list[Column], closed: bool) -> DataFrame:
    """Counts of all buckets between neighbouring borders, in one pass.

    Closed buckets include both borders (values on a border count twice), half-open ones
    exclude the upper.
    """
    value = column(name).cast("double")
    buckets = []
    for i, (lo, hi) in enumerate(zip(borders, borders[1:]), 1):
        inside = (value >= lo) & ((value <= hi) if closed else (value < hi))
        buckets.append(
            F.struct(
                F.lit(i).cast("bigint").alias("bucket"),
                lo.alias("range_start"),
                hi.alias("range_end"),
                F.count_if(inside).alias("cnt"),
            )
        )
    counted = df.agg(F.array(*buckets).alias("_rows")).select(F.inline("_rows"))
    middle = (F.col("range_start") + F.col("range_end")) / 2
    return counted.withColumn("mid", middle)


def _borders(df: DataFrame, name: str, points: tuple[float, ...], exact: bool) -> DataFrame:
    """One row: the minimum and the quantiles, rounded as borders."""
    q = summarize(df, [name], points, exact=exact)
    values = [F.col("min"), *[F.col("q").getItem(i) for i in range(len(points))]]
    return q.select(*[F.round(v, BORDER_DECIMALS).alias(f"b{i}") for i, v in enumerate(values)])


def decile_buckets(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Rows in each half-open bucket between the minimum and the ten deciles."""
    borders = _literals(_borders(df, name, DECILES, exact), len(DECILES) + 1)
    return bucket_counts(df, name, borders, closed=False)


def quantile_histogram(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Rows in each closed range between seven quantiles."""
    borders = _literals(_borders(df, name, BORDER_QUANTILES, exact), len(BORDER_QUANTILES) + 1)
    return bucket_counts(df, name, borders[1:], closed=True)


def adaptive_histogram(
    df: DataFrame,
    name: str,
    n_bins: int = 20,
    lo: float | None = None,
    hi: float | None = None,
    by_height: bool = False,
    fineness: int = FINENESS,
) -> DataFrame:
    """Contiguous bins whose borders follow the data, over all values or those of a closed range.

    Runs of about equal size, ``fineness`` for each bin, are merged from the bottom up: the neighbours with
    the closest centres become one, its centre weighted by heights, until ``n_bins`` are left. A bin ends
    where the next one begins, the last at the maximum; heights are exact. NULL and NaN are in no bin.
    The result depends on the values alone, not on their partitions. Sorted by start or by falling height.
    """
    value = column(name).cast("double")
    if lo is not None:
        df = df.filter(value >= F.lit(float(lo)))
    if hi is not None:
        df = df.filter(value <= F.lit(float(hi)))
    runs = equi_depth(df, name, n_bins * fineness)
    middle = ((F.col("lo") + F.col("hi")) / 2).alias("x")
    run = F.struct("lo", "hi", middle, F.col("height").cast("double").alias("y"))
    # At most n_bins * fineness runs, whatever the table's size.
    merged = runs.agg(F.array_sort(F.collect_list(run)).alias("_runs")).select(
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size("_runs") - n_bins, F.lit(1))),
            F.col("_runs"),
            lambda bins, _: F.when(F.size(bins) > n_bins, _merge_closest(bins)).otherwise(bins),
        ).alias("_bins")
    )
    each = merged.select("_bins", F.posexplode("_bins").alias("_i", "_b"))
    following = F.get(F.col("_bins"), F.col("_i") + 1)["lo"]
    start, end = F.col("_b.lo"), F.coalesce(following, F.col("_b.hi"))
    bins = each.select(
        start.alias("range_start"), end.alias("range_end"), F.col("_b.y").alias("height"), ((start + end) / 2).alias("mid")
    )
    return bins.orderBy(F.desc("height"), "range_start") if by_height else bins.orderBy("range_start")


def _merge_closest(bins: Column) -> Column:
    """An ordered array of bins with the first of its closest pairs of neighbours as one."""
    gaps = F.transform(
        F.sequence(F.lit(1), F.size(bins) - 1),
        lambda i: F.struct((F.element_at(bins, i + 1)["x"] - F.element_at(bins, i)["x"]).alias("gap"), i.alias("i")),
    )

    def joined(at: Column) -> Column:
        a, b = F.element_at(bins, at), F.element_at(bins, at + 1)
        height = a["y"] + b["y"]
        centre = (a["x"] * a["y"] + b["x"] * b["y"]) / height
        one = F.struct(a["lo"].alias("lo"), b["hi"].alias("hi"), centre.alias("x"), height.alias("y"))
        return F.concat(F.slice(bins, 1, at - 1), F.array(one), F.slice(bins, at + 2, F.size(bins)))

    # The place passes through a lambda, so that the gaps are computed once.
    return F.element_at(F.transform(F.array(F.array_min(gaps)["i"]), joined), 1)


def _bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    place = F.floor((value - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")


def _counted_bins(df: DataFrame, name: str, lo: Column, hi: Column, bins: int) -> DataFrame:
    """Every bin between two literal borders, also empty ones; one bin where the borders are equal, none without borders."""
    value = column(name).cast("double")
    inside = df.filter((value >= lo) & (value <= hi))
    heights = inside.groupBy(_bin_of(value, lo, hi, bins).alias("bin")).agg(F.count("*").alias("_height"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).filter((lo < hi) | ((lo == hi) & (F.col("bin") == 0)))
    width = (hi - lo) / bins
    start = lo + F.col("bin") * width
    height = F.coalesce("_height", F.lit(0)).cast("long")
    return every.join(heights, "bin", "left").select(
        "bin", start.alias("range_start"), (start + width).alias("range_end"), height.alias("height")
    )


def equal_width_histogram(
    df: DataFrame, name: str, bins: int, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Bins of equal width over a closed range, by default from the minimum to the maximum."""
    if lo is not None and hi is not None:
        return _counted_bins(df, name, F.lit(float(lo)), F.lit(float(hi)), bins)
    value = column(name).cast("double")
    least = F.min(value) if lo is None else F.lit(float(lo))
    most = F.max(value) if hi is None else F.lit(float(hi))
    return _counted_bins(df, name, *_literals(df.agg(least, most), 2), bins)


def central_histogram(
    df: DataFrame, name: str, bins: int = 100, low: float = 0.4, high: float = 0.6, exact: bool = True
) -> DataFrame:
    """Equal-width bins over the values between two quantiles."""
    q = summarize(df, [name], [low, high], exact=exact)
    border = [F.round(F.col("q").getItem(i), BORDER_DECIMALS) for i in (0, 1)]
    return _counted_bins(df, name, *_literals(q.select(*border), 2), bins)


def density(histogram: DataFrame) -> DataFrame:
    """Heights scaled so that the area over all bins is one; each bin keeps its own width.

    A bin without a width (one value) has no density.
    """
    area = F.sum(F.col("height")).over(Window.partitionBy(F.lit(0)))  # one row per bin
    width = F.col("range_end") - F.col("range_start")
    return histogram.withColumn("density", F.col("height") / F.nullif((area * width).cast("double"), F.lit(0.0)))


def with_bars(histogram: DataFrame, width: int = 10, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """A text bar per bin, its length scaled between the smallest and the largest height."""
    every = Window.partitionBy(F.lit(0))  # one row per bin
    least = F.min("height").over(every) if lo is None else F.lit(lo)
    most = F.max("height").over(every) if hi is None else F.lit(hi)
    share = (F.col("height") - least) / F.nullif((most - least).cast("double"), F.lit(0.0))
    length = F.round(F.greatest(F.least(F.coalesce(share, F.lit(1.0)), F.lit(1.0)), F.lit(0.0)) * width).cast("int")
    return histogram.withColumn("bar", F.repeat(F.lit("█"), length))

