"""Registered queries: every operator over the given tables.

Doubles are rounded where summation order or interpolation may differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import column, computed, numeric_columns
from tabulens.functions.datetimes import canonical_moment, moment_kind, parse_moment
from tabulens.operators import (
    cardinality,
    distribution,
    frequency,
    numeric,
    overview,
    rollups,
    sketches,
    strings,
    textnumbers,
)
from tabulens.plans import profile
from tabulens.session import fresh_path
from tabulens.sinks import export, load
from tabulens.sources import archives, delimited, files

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """Every double column rounded; ``nudge`` is added first, so that the last bit of a sum does not decide a tie."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(
        *[F.round(column(c) + F.lit(nudge), digits).alias(c) if c in doubles else column(c) for c in df.columns]
    )


def _csv_copy(df: DataFrame, name: str, **options) -> str:
    """A CSV copy of a table in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(escape='"', **options).csv(path)
    return path


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[column(c).cast("string").alias(c) for c in df.columns])


def _csv_lines(df: DataFrame) -> DataFrame:
    """A table as CSV text lines, one column."""
    return df.select(F.to_csv(F.struct(*df.columns), {"escape": '"'}).alias("line"))


def _scan_packed(spark: SparkSession, folder: str, packing: str) -> DataFrame:
    part = table(spark, folder, "part")
    target = fresh_path(spark, f"part-{packing}")
    written = archives.write_packed(_csv_lines(part), target, packing)
    paths = [r["path"] for r in written.collect()]  # one path per task
    rows = delimited.read_delimited(spark, paths, part.columns, ",", header=False, packed=True)
    return rows.drop(delimited.CORRUPT)


def _csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return delimited.read_auto(spark, _csv_copy(part, "part", header=True, sep=";")).drop(delimited.CORRUPT)


def _csv_scan_gz(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    path = _csv_copy(part, "part-gz", header=True, compression="gzip")
    return delimited.read_auto(spark, path).drop(delimited.CORRUPT)


def _csv_scan_quoted(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    path = _csv_copy(turns, "conversations", header=True)
    return delimited.read_auto(spark, path).drop(delimited.CORRUPT)


# How the tables are written for the dialect queries.
DIALECTS = {
    "customer": (",", True),
    "nation": (";", True),
    "part": ("\t", True),
    "region": ("|", True),
    "supplier": (",", False),
}


def _survey(spark: SparkSession, folder: str) -> DataFrame:
    """The given tables as CSV files of several dialects, surveyed together."""
    root = fresh_path(spark, "dialects")
    for name, (sep, header) in DIALECTS.items():
        rows = table(spark, folder, name)
        if name == "part":
            rows = rows.toDF("Part Key", "Näme (part)", "Brand#", "тип", "Size", "Size!")
        rows.write.options(sep=sep, header=header).csv(f"{root}/{name}")
    found = files.survey_files(spark, [f"{root}/{n}" for n in DIALECTS])
    return found.withColumn("table_name", F.element_at(F.split("path", "/"), -2))


def _csv_dialect(spark: SparkSession, folder: str) -> DataFrame:
    return _survey(spark, folder).select("table_name", "delimiter").distinct()


def _csv_header(spark: SparkSession, folder: str) -> DataFrame:
    return _survey(spark, folder).select("table_name", "has_header", F.col("n_columns").cast("bigint")).distinct()


def _csv_headers_clean(spark: SparkSession, folder: str) -> DataFrame:
    names = _survey(spark, folder).select("table_name", F.array_join("headers", ",").alias("headers"))
    return names.distinct()


def _sketch_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct counts from sketches kept by type and merged, and whether the exact ones lie in their range."""
    events = table(spark, folder, "events")
    found = sketches.estimates(sketches.merged(sketches.sketch(events, by=["event_type"])), [])
    exact = cardinality.cardinality(events).withColumnRenamed("uniq", "exact")
    within = F.col("exact").between(F.col("uniq_low"), F.col("uniq_high"))
    return found.join(exact, "column_name").select("column_name", "cnt", F.col("exact").alias("uniq"), within.alias("within"))


def _sketch_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles from sketches kept by type and merged, and whether their ranks are within twice the bound."""
    events, points = table(spark, folder, "events"), [0.01, 0.1, 0.5, 0.9, 0.99]
    names = numeric_columns(events)
    found = sketches.estimates(sketches.merged(sketches.sketch(events, names, by=["event_type"])), points)
    q = {r["column_name"]: r["q"] for r in found.collect()}  # one row a column
    error, rows = 2 * sketches.RANK_ERROR, []
    for name in names:
        for point, value in zip(points, q[name], strict=True):
            below, upto = (F.avg(x.cast("double")) for x in (column(name) < value, column(name) <= value))
            rows.append(F.struct(F.lit(name).alias("column_name"), F.lit(point).alias("p"), ((below <= point + error) & (upto >= point - error)).alias("within")))
    return events.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _csv_infer_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy"))
    text = delimited.read_auto(spark, _csv_copy(rows, "orders-sample", header=True))
    return delimited.infer_types(text, sample_rows=500).select("column_name", "type")


def _csv_infer_types(spark: SparkSession, folder: str) -> DataFrame:
    found = None
    for name in ("customer", "events", "nation", "orders"):
        rows = table(spark, folder, name)
        if name == "orders":
            rows = rows.withColumn("o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy"))
        copy = _csv_copy(rows, name, header=True, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
        text = delimited.read_auto(spark, copy)
        types = delimited.infer_types(text).withColumn("table_name", F.lit(name))
        found = types if found is None else found.unionByName(types)
    return found


def _csv_load(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    text = delimited.read_auto(spark, _csv_copy(part, "part", header=True), prefix=True)
    return load.load(text, order=["0001_p_partkey"])


def _parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates in six layouts, by order key, parsed back."""
    layouts = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy.MM.dd HH:mm:ss", "yyyy/MM/dd")
    orders = table(spark, folder, "orders")
    texts = F.array(*[F.date_format("o_orderdate", f) for f in layouts])
    text = F.get(texts, (F.col("o_orderkey") % len(layouts)).cast("int"))
    parsed = orders.select("o_orderkey", text.alias("t"))
    return parsed.select("o_orderkey", parse_moment(F.col("t")).cast("date").alias("d"))


def _parse_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Event times with their fractions, as ISO text with T and Z, parsed back."""
    events = table(spark, folder, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    parsed = computed(events, ["event_id"], t=text)
    return parsed.select(
        "event_id",
        moment_kind(F.col("t")).alias("kind"),
        canonical_moment(F.col("t"), full=True).alias("canonical"),
    )


def _numeric_like(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return strings.likeness(_as_text(events)).select("column_name", F.round("numeric_share", 4).alias("share"), "numeric_like")


def _date_like(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    found = strings.likeness(_as_text(orders.withColumn("o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy"))))
    return found.select("column_name", F.round("date_share", 4).alias("share"), "date_like", "all_dates")


def _full_profile(df: DataFrame) -> DataFrame:
    return rounded(profile.profile_rows(profile.full_profile(df)), 4, 1e-8)


def _density(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    bins = distribution.equal_width_histogram(line, "l_quantity", 10, 0.0, 50.0)
    return distribution.density(bins).select("bin", F.round("density", 6).alias("density"))


def _histogram_bar(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    bins = distribution.equal_width_histogram(events, "value", 10, 1.0, 200.0)
    return distribution.with_bars(bins).select("bin", "height", "bar")


def _group_lines(spark: SparkSession, folder: str) -> DataFrame:
    top = frequency.top_values(table(spark, folder, "part"))
    return frequency.value_lines(frequency.group_table(top))


def _on(name: str, build: Callable[[DataFrame], DataFrame], digits: int | None = 4) -> Query:
    """A query that applies one operator to one table."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = build(table(spark, folder, name))
        return result if digits is None else rounded(result, digits)

    return run


def _rollup(name: str, date: str, unit: str, measures: tuple[str, ...], digits: int) -> Query:
    return _on(name, lambda t: rollups.rollup(t, date, unit, measures=measures), digits)


def _export_rollups(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    path = fresh_path(spark, "rollups")
    export.export_rollups(rollups.all_rollups(events, ["ts"], "user_id"), path)
    return export.read_rollups(spark, path, "cnt bigint, datetime string, sum_value double")


def all_queries() -> dict[str, Query]:
    plain = ("min", "max", "median", "avg")
    return {
        # sources and sinks
        "csv_dialect": _csv_dialect,
        "csv_header": _csv_header,
        "csv_headers_clean": _csv_headers_clean,
        "csv_infer_sample": _csv_infer_sample,
        "csv_infer_types": _csv_infer_types,
        "csv_scan": _csv_scan,
        "csv_scan_gz": _csv_scan_gz,
        "csv_scan_lz4": lambda s, d: _scan_packed(s, d, "lz4"),
        "csv_scan_quoted": _csv_scan_quoted,
        "csv_scan_zip": lambda s, d: _scan_packed(s, d, "zip"),
        "csv_load": _csv_load,
        "parse_dates": _parse_dates,
        "parse_moments": _parse_moments,
        "describe_table": _on("nation", overview.describe),
        "table_size": _on("orders", overview.table_size),
        "export_rollups": _export_rollups,
        "rollup_sorted": _on(
            "events", lambda t: rollups.oldest_first(rollups.rollup(t, "ts", "hour", [])).select("datetime", "cnt", "common")
        ),
        # whole-table aggregates
        "row_count": _on("events", numeric.row_count),
        "uniq_counts": _on("events", cardinality.cardinality),
        "uniq_counts_text": _on("documents", cardinality.cardinality),
        "sketch_distinct": _sketch_distinct,
        "sketch_quantiles": _sketch_quantiles,
        "uniq_counts_approx": _on("events", lambda t: cardinality.cardinality(t, exact=False)),
        "uniq_quantiles": _on("part", cardinality.cardinality_quantiles),
        "numeric_stats": _on("events", numeric.numeric_stats),
        "numeric_stats_approx": _on("events", lambda t: numeric.numeric_stats(t, exact=False)),
        "numeric_sum": _on("lineitem", numeric.numeric_sum, 2),
        "profile_long": _on("lineitem", lambda t: numeric.profile_long(t).withColumn("sum", F.round("sum", 2))),
        "profile_merge": _on("part", lambda t: profile.merge_profiles(
            profile.count_profile(t),
            profile.distinct_profile(t),
            profile.numeric_profile(t).select("column_name", "avg", "is_numeric"),
        )),
        "profile_table": _on("part", profile.profile_table),
        "profile_report": _on("part", lambda t: profile.profile_report(profile.profile_table(t))),
        "full_profile_part": _on("part", _full_profile, None),
        "full_profile_events": _on("events", _full_profile, None),
        "full_profile_orders": _on("orders", _full_profile, None),
        "column_overview": _on("part", overview.column_overview),
        "describe_numbers": _on("customer", overview.describe_numbers),
        "sample_values": _on("orders", overview.sample_values),
        "missing_values": _on("part", strings.missing_values),
        # frequencies
        "top_values": _on("part", frequency.top_values),
        "rare_values": _on("part", lambda t: frequency.top_values(t, rare=True, min_count=2)),
        "group_lines": _group_lines,
        "top_combos": _on("part", frequency.top_combos),
        "rare_combos": _on("part", lambda t: frequency.top_combos(t, rare=True, min_count=2)),
        "rare_combos_all": _on(
            "part", lambda t: frequency.top_combos(t, ["p_brand", "p_type", "p_name"], rare=True).drop("percentage")
        ),
        "category_counts": _on("events", lambda t: frequency.category_counts(t, "event_type")),
        "most_least_common": _on("part", lambda t: frequency.most_least_common(t, "p_name")),
        "least_common10": _on(
            "part",
            lambda t: frequency.category_counts(t, "p_brand", 10, rare=True, skip_empty=False).withColumnRenamed(
                "category", "p_brand"
            ),
        ),
        "extreme_values": _on("part", frequency.extreme_values),
        "group_summary": _on("events", lambda t: numeric.group_summary(t, ["event_type"], ["value"]), None),
        # strings
        "string_profile": _on("documents", lambda t: strings.string_profile(t, "text")),
        "length_distribution": _on("documents", lambda t: strings.length_distribution(t, "text")),
        "numeric_like": _numeric_like,
        "date_like": _date_like,
        # distributions
        "numeric_detail": _on("events", lambda t: numeric.numeric_detail(t, "value")),
        "iqr_outliers": _on("events", lambda t: distribution.iqr_outliers(t, "value")),
        "decile_buckets": _on(
            "events", lambda t: distribution.decile_buckets(t, "value").select("bucket", "mid", "cnt")
        ),
        "quantile_histogram": _on(
            "events",
            lambda t: distribution.quantile_histogram(t, "value").select("range_start", "range_end", "cnt"),
            6,
        ),
        "adaptive_histogram": _on("events", lambda t: distribution.adaptive_histogram(t, "value")),
        "adaptive_range_by_start": _on("events", lambda t: distribution.adaptive_histogram(t, "value", 10, 1.0, 100.0)),
        "adaptive_range_by_height": _on(
            "lineitem", lambda t: distribution.adaptive_histogram(t, "l_extendedprice", 100, 1000.0, 50000.0, by_height=True)
        ),
        "range_histogram": _on(
            "events", lambda t: distribution.equal_width_histogram(t, "value", 10, 1.0, 100.0).select("bin", "height")
        ),
        "central_histogram": _on(
            "events", lambda t: distribution.central_histogram(t, "value").select("bin", "height")
        ),
        "density": _density,
        "histogram_bar": _histogram_bar,
        # numbers in texts
        "extract_numbers": _on("documents", lambda t: textnumbers.extract_numbers(t, "doc_id", "text"), None),
        "text_route": _on(
            "documents",
            lambda t: textnumbers.route(t, "text").groupBy("has_numbers").agg(F.count("*").alias("cnt")),
        ),
        "text_number_stats": _on("documents", lambda t: textnumbers.text_number_stats(t, "doc_id", "text"), None),
        "text_number_outliers": _on(
            "documents",
            lambda t: textnumbers.text_number_outliers(t, "doc_id", "text").select("doc_id", "outliers"),
        ),
        "text_outlier_values": _on(
            "documents",
            lambda t: textnumbers.text_number_outliers(t, "doc_id", "text").select(
                "doc_id", F.explode("outlier_values").alias("outlier")
            ),
            None,
        ),
        # time
        "rollup_hour": _rollup("events", "ts", "hour", rollups.MEASURES, 7),
        "rollup_day": _rollup("events", "ts", "day", plain, 7),
        "rollup_month": _rollup("orders", "o_orderdate", "month", plain, 6),
        "rollup_year": _rollup("orders", "o_orderdate", "year", plain, 6),
        "rollup_all_measures": _on(
            "lineitem",
            lambda t: rounded(rollups.all_measures(t, units=("day", "month", "year")), 4, 1e-8),
            None,
        ),
        "rollup_sum_day": _on("events", lambda t: rollups.rollup_sum(t, "ts", "day", "user_id")),
        "rollup_all_sums": _on("orders", lambda t: rollups.all_rollups(t), 2),
        "rollup_sum_week": _on("events", lambda t: rollups.rollup_sum(t, "ts", "week", "user_id", drop_null=True)),
        "rollup_week": _on("events", lambda t: rollups.rollup_count(t, "ts", "week")),
        "rollup_summary": _on("events", lambda t: rollups.rollup_summary(t, "ts", "day")),
        "rollup_spans": _on("events", lambda t: rollups.rollup_spans(t, ["ts"])),
        "auto_granularity": _on("orders", lambda t: rollups.auto_granularity(t, "o_orderdate")),
        "auto_rollup": _on("orders", lambda t: rollups.auto_rollup(t, "o_orderdate", "o_orderkey")),
        "auto_granularity_pair": _on("events", lambda t: rollups.auto_granularity_pair(t, "ts")),
        "bucket_labels": _on("orders", lambda t: rollups.bucket_labels(t, "o_orderdate", "month")),
    }
