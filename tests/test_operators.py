"""Frequencies, strings, distributions, text numbers, rollups and profiles on small tables."""

from __future__ import annotations

import datetime
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.functions.columns import bare_name, first_numeric_column, is_excluded, numeric_columns
from tabulens.functions.numbers import round_two, short_text
from tabulens.operators import cardinality, distribution, frequency, numeric, overview, rollups, strings, textnumbers
from tabulens.plans import drilldown, profile


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "red", "s", 1.0, None),
        (2, "red", "m", 2.0, ""),
        (3, "blue", "m", 3.0, "  "),
        (4, "blue", "l", 4.0, "x" * 200),
        (5, "green", None, None, "x" * 200),
        (6, None, "m", -0.0, "ёж"),
        (7, "red", "m", 0.0, "x" * 199 + "y"),
    ]
    return spark.createDataFrame(rows, "id bigint, color string, size string, v double, note string")


# --- columns and numbers ------------------------------------------------------------------


def test_column_classes(people):
    assert numeric_columns(people) == ["v"]
    assert first_numeric_column(people.drop("v")) is None
    assert bare_name("0003_slug") == "slug" and is_excluded("0003_slug") and not is_excluded("idx")


def test_rounding_and_short_text(spark):
    cases = {1.005: 1.0, 2.675: 2.68, -1.115: -1.12, 0.125: 0.13, -0.125: -0.13, 3.0e14: 3.0e14, 0.0: 0.0, 12.345678: 12.35}
    cases[2.675] = np.floor(2.675 * 100 + 0.5) / 100
    cases[-1.115] = -np.floor(1.115 * 100 + 0.5) / 100
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert {r[0]: r[1] for r in df.select("x", round_two(F.col("x"))).collect()} == cases
    texts = {1.0: "1", 100.0: "100", 0.0: "0", 25.5915: "25.591", 1234567.5: "1234567.5", -3.14159: "-3.142"}
    df = spark.createDataFrame([(x,) for x in texts], "x double")
    assert {r[0]: r[1] for r in df.select("x", short_text(F.col("x"))).collect()} == texts


# --- distinct values and frequencies --------------------------------------------------------


def test_cardinality(spark, people):
    exact = {r["column_name"]: r["uniq"] for r in cardinality.cardinality(people).collect()}
    assert exact == {"color": 3, "size": 3, "v": 5, "note": 5}
    many = spark.range(20_000).selectExpr("id % 3000 AS a", "cast(id as string) AS b")
    near = {r["column_name"]: r["uniq"] for r in cardinality.cardinality(many, exact=False).collect()}
    assert near["a"] == pytest.approx(3000, rel=0.08) and near["b"] == pytest.approx(20_000, rel=0.08)


def test_gate(spark):
    df = spark.range(3000).selectExpr(
        "'x' AS one", "cast(id % 2 as string) AS two", "cast(id % 999 as string) AS most",
        "cast(id % 1000 as string) AS over", "cast(id as string) AS all", "cast(null as string) AS none",
    )
    assert frequency.groupable_columns(df) == ["two", "most"]
    assert frequency.groupable_columns(df, exact=True) == ["two", "most"]


def test_top_and_rare_values(people, rows):
    top = frequency.top_values(people, ["color", "size"], n=2)
    assert rows(top) == [
        ("color", "blue", 2, pytest.approx(200 / 7)),
        ("color", "red", 3, pytest.approx(300 / 7)),
        ("size", "l", 1, pytest.approx(100 / 7)),
        ("size", "m", 4, pytest.approx(400 / 7)),
    ]
    rare = frequency.top_values(people, ["color", "size"], rare=True, min_count=2, n=1)
    assert rows(rare, "column_name", "value", "cnt") == [("color", "blue", 2), ("size", "m", 4)]
    lines = frequency.value_lines(frequency.top_values(people, ["color"], n=1))
    assert rows(lines) == [("color", "red (3, 42.86%)")]
    assert rows(frequency.top_values(people.select("id"))) == []


def test_combinations(people, rows):
    assert rows(frequency.top_combos(people, ["color", "size"], n=1), "cnt", "color", "size") == [(2, "red", "m")]
    rare = frequency.top_combos(people, ["color", "size"], rare=True, n=2)
    assert [tuple(r)[:3] for r in rare.collect()] == [(1, None, "m"), (1, "blue", "l")]
    with pytest.raises(ValueError):
        frequency.top_combos(people, ["color"])


def test_single_column_lists(people):
    assert [tuple(r) for r in frequency.category_counts(people, "color", 2).collect()] == [("red", 3), ("blue", 2)]
    found = [tuple(r) for r in frequency.most_least_common(people, "color", 1).collect()]
    assert found == [("red", 3, "most_common"), ("green", 1, "least_common")]
    ends = {r["column_name"]: tuple(r)[1:] for r in frequency.extreme_values(people, ["color", "note"]).collect()}
    assert ends["color"] == ("red", 3, "blue", 2)
    assert ends["note"] == ("x" * 200, 2, "x" * 200, 2)
    assert frequency.group_table(frequency.top_values(people, ["color"])).columns == [
        "cnt", "column_name", "percentage", "value"
    ]


def test_group_summary(people, rows):
    assert rows(numeric.group_summary(people, ["size"], ["v"])) == [
        ("l", 1, 4.0), ("m", 4, 5.0), ("s", 1, 1.0), (None, 1, None)
    ]


# --- strings ---------------------------------------------------------------------------------


@pytest.mark.parametrize("exact", [True, False])
def test_string_profile(people, exact):
    row = strings.string_profile(people, "note", exact).first()
    lengths = [0, 2, 200, 200, 4, 200]
    assert (row["total_count"], row["unique_count"], row["empty_count"], row["whitespace_count"]) == (7, 5, 1, 2)
    assert (row["min_length"], row["max_length"]) == (0, 200)
    assert row["avg_length"] == pytest.approx(sum(lengths) / 6)
    assert row["unique_percent"] == pytest.approx(500 / 7)


def test_string_profile_of_nothing(people):
    row = strings.string_profile(people.limit(0), "note").first()
    assert row["total_count"] == 0 and row["avg_length"] is None and row["unique_percent"] is None


def test_lengths_and_missing(people, rows):
    assert [tuple(r) for r in strings.length_distribution(people, "note", 3).collect()] == [(2, 1), (4, 1), (200, 3)]
    found = dict(rows(strings.missing_values(people)))
    assert found == {"id": 0, "color": 1, "size": 1, "v": 1, "note": 1}


def test_likeness(spark):
    cases = {
        "depths": ["0.5", " 12 ", "-7", "3e2", "41"],
        "half": ["0.5", "deep", "-7", "shallow", "mud"],
        "blank": ["", " ", "", None, ""],
        "days": ["30.04.2019", "2019-05-01", "02/05/2019", "2019-05-03 07:00:00", "2019-05-04"],
        "broken": ["30.04.2019", "2019-05-01", "soon", "never", "2019-05-04"],
        "names": ["Inari", "Vättern", "Balaton", "Ohrid", "Ladoga"],
    }
    df = spark.createDataFrame(list(zip(*cases.values())), ", ".join(f"{c} string" for c in cases))
    found = {r["column_name"]: r for r in strings.likeness(df).collect()}
    assert [c for c in cases if found[c]["numeric_like"]] == ["depths"]
    assert [c for c in cases if found[c]["date_like"]] == ["days"]
    assert [c for c in cases if found[c]["all_dates"]] == ["days"]


# --- distributions -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark):
    values = [float((i * 37) % 1000) / 7 for i in range(2000)] + [500.0, 900.0, -400.0, None]
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(4), [v for v in values if v is not None]


def test_outliers(numbers):
    df, values = numbers
    q1, q3 = np.quantile(values, [0.25, 0.75])
    outside = [v for v in values if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)]
    row = distribution.iqr_outliers(df, "v").first()
    assert tuple(row) == (len(outside), min(outside), max(outside))


def test_deciles_cover_all_but_the_maximum(numbers):
    df, values = numbers
    buckets = distribution.decile_buckets(df, "v").orderBy("bucket").collect()
    assert len(buckets) == 10
    assert sum(b["cnt"] for b in buckets) == len(values) - values.count(max(values))
    closed = distribution.quantile_histogram(df, "v").orderBy("bucket").collect()
    for b in closed:
        assert b["cnt"] == sum(b["range_start"] <= round(v, 9) <= b["range_end"] for v in values)


def test_histograms(numbers):
    df, values = numbers
    bins = distribution.equal_width_histogram(df, "v", 10).orderBy("bin").collect()
    assert sum(b["height"] for b in bins) == len(values)
    central = distribution.central_histogram(df, "v", 5).collect()
    lo, hi = np.quantile(values, [0.4, 0.6])
    assert sum(b["height"] for b in central) == sum(round(lo, 6) <= v <= round(hi, 6) for v in values)
    adaptive = distribution.adaptive_histogram(df, "v", 8).collect()
    assert len(adaptive) == 8 and sum(b["height"] for b in adaptive) == len(values)
    assert adaptive[0]["range_start"] == min(values) and adaptive[-1]["range_end"] == max(values)
    assert all(a["range_end"] == b["range_start"] for a, b in zip(adaptive, adaptive[1:]))


def test_density_and_bars(spark, numbers):
    df, _ = numbers
    for histogram in (distribution.equal_width_histogram(df, "v", 7), distribution.adaptive_histogram(df, "v")):
        dense = distribution.density(histogram).collect()
        area = sum(r["density"] * (r["range_end"] - r["range_start"]) for r in dense)
        assert area == pytest.approx(1.0)
    even = spark.createDataFrame([(float(i) - 0.5, i + 0.5, i) for i in range(1, 9)], "range_start double, range_end double, height int")
    dense = {r["height"]: r["density"] for r in distribution.density(even).collect()}
    assert dense == pytest.approx({i: i / 36 for i in range(1, 9)})
    bars = {r["height"]: len(r["bar"]) for r in distribution.with_bars(even, 7).collect()}
    assert bars == {i: i - 1 for i in range(1, 9)}


def test_one_value_only(spark):
    df = spark.createDataFrame([(4.0,)] * 3, "v double")
    assert [tuple(r) for r in distribution.equal_width_histogram(df, "v", 5).select("bin", "height").collect()] == [(0, 3)]
    assert distribution.iqr_outliers(df, "v").first()["outliers_count"] == 0


# --- numbers in texts ----------------------------------------------------------------------------


def test_extraction(spark):
    texts = {1: "7-8 and 1e5", 2: "a,1.5\n-.25,x 1.2.3", 3: "none", 4: "5. 12.", 5: "9" * 400 + " 3", 6: None, 7: "-–7--7"}
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    found = {}
    for row in textnumbers.extract_numbers(df, "k", "t").collect():
        found.setdefault(row["k"], []).append(row["num"])
    assert found == {1: [7, -8, 1, 5], 2: [1.5, -0.25, 1.2, 0.3], 4: [5, 12], 5: [3], 7: [7, -7]}
    routes = {r["k"]: r["has_numbers"] for r in textnumbers.route(df, "t").collect()}
    assert [k for k, v in routes.items() if v] == [1, 2, 4, 5, 7]


def test_extraction_against_a_regular_expression(spark):
    dice = random.Random(3)
    texts = ["".join(dice.choice("0123456789..--,,ae \n٣") for _ in range(dice.randrange(60))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {}
    for row in textnumbers.extract_numbers(df, "k", "t").collect():
        found.setdefault(row["k"], []).append(row["num"])
    for k, text in enumerate(texts):
        plain = text.replace(",", " ").replace("\n", " ")
        assert found.get(k, []) == [float(n) for n in re.findall(r"-?\d*\.?\d+", plain, re.ASCII)]


def two(x):
    return float(np.sign(x) * np.floor(abs(x) * 100 + 0.5) / 100)


def test_text_statistics_against_numpy(spark):
    texts = {1: [1, 2, 3, 4, 100, -50.5], 2: [7], 3: [2.25, 2.25, 9], 4: [0.1 * i for i in range(33)] + [1e6]}
    df = spark.createDataFrame([(k, " ".join(map(str, v))) for k, v in texts.items()], "k int, t string")
    stats = {r["k"]: r for r in textnumbers.text_number_stats(df, "k", "t").collect()}
    outliers = {r["k"]: r["outlier_values"] for r in textnumbers.text_number_outliers(df, "k", "t").collect()}
    for key, values in texts.items():
        row = stats[key]
        assert row["cnt"] == len(values)
        assert row["median"] == pytest.approx(two(statistics.median(values)), abs=0.011)
        for name, p in textnumbers.TEXT_QUANTILES.items():
            assert row[name] == pytest.approx(two(np.quantile(values, p)), abs=0.011)
        reach = 1.5 * (row["q3"] - row["q1"])
        assert outliers.get(key, []) == [v for v in values if v < row["q1"] - reach or v > row["q3"] + reach]


# --- rollups ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def visits(spark):
    start = datetime.datetime(2023, 12, 30, 22, 0)
    rows = [(start + datetime.timedelta(minutes=47 * i), i, float(i % 5)) for i in range(400)]
    rows += [(None, 1000, 9.0), (None, 1001, None)]
    return spark.createDataFrame(rows, "at timestamp_ntz, n bigint, w double").repartition(3), rows


@pytest.mark.parametrize("unit", ["hour", "day", "week", "month", "year"])
def test_rollup_against_python(visits, unit):
    df, rows = visits

    def bucket(t):
        if t is None:
            return None
        if unit == "hour":
            return t.strftime("%Y-%m-%d %H:00:00")
        if unit == "day":
            return t.strftime("%Y-%m-%d 00:00:00")
        if unit == "week":
            return (t - datetime.timedelta(days=t.weekday())).strftime("%Y-%m-%d")
        return t.strftime("%Y-%m-01" if unit == "month" else "%Y-01-01")

    groups = {}
    for t, n, w in rows:
        groups.setdefault(bucket(t), []).append((n, w))
    found = {r["datetime"]: r for r in rollups.rollup(df, "at", unit).collect()}
    assert set(found) == set(groups)
    for key, members in groups.items():
        ws = [w for _, w in members if w is not None]
        row = found[key]
        assert row["cnt"] == len(members) and row["common"] == "info"
        assert row["sum__n"] == sum(n for n, _ in members)
        assert row["median__w"] == pytest.approx(statistics.median(ws))
        assert row["min__w"] == min(ws) and row["max__w"] == max(ws)
    counts = {r["date"]: r["cnt"] for r in rollups.rollup_count(df, "at", unit).collect()}
    assert counts == {k: len(v) for k, v in groups.items() if k is not None}
    sums = {r["date"]: r["sum_value"] for r in rollups.rollup_sum(df, "at", unit).collect()}
    assert sums == {k: sum(n for n, _ in v) for k, v in groups.items()}


def test_rollup_order(visits):
    df, _ = visits
    times = [r["datetime"] for r in rollups.newest_first(rollups.rollup(df, "at", "day", [])).collect()]
    assert times[-1] is None and times[:-1] == sorted(times[:-1], reverse=True)


def test_all_rollups_equal_the_single_ones(visits):
    df, _ = visits
    long = {(r["rollup"], r["datetime"]): (r["cnt"], r["sum_value"]) for r in rollups.all_rollups(df).collect()}
    single = {
        (f"at__{u}", r["date"]): (r["cnt"], r["sum_value"])
        for u in ("hour", "day", "month", "year")
        for r in rollups.rollup_sum(df, "at", u).collect()
    }
    assert long == single
    measured = {(r["rollup"], r["datetime"]): (r["cnt"], r["sum__n"]) for r in rollups.all_measures(df).collect()}
    assert measured == single
    dates = df.selectExpr("cast(at as date) AS d", "n")
    assert rollups.units_of(dates, "d") == ("day", "month", "year")
    assert {r["rollup"] for r in rollups.all_rollups(dates).collect()} == {"d__day", "d__month", "d__year"}


def test_spans_and_granularity(spark, visits):
    df, _ = visits
    spans = {r["unit"]: r for r in rollups.rollup_spans(df).collect()}
    assert spans["day"]["row_count"] == 14 and spans["year"]["row_count"] == 2
    assert spans["hour"]["start_date"] == "2023-12-30 22:00:00"
    assert tuple(rollups.auto_granularity(df, "at").first()) == ("day", 14)
    assert tuple(rollups.auto_granularity_pair(df, "at").first()) == ("day", "hour")
    assert rollups.auto_rollup(df, "at").count() == 15  # the rows without a date are a bucket
    years = spark.range(30).selectExpr("make_date(1980 + int(id), 1, 1) AS d", "id")
    assert rollups.auto_granularity(years, "d").count() == 0
    assert rollups.auto_rollup(years, "d", "id").count() == 0
    summary = rollups.rollup_summary(df, "at", "month").first()
    assert tuple(summary) == (400, 2, "2023-12-01", "2024-01-01")


def test_labels(visits):
    df, _ = visits
    labels = {r["label"]: r["epoch_s"] for r in rollups.bucket_labels(df, "at", "month").collect()}
    assert labels == {"2023-12": 1701388800, "2024-01": 1704067200}
    assert {r["label"] for r in rollups.bucket_labels(df, "at", "year").collect()} == {"2023", "2024"}
    assert "2023-12-30 22-00-00" in {r["label"] for r in rollups.bucket_labels(df, "at", "hour").collect()}
    with pytest.raises(ValueError):
        rollups.bucket_labels(df, "at", "minute")


# --- profiles ----------------------------------------------------------------------------------------


def test_merge_keeps_the_first_present_value(spark, rows):
    a = spark.createDataFrame([("x", 0, None), ("y", None, 100)], "column_name string, cnt bigint, uniq bigint")
    b = spark.createDataFrame([("x", 50, 200), ("z", 7, None)], "column_name string, cnt bigint, uniq bigint")
    c = spark.createDataFrame([("x", True)], "column_name string, is_numeric boolean")
    assert rows(profile.merge_profiles(a, b, c)) == [
        ("x", 0, 200, True), ("y", None, 100, False), ("z", 7, None, False)
    ]


def test_profile(people):
    found = {r["column_name"]: r for r in profile.profile_table(people).collect()}
    assert set(found) == {"all", "color", "size", "v", "note"}
    assert found["all"]["cnt"] == 7 and found["v"]["is_numeric"] and not found["note"]["is_numeric"]
    assert found["v"]["median"] == 1.5 and found["v"]["quantile09"] == pytest.approx(3.5)
    report = [tuple(r)[:4] for r in profile.profile_report(profile.profile_table(people)).collect()]
    assert report[0] == ("all", "7", "0", "0") and [r[0] for r in report] == sorted(r[0] for r in report)
    assert report[-1] == ("v", "0", "5", "1.667")


def test_profile_of_an_empty_table(people):
    assert profile.profile_table(people.limit(0)).count() == 0
    assert profile.profile_table(people.select("color")).count() == 2


def test_full_profile_parts(visits, people):
    df, _ = visits
    assert set(profile.full_profile(df)) == {"columns", "rollups", "graphs"}
    parts = profile.full_profile(people)
    assert set(parts) == {"columns", "frequent", "rare", "frequent_combinations", "rare_combinations"}
    assert all(part.columns for part in parts.values())


def test_overview(people, rows):
    found = {r["column_name"]: r for r in overview.column_overview(people).collect()}
    assert set(found) == set(people.columns)
    assert found["v"]["type"] == "double" and found["v"]["non_null"] == 6 and found["v"]["median"] == 1.5
    assert found["color"]["uniq"] == 3 and found["color"]["mean"] is None
    samples = rows(overview.sample_values(people, ["color", "v"]))
    assert [s for c, s in samples if c == "color"] == ["blue", "green", "red"]
    assert tuple(overview.table_size(people).first()) == (7, 5)
    assert [r["name"] for r in overview.describe(people).collect()] == sorted(people.columns)


def test_drilldowns(visits, people):
    df, _ = visits
    assert set(drilldown.drilldown(df, "at", "week")) == {"counts", "summary", "sums"}
    assert set(drilldown.drilldown(df, "w")) == {"stats", "outliers", "deciles", "histogram", "density"}
    parts = drilldown.drilldown(people, "color")
    assert set(parts) == {"stats", "categories", "extremes", "lengths"}
    assert all(part.collect() is not None for part in parts.values())
