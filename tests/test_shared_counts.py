"""Results built from tables of counted values: rollups of all units, histograms that follow the data."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tabulens import session
from tabulens.operators import distribution, frequency, rollups
from tabulens.operators.quantiles import equi_depth
from tabulens.plans import profile


@pytest.fixture(scope="module")
def moments(spark):
    random.seed(3)
    start = datetime.datetime(2023, 12, 20, 5)
    rows = []
    for i in range(900):
        at = None if i % 50 == 0 else start + datetime.timedelta(minutes=random.randrange(60 * 24 * 40))
        day = None if i % 70 == 0 else (start + datetime.timedelta(days=i % 25)).date()
        rows.append((at, day, None if i % 11 == 0 else i % 7, 2.5 if i % 3 else random.gauss(0, 5)))
    return spark.createDataFrame(rows, "at timestamp_ntz, day date, n int, x double").repartition(4).cache()


def values_of(df):
    names = sorted(df.columns)
    found = []
    for r in df.select(*names).collect():
        found.append(tuple(round(v, 8) if isinstance(v, float) else v for v in r))
    return sorted(found, key=str)


@pytest.mark.parametrize("units", [("hour", "day", "month", "year"), ("week", "month"), ("year",)])
def test_all_units_equal_single_rollups(moments, units):
    long = rollups.all_measures(moments, units=units)
    for date in ("at", "day"):
        for unit in units:
            mine = long.filter(F.col("rollup") == f"{date}__{unit}").drop("rollup")
            assert values_of(mine) == values_of(rollups.rollup(moments, date, unit))


@pytest.mark.parametrize("options", [{"exact": False}, {"measures": ("min", "sum")}, {"measures": ()}, {"columns": []}])
def test_rollups_without_counted_values(moments, options):
    long = rollups.all_measures(moments, ["at"], ("day",), **options).drop("rollup")
    assert values_of(long) == values_of(rollups.rollup(moments, "at", "day", **options))


def test_rollups_read_their_table_once(spark, moments):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def noted(n):
        seen.add(1)
        return n

    plain = spark.createDataFrame(moments.collect(), moments.schema).withColumn("n", noted("n"))
    rollups.all_measures(plain).collect()
    assert seen.value == 900


def test_rollups_of_an_empty_table(moments):
    assert rollups.all_measures(moments.limit(0)).collect() == []
    assert rollups.all_measures(moments.limit(0), exact=False).collect() == []


def test_weeks_do_not_nest_in_months(moments):
    spans = {r["unit"]: r["row_count"] for r in rollups.rollup_spans(moments, ["at"], ("week", "month")).collect()}
    single = {u: rollups.rollup_count(moments, "at", u).count() for u in ("week", "month")}
    assert spans == single


def brute_bins(values, bins, runs):
    values = sorted(values)
    found = {}
    for v in sorted(set(values)):
        run = found.setdefault(values.index(v) * runs // len(values), [v, v, 0])
        run[1] = v
        run[2] += values.count(v)
    merged = [(lo, hi, (lo + hi) / 2, float(n)) for lo, hi, n in found.values()]
    while len(merged) > bins:
        i = min(range(len(merged) - 1), key=lambda k: (merged[k + 1][2] - merged[k][2], k))
        (lo, _, x, y), (_, hi, z, w) = merged[i : i + 2]
        merged[i : i + 2] = [(lo, hi, (x * y + z * w) / (y + w), y + w)]
    ends = [m[0] for m in merged[1:]] + [merged[-1][1]]
    return [(m[0], e, m[3]) for m, e in zip(merged, ends, strict=True)]


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("bins", [1, 6, 40])
def test_adaptive_histogram_by_brute_force(spark, partitions, bins):
    random.seed(11)
    values = [3.0 if i % 3 == 0 else round(random.gauss(0, 4) ** 3, 2) for i in range(500)]
    rows = [(v,) for v in [*values, None, math.nan]]
    df = spark.createDataFrame(rows, "`odd name` double").repartition(partitions)
    got = [tuple(r)[:3] for r in distribution.adaptive_histogram(df, "odd name", bins, fineness=4).collect()]
    assert got == brute_bins(values, bins, bins * 4)
    ranged = distribution.adaptive_histogram(df, "odd name", bins, -10, 10, by_height=True, fineness=4).collect()
    inside = brute_bins([v for v in values if -10 <= v <= 10], bins, bins * 4)
    assert [tuple(r)[:3] for r in ranged] == sorted(inside, key=lambda b: (-b[2], b[0]))


def test_adaptive_histogram_of_few_values(spark):
    few = spark.createDataFrame([(1,), (1,), (4,)], "n int")
    assert [tuple(r) for r in distribution.adaptive_histogram(few, "n").collect()] == [(1.0, 4.0, 2.0, 2.5), (4.0, 4.0, 1.0, 4.0)]
    dense = distribution.density(distribution.adaptive_histogram(few, "n")).collect()
    assert [r["density"] for r in dense] == pytest.approx([2 / 9, None])
    assert distribution.adaptive_histogram(few.limit(0), "n").collect() == []
    assert distribution.adaptive_histogram(few.selectExpr("nullif(n, n) AS n"), "n").collect() == []


def test_equal_runs_across_cells(spark):
    df = spark.range(10_000).selectExpr("double(id % 2500) AS v")
    runs = equi_depth(df, "v", 8, cell_rows=90).orderBy("bin").collect()
    assert [r["height"] for r in runs] == [1252, 1248, 1252, 1248, 1252, 1248, 1252, 1248]
    assert runs[0]["lo"] == 0 and runs[-1]["hi"] == 2499


def section(parts, name):
    return values_of(parts[name])


def test_full_profile_equals_its_single_parts(moments):
    long = F.concat(F.lit("t" * 90), F.col("n").cast("string"))
    df = moments.withColumn("odd + name", long).withColumn("flag", F.col("n") > 3).withColumn("few", F.col("x").cast("int").cast("string"))
    parts = profile.full_profile(df)
    grouped = ["odd + name", "few"]
    assert section(parts, "columns") == values_of(profile.profile_table(df))
    for name, options in (("frequent", {}), ("rare", {"rare": True, "min_count": 2})):
        assert section(parts, name) == values_of(frequency.top_values(df, grouped, **options))
        combos = frequency.top_combos(df, grouped, **options)
        assert section(parts, f"{name}_combinations") == values_of(combos)
    assert section(parts, "rollups") == values_of(rollups.all_measures(df))
    rows = profile.profile_rows(parts)
    assert rows.columns == ["section", "name", "item", "measure", "value"]
    found = {tuple(r)[:4]: r["value"] for r in rows.collect()}
    assert found["columns", "all", None, "cnt"] == 900 and found["columns", "odd + name", None, "uniq"] == 7
    assert found["columns", "flag", None, "is_numeric"] == 0 and ("columns", "flag", None, "avg") not in found
    assert any(k[0] == "frequent_combinations" and k[2].startswith("\\N|") for k in found)


def test_full_profile_of_edge_tables(spark, moments):
    empty = profile.full_profile(moments.limit(0))
    assert profile.profile_rows(empty).collect() == []
    dates = profile.full_profile(moments.select("day"))
    assert {r["section"] for r in profile.profile_rows(dates).collect()} == {"columns", "rollups", "graphs"}
    nulls = profile.full_profile(spark.createDataFrame([(None, None), (None, None)], "s string, n double"))
    assert [tuple(r) for r in profile.profile_rows(nulls).filter("measure = 'cnt'").collect()] == [("columns", "all", None, "cnt", 2.0)]
    zeros = profile.full_profile(spark.createDataFrame([(0.0,), (-0.0,), (math.nan,)], "z double"))
    assert zeros["columns"].filter("column_name = 'z'").first()["uniq"] == 2
    mixed = profile.full_profile(spark.createDataFrame([(2**53,), (2**53 + 1,)], "big long"))
    assert mixed["columns"].filter("column_name = 'big'").first()["uniq"] == 2


def largest_task(spark, table, monkeypatch, rows):
    """The rollups with tasks of so many rows, and the most ranked rows that one task wrote."""
    monkeypatch.setattr(session, "TASK_ROWS", rows)
    kept, before = [], session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda s, name: kept.append(before(s, name)) or kept[-1])
    found = rollups.all_measures(table)
    ranked = [t for t in map(spark.read.parquet, kept) if {"_cell", "_v"} <= set(t.columns)]
    return found, max(r["count"] for t in ranked for r in t.groupBy(F.input_file_name()).count().collect())


def test_tasks_do_not_grow_with_the_table(spark, moments, monkeypatch):
    once, most = largest_task(spark, moments, monkeypatch, 500)
    thrice = moments
    for i in (1, 2):
        thrice = thrice.unionByName(moments.withColumn("x", F.col("x") + i * 0.001))
    many, most_of_many = largest_task(spark, thrice.coalesce(1), monkeypatch, 500)
    assert most <= 4 * 500 and most_of_many <= 4 * 500
    monkeypatch.undo()
    assert values_of(once) == values_of(rollups.all_measures(moments))
    assert values_of(many) == values_of(rollups.all_measures(thrice))


def test_full_profile_with_small_tasks(moments, monkeypatch):
    whole = {k: values_of(v) for k, v in profile.full_profile(moments).items()}
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    assert {k: values_of(v) for k, v in profile.full_profile(moments).items()} == whole
