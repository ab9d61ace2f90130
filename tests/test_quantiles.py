"""Exact quantiles against numpy, with hot values, ties, NULL and NaN."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.operators import quantiles
from tabulens.operators.quantiles import summarize

POINTS = [0.0, 0.01, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.99, 1.0]


@pytest.fixture(scope="module")
def data():
    random.seed(7)
    rows = []
    for i in range(6000):
        hot = i % 3 == 0  # a third of all rows has one key, and half of those one value
        key = "hot" if hot else random.choice(["a", "b", "c", None])
        value = 5.0 if hot and i % 2 else random.gauss(0, 10) ** 3
        rows.append((key, None if i % 97 == 0 else value, i % 13))
    return rows


def reference(values):
    return np.quantile(np.array(values, dtype=float), POINTS)


def grouped(data, at):
    groups = {}
    for row in data:
        if row[at] is not None:
            groups.setdefault(row[0], []).append(row[at])
    return groups


@pytest.mark.parametrize("cell_rows", [10**6, 100, 7])
def test_without_keys(spark, data, cell_rows):
    df = spark.createDataFrame(data, "k string, v double, n int").repartition(5)
    found = {r["column_name"]: r for r in summarize(df, ["v", "n"], POINTS, cell_rows=cell_rows).collect()}
    for name, at in (("v", 1), ("n", 2)):
        values = [r[at] for r in data if r[at] is not None]
        assert found[name]["cnt"] == len(values)
        assert found[name]["min"] == min(values) and found[name]["max"] == max(values)
        assert found[name]["sum"] == pytest.approx(sum(values))
        assert found[name]["avg"] == pytest.approx(sum(values) / len(values))
        assert found[name]["q"] == pytest.approx(list(reference(values)))


@pytest.mark.parametrize("cell_rows", [10**6, 900, 50])
def test_with_keys(spark, data, cell_rows):
    df = spark.createDataFrame(data, "k string, v double, n int").repartition(5)
    found = summarize(df, ["v", "n"], POINTS, ["k"], cell_rows=cell_rows).collect()
    assert len(found) == 10
    for at, name in ((1, "v"), (2, "n")):
        groups = grouped(data, at)
        for row in (r for r in found if r["column_name"] == name):
            values = groups[row["k"]]
            assert row["cnt"] == len(values)
            assert row["q"] == pytest.approx(list(reference(values)))


def test_rows_of_a_task_are_bounded(spark, data):
    """A group of a third of all rows is spread over partitions and cells, and its hot value is one row."""
    df = spark.createDataFrame(data, "k string, v double, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = quantiles.placed_values(df.select("k", "v"), ["v"], ["k"], 100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    cells = placed.groupBy("_cell").count().collect()
    assert max(r["count"] for r in cells) <= 100 and len(cells) > 20
    hot = placed.where("k = 'hot'")
    assert hot.where("_v = 5.0").count() == 1
    assert hot.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("cell_rows", [10**6, 1])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_edges(spark, cell_rows, keys):
    one = spark.createDataFrame([("x", 3.5)], "k string, v double")
    assert summarize(one, ["v"], [0.1, 0.5], keys, cell_rows=cell_rows).first()["q"] == [3.5, 3.5]
    constant = spark.createDataFrame([("x", 2.0)] * 50, "k string, v double")
    assert summarize(constant, ["v"], [0.3, 0.9], keys, cell_rows=cell_rows).first()["q"] == [2.0, 2.0]
    missing = spark.createDataFrame([("x", None)] * 3, "k string, v double")
    row = summarize(missing, ["v"], [0.5], keys, cell_rows=cell_rows).first()
    assert row["cnt"] == 0 and row["q"] is None and row["min"] is None
    nan = spark.createDataFrame([("x", v) for v in (1.0, 2.0, math.nan)], "k string, v double")
    q = summarize(nan, ["v"], [0.5, 1.0], keys, cell_rows=cell_rows).first()["q"]
    assert q[0] == 2.0 and math.isnan(q[1])


def test_approximate_rank_error(spark):
    df = spark.range(0, 50_000).selectExpr("cast(id * 7919 % 50021 as double) v")
    values = sorted(r["v"] for r in df.collect())
    q = summarize(df, ["v"], POINTS, exact=False).first()["q"]
    for p, found in zip(POINTS, q):
        rank = np.searchsorted(values, found)
        assert abs(rank - p * (len(values) - 1)) <= len(values) / 1000


def test_same_for_any_partitioning(spark, data):
    df = spark.createDataFrame(data, "k string, v double, n int")
    results = [
        sorted(
            (str(r["k"]), r["column_name"], r["cnt"], tuple(r["q"]))
            for r in summarize(df.repartition(n), ["v", "n"], POINTS, ["k"], cell_rows=g).collect()
        )
        for n in (1, 8)
        for g in (10**6, 100)
    ]
    assert results[0] == results[1] == results[2] == results[3]


def test_no_column(spark):
    with pytest.raises(ValueError):
        summarize(spark.range(3), [], [0.5])
