"""Sketches that are merged give what one sketch over all rows gives, within their bounds."""

from __future__ import annotations

import pytest

from tabulens.operators import sketches


def test_merged_sketches(spark):
    df = spark.range(0, 30_000).selectExpr("cast(id * 7919 % 30011 as double) v", "cast(id % 700 as string) s", "id % 7 k", "cast(null as int) n")
    days = sketches.sketch(df, by=["k"])
    assert days.count() == 21 and set(days.columns) == {"k", "column_name", "cnt", "distinct", "quantiles"}
    found = {r["column_name"]: r for r in sketches.estimates(sketches.merged(days), [0.1, 0.5, 0.9]).collect()}
    values = sorted(r["v"] for r in df.collect())
    for p, q in zip((0.1, 0.5, 0.9), found["v"]["q"], strict=True):
        below, upto = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
        assert below <= p + 3 * sketches.RANK_ERROR and upto >= p - 3 * sketches.RANK_ERROR
    assert found["v"]["cnt"] == 30_000 and found["v"]["uniq_low"] <= 30_000 <= found["v"]["uniq_high"]
    assert found["s"]["uniq_low"] <= 700 <= found["s"]["uniq_high"] and found["s"]["q"] is None
    assert found["n"]["cnt"] == 0 and found["n"]["uniq"] == 0 and found["n"]["q"] is None
    by_key = sketches.estimates(sketches.merged(days, ["k"]), [0.5])
    assert by_key.count() == 21 and set(by_key.columns) >= {"k", "column_name", "uniq", "q"}


def test_nothing_to_sketch(spark):
    empty = spark.createDataFrame([], "v double")
    row = sketches.estimates(sketches.merged(sketches.sketch(empty)), [0.5]).first()
    assert row["cnt"] == 0 and row["uniq"] == 0 and row["q"] is None
    with pytest.raises(ValueError):
        sketches.sketch(spark.createDataFrame([], "d date"))
