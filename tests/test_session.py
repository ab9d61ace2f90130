"""Shared folder and shuffle sizing."""

from __future__ import annotations

import pytest

from tabulens import session
from tabulens.operators import overview
from tabulens.session import cut_lineage, fresh_path, shared_folder, size_shuffles


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    assert fresh_path(spark, "a").startswith(shared_folder(spark))


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    cut = cut_lineage(df)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, df.collect()))
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_shuffle_sizing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 1) == 200
        assert size_shuffles(spark, 10 * 1024**4) == 40960
        assert size_shuffles(spark, 100 * 1024**4) == 409_600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_describe_numbers(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "a int, b double")
    found = {r["column_name"]: tuple(r)[1:] for r in overview.describe_numbers(df).collect()}
    assert found["a"] == (3, 2.0, 1.0, 1.0, 1.5, 2.0, 2.5, 3.0)
    assert found["b"] == pytest.approx((2, 3.0, 2**0.5, 2.0, 2.5, 3.0, 3.5, 4.0))
