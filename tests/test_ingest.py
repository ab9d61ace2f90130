"""Scan, type inference, typed load, archives and exports on small files."""

from __future__ import annotations

import datetime
import gzip
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulens.functions.datetimes import canonical_moment, moment_kind, parse_moment
from tabulens.plans.registry import all_queries
from tabulens.sinks.export import export_rollups, read_rollups
from tabulens.sinks.load import load, with_sequential_id
from tabulens.sources.catalog import list_tables
from tabulens.sources.delimited import apply_types, cast_failures, infer_types, read_auto, read_delimited


def types_of(df, **options):
    return {r["column_name"]: (r["type"], r["nullable"]) for r in infer_types(df, **options).collect()}


def test_types_of_the_small_files(spark, tmp_path):
    files = {
        "gauges": ("gauge;level;checked\nWeir 3;1.25;30.04.2019\nMill;2;01.05.2019\n", "string double date"),
        "counts": ("7,-12\n8,400000000000\n", "bigint bigint"),
        "moments": ("seen at|who\n2019-04-30 06:15:00|ann\n2019-05-01|bob\n", "timestamp_ntz string"),
        "words": ("lake\nInari\n\nBalaton\n", "string"),
    }
    for name, (text, expected) in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
        df = read_auto(spark, str(tmp_path / f"{name}.csv"))
        assert " ".join(t for t, _ in types_of(df).values()) == expected, name
    assert read_auto(spark, str(tmp_path / "counts.csv")).count() == 2


@pytest.mark.parametrize(
    "cells, kind, nullable",
    [
        (["1", "2"], "bigint", False),
        (["1", "2.5", "-3e4"], "double", False),
        (["18446744073709551615", "1"], "double", False),
        (["NaN", "inf", "1"], "double", False),
        (["1d", "2"], "string", False),
        (["1", "", None], "bigint", True),
        (["1", "\\N"], "bigint", True),
        (["", "\\N"], "string", True),
        (["2024-01-01", "31/12/2023", "01.02.2024"], "date", False),
        (["2024-01-01", "2024-01-01 10:00:00"], "timestamp_ntz", False),
        (["2024-01-01T10:00:00Z"], "timestamp_ntz", False),
        (["2024-01-01T10:00:00"], "string", False),
        (["2024-01-01", "5"], "string", False),
        (["2024-02-30"], "string", False),
        (["12/31/2023"], "string", False),
        (["﻿7"], "bigint", False),
    ],
)
def test_inference(spark, cells, kind, nullable):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert types_of(df) == {"c": (kind, nullable)}


def test_sampled_inference_is_spread_over_the_rows(spark):
    df = spark.createDataFrame([("1",)] * 1000 + [("x",)] * 1000, "`a.c` string").coalesce(1)
    assert types_of(df)["a.c"][0] == "string"
    assert types_of(df, sample_rows=30)["a.c"][0] == "string"  # the first rows alone are numbers
    assert types_of(df.limit(1000), sample_rows=30)["a.c"] == ("bigint", False)


def test_moments(spark):
    cases = {
        "2024-03-05": ("Date", "2024-03-05"),
        "05-03-2024": ("Date", "2024-03-05"),
        "05/03/2024": ("Date", "2024-03-05"),
        "05.03.2024": ("Date", "2024-03-05"),
        "2024.03.05": ("Date", "2024-03-05"),
        " 2024/03/05\t": ("Date", "2024-03-05"),
        "2022-10-26 06:03:18.272132": ("DateTime64", "2022-10-26 06:03:18.272132"),
        "2022-10-26 06:03:18": ("DateTime64", "2022-10-26 06:03:18"),
        "2022-10-26T06:03:18.5Z": ("DateTime64", "2022-10-26 06:03:18.5"),
        "2022/10/26 06:03:18": ("DateTime", "2022-10-26 06:03:18"),
        "26-10-2022 6:03:18": ("DateTime", "2022-10-26 06:03:18"),
        "26/10/2022 06:03:18": ("DateTime", "2022-10-26 06:03:18"),
        "26.10.2022 06:03:18": ("DateTime", "2022-10-26 06:03:18"),
        "2022.10.26 06:03:18": ("DateTime", "2022-10-26 06:03:18"),
        "2022-10/26": (None, None),
        "2022-13-01": (None, None),
        "2022-10-26 25:00:00": (None, None),
        "10/26/2022": (None, None),
        "2022-10-26T06:03:18": (None, None),
        "": (None, None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    text = F.col("t")
    found = df.select("t", moment_kind(text).alias("k"), canonical_moment(text).alias("c"), parse_moment(text).alias("m"))
    for row in found.collect():
        assert (row["k"], row["c"]) == cases[row["t"]], row["t"]
        assert (row["m"] is None) == (row["k"] is None)


def test_whole_seconds_keep_six_digits(spark, tmp_path):
    cases = {1: "2024-01-13 03:56:54.000000", 2: "2024-01-13 03:56:54.500000", 3: "2024-01-13 00:00:00.000000", 4: "2024-01-13 03:56:54.000001", 5: None}
    events = spark.createDataFrame(list(cases.items()), "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = all_queries()["parse_moments"](spark, str(tmp_path)).collect()
    assert {r["event_id"]: r["canonical"] for r in found} == cases


def test_ragged_rows_are_kept_and_flagged(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text('a,b\n1,2\n3\n4,5,6\n"x ""y""",7\n')
    df = read_auto(spark, str(path))
    found = {r["a"]: (r["b"], r["_corrupt"] is not None) for r in df.collect()}
    assert found == {"1": ("2", False), "3": (None, True), "4": ("5", True), 'x "y"': ("7", False)}
    assert types_of(df)["b"] == ("bigint", False)


def test_typed_load_with_ids(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("n,when,text\n" + "".join(f"{i},2024-01-{i % 28 + 1:02d},t{i}\n" for i in range(500)) + "x,2024-01-01,\\N\n")
    text = read_auto(spark, str(path), prefix=True).repartition(7)
    kinds = {"0001_n": "bigint", "0002_when": "date", "0003_text": "string"}
    assert [r["failures"] for r in cast_failures(text, kinds).orderBy("column_name").collect()] == [1, 0, 0]
    loaded = load(text, types=kinds)
    assert [f.dataType.simpleString() for f in loaded.schema] == ["bigint", "bigint", "date", "string"]
    result = loaded.collect()
    assert sorted(r["id"] for r in result) == list(range(1, 502))
    assert sum(r["0001_n"] is None for r in result) == 1 and sum(r["0003_text"] is None for r in result) == 1
    assert {r["0002_when"] for r in result if r["0001_n"] == 3} == {datetime.date(2024, 1, 4)}


def test_load_to_a_table(spark):
    df = spark.createDataFrame([("1", "abcdef"), ("2", "xy")], "n string, t string").coalesce(1)
    load(df, table="loaded_rows", max_length=4)
    load(df, table="loaded_rows", max_length=4)  # drops and creates again
    assert sorted(map(tuple, spark.table("loaded_rows").collect())) == [(1, 1, "abcd"), (2, 2, "xy")]
    assert "loaded_rows" in [r[0] for r in list_tables(spark).collect()]


def test_ids_follow_row_order(spark):
    df = spark.range(0, 1000, 1, 6).selectExpr("id AS v")
    assert all(r["id"] == r["v"] + 1 for r in with_sequential_id(df).collect())


def test_ids_follow_a_key_across_files_of_several_sizes(spark, tmp_path):
    first = 0
    for i, size in enumerate((5, 400, 60, 900, 30)):  # the reader takes the largest file first
        (tmp_path / f"{i}.csv").write_text("n,text\n" + "".join(f"{n},t{n}\n" for n in range(first, first + size)))
        first += size
    loaded = load(read_auto(spark, str(tmp_path)), order=["n"]).collect()
    assert sorted(r["id"] for r in loaded) == list(range(1, first + 1))
    assert all(r["id"] == r["n"] + 1 and r["text"] == f"t{r['n']}" for r in loaded)


def test_csv_load_numbers_rows_by_key(spark, tmp_path):
    part = spark.range(3_000).selectExpr("2999 - id AS p_partkey", "'a b' AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "1 AS p_size", "9.5D AS p_retailprice")
    part.repartition(5).write.parquet(str(tmp_path / "part.parquet"))
    loaded = all_queries()["csv_load"](spark, str(tmp_path)).collect()
    assert len(loaded) == 3_000 and all(r["id"] == r["0001_p_partkey"] + 1 for r in loaded)


def test_own_id_is_kept(spark):
    df = spark.createDataFrame([("7", "a"), ("9", "b")], "id string, t string")
    assert sorted(r["id"] for r in load(df).collect()) == [7, 9]


CONTENT = 'name,note,n\nAnn,"two\nlines, and ""quotes""",1\nBob,,2\nCy, lead,3\n'
EXPECTED = [("Ann", 'two\nlines, and "quotes"', "1"), ("Bob", None, "2"), ("Cy", "lead", "3")]


def pack(folder, kind):
    path = str(folder / f"data.csv.{kind}" if kind else folder / "data.csv")
    if kind == "zip":
        with zipfile.ZipFile(path, "w") as archive:
            archive.writestr("small.txt", "x")
            archive.writestr("folder/", "")
            archive.writestr("folder/data.csv", CONTENT)
    elif kind == "gz":
        with gzip.open(path, "wt", encoding="utf-8", newline="") as sink:
            sink.write(CONTENT)
    elif kind == "lz4":
        with pa.CompressedOutputStream(path, "lz4") as sink:
            sink.write(("﻿" + CONTENT).encode())
    else:
        with open(path, "w", encoding="utf-8", newline="") as sink:
            sink.write(CONTENT)
    return path


@pytest.mark.parametrize("kind", ["", "gz", "zip", "lz4"])
def test_packed_files_hold_the_same_rows(spark, tmp_path, rows, kind):
    df = read_auto(spark, pack(tmp_path, kind), multi_line=True)
    assert rows(df, "name", "note", "n") == EXPECTED
    assert [r["_corrupt"] for r in df.collect()] == [None] * 3


def test_two_archives_and_a_ragged_record(spark, tmp_path, rows):
    for i in (1, 2):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as archive:
            archive.writestr("a.csv", f"a;b\n{i};x\n{i}\n")
    df = read_delimited(spark, str(tmp_path) + "/*.zip", ["a", "b"], ";", packed=True)
    assert rows(df, "a", "b", F.col("_corrupt").isNotNull()) == [
        ("1", "x", False), ("1", None, True), ("2", "x", False), ("2", None, True)
    ]


def test_spread_archive(spark, tmp_path, rows):
    df = read_delimited(spark, pack(tmp_path, "zip"), ["name", "note", "n"], packed=True, partitions=3)
    assert rows(df, "name", "note", "n") == EXPECTED and df.rdd.getNumPartitions() == 3


def test_task_functions_travel_with_their_code():
    from pyspark import cloudpickle

    from tabulens.sources import archives

    assert b"zipfile" in cloudpickle.dumps(archives.open_member)


def test_typing_needs_no_collect_of_rows(spark):
    df = spark.createDataFrame([("1", "2.5")], "a string, b string")
    assert apply_types(df, infer_types(df)).dtypes == [("a", "bigint"), ("b", "double")]


def test_export_is_partitioned_and_ordered(spark, tmp_path):
    long = spark.createDataFrame(
        [("d__day", f"2024-01-{i:02d} 00:00:00", i) for i in range(28, 0, -1)] + [("d__year", "2024-01-01", 9)],
        "rollup string, datetime string, cnt bigint",
    )
    path = str(tmp_path / "out")
    export_rollups(long, path, "gzip")
    assert sorted(p for p in os.listdir(path) if p.startswith("rollup=")) == ["rollup=d__day", "rollup=d__year"]
    for folder, _, names in os.walk(path):
        for name in (n for n in names if n.endswith(".csv.gz")):
            with gzip.open(os.path.join(folder, name), "rt") as source:
                lines = source.read().splitlines()
            assert lines[0] == "cnt,datetime"
            times = [line.split(",")[1] for line in lines[1:]]
            assert times == sorted(times)
    back = read_rollups(spark, path, "cnt bigint, datetime string")
    assert sorted(map(tuple, back.select("rollup", "datetime", "cnt").collect())) == sorted(map(tuple, long.collect()))
