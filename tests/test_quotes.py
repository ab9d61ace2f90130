"""Quotes in delimited files: lenient fields, records over several ranges, bounded heads."""

from __future__ import annotations

import csv
import io
import random
import time

import pytest

from tabulens.sources.archives import file_heads
from tabulens.sources.delimited import CORRUPT, read_auto
from tabulens.sources.files import survey_files
from tabulens.sources.quotes import is_open_after, record_end, split_record


@pytest.mark.parametrize(
    "record, fields",
    [
        ('id,na"me,x', ["id", 'na"me', "x"]),
        ('"a ""b"" c" , d', ['a "b" c', "d"]),
        ('5" pipe,"6"" pipe",7"', ['5" pipe', '6" pipe', '7"']),
        ('"one "odd" quote",b', ['one "odd" quote', "b"]),
        ('"never closed,b', ['"never closed', "b"]),
        (',"",', ["", "", ""]),
    ],
)
def test_fields(record, fields):
    assert split_record(record, ",") == fields


def test_where_records_end():
    assert record_end('a,"b\nc",d\ne', ",") == 9
    assert record_end('a"b\nc"d\n', ",") == 3
    assert record_end('"a\nb', ",") == -1
    assert not is_open_after('x;"y;z"', False, ";") and is_open_after('x;"y', False, ";")
    assert is_open_after("words", True, ",") and not is_open_after('end",2', True, ",")


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "700")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("seed", range(3))
def test_line_breaks_in_quotes_over_many_ranges(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    words = ["plain", "with, comma", "two\nlines", 'a "quoted" word', "long " * 120 + "\n" + "text " * 200, "é\n\nü", " spaced", '"']
    rows = {f: [[str(i), f, rng.choice(words), rng.choice(words)] for i in range(60)] for f in ("a", "b")}
    for name, own in rows.items():
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["number", "file", "first", "second"], *own])
        (tmp_path / f"{name}.csv").write_text(out.getvalue())
    df = read_auto(spark, str(tmp_path) + "/*.csv")
    found = sorted(tuple(r) for r in df.drop(CORRUPT).collect())
    wanted = sorted((a, b, c.lstrip(" ") if '"' not in c and "," not in c and "\n" not in c else c, d.lstrip(" ") if d == " spaced" else d) for own in rows.values() for a, b, c, d in own)
    assert found == wanted
    assert df.where(f"{CORRUPT} IS NOT NULL").isEmpty()


def test_two_records_with_one_break_are_two_rows(spark, tmp_path):
    (tmp_path / "two.csv").write_text('name,note\nann,"first\nsecond"\nbob,third\n')
    assert sorted(tuple(r)[:2] for r in read_auto(spark, str(tmp_path)).collect()) == [("ann", "first\nsecond"), ("bob", "third")]


def test_a_stray_quote_in_the_header(spark, tmp_path):
    (tmp_path / "stray.csv").write_text('id,na"me,x\n' + "1,b,c\n" * 200_000)
    started = time.time()
    df = read_auto(spark, str(tmp_path))
    assert df.columns[:3] == ["id", "na_me", "x"] and len(df.columns) == 4
    assert df.count() == 200_000 and time.time() - started < 30


def test_an_open_quote_does_not_read_the_file(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,"name,x\n' + "1,b,c\n" * 8_000_000)
    started = time.time()
    row = file_heads(spark, str(tmp_path / "open.csv"), 1000, [",", ";"]).first()
    assert row["fields"][0] == ["id", '"name', "x"] and row["is_cut"] and len(row["head"]) == 1000
    assert time.time() - started < 30


def test_many_equal_names(spark, tmp_path):
    (tmp_path / "equal.csv").write_text(",".join(["same"] * 20_000) + "\n" + ",".join("1" * 20_000) + "\n")
    started = time.time()
    names = survey_files(spark, str(tmp_path / "equal.csv"), prefix=False).first()["headers"]
    assert names[:3] == ["same", "same_1", "same_2"] and len(set(names)) == 20_000
    assert time.time() - started < 30
