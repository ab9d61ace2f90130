"""Header decision, normalisation and delimiter choice on small hand-checked rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabulens.functions.headers import clean_symbols, is_likely_header, unique_names, with_positions
from tabulens.sources.archives import file_heads
from tabulens.sources.files import analyze_header, best_delimiter, one_dialect, survey_files
from tabulens.sources.quotes import record_end, split_record


def test_likely_header(spark):
    likely = ["gauge", "max wind (km/h)", "№ of stops", "Größe", "q4_2019_total", "ratio%"]
    not_likely = ["", "\t ", "0.75", "-12", "6e-3", "inf", "07.11.1998", "1998-11-07", "11/07/1998", "1998-11-07 23:59:01.25", "%%", "00x1234567"]
    df = spark.createDataFrame([(t,) for t in likely + not_likely], "t string")
    found = {r["t"]: r["h"] for r in df.select("t", is_likely_header(F.col("t")).alias("h")).collect()}
    assert [t for t in likely + not_likely if found[t]] == likely


@pytest.mark.parametrize(
    "fields, names, is_header",
    [
        (["Station", " depth in m ", "pH"], ["station", "depth_in_m", "ph"], True),
        (["17", "-3.5", "north"], ["column_1", "column_2", "column_3"], False),
        (["", "31.12.1999"], ["column_1", "column_2"], False),
        (["tide", "", "5"], ["column_1", "column_2", "column_3"], False),
        (["tide", "level", ""], ["tide", "level", "column_3"], True),
        (["flow", "Flow", "flow_1", "FLOW"], ["flow", "flow_1", "flow_1_1", "flow_2"], True),
        (["Щука", "œuvre", "İstanbul"], ["shchuka", "oeuvre", "istanbul"], True),
    ],
)
def test_header_rows(spark, fields, names, is_header):
    row = analyze_header(spark.createDataFrame([(fields,)], "f array<string>"), "f").first()
    assert row["has_header"] is is_header
    assert row["headers"] == names


def test_clean_symbols(spark):
    cases = {"wind -- gust": "wind_gust", "(m³/s)": "m_s", "..lead": "lead", "a/b\\c": "a_b_c", "§§": "", "çà et là": "ca_et_la"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", clean_symbols(F.col("t"))).collect()} == cases


def test_unique_names_and_positions(spark):
    df = spark.createDataFrame([(["a", "a", "a_1", "b", "a"],)], "n array<string>")
    row = df.select(unique_names(F.col("n")).alias("u"), with_positions(F.col("n")).alias("p")).first()
    assert row["u"] == ["a", "a_1", "a_1_1", "b", "a_2"]
    assert row["p"][:2] == ["0001_a", "0002_a"]


@pytest.mark.parametrize(
    "lines, delimiter",
    [
        (["depth;time", "4,5;10:00", "3,25;10:30"], ";"),
        (["lake\tarea", "Inari\t1,040", "Mälaren\t1,140"], "\t"),
        (["one column of words", "and one more line"], ","),
        (["x|y|z", "1,5|2|3", "4|5|6,0"], "|"),
        (["p;q,r", "5;6,7"], ","),
        (["u,v;w", "8;9"], ";"),
    ],
)
def test_delimiter(spark, lines, delimiter):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(best_delimiter(F.col("l"))).first()[0] == delimiter


def test_fields_of_a_quoted_record():
    head = '"a, b","say ""hi""",  c ,"two\nlines"\r\n1,2,3,4\n'
    record = head[: record_end(head, ",")].removesuffix("\r")
    assert split_record(record, ",") == ["a, b", 'say "hi"', "c ", "two\nlines"]


def test_survey_of_many_files(spark, tmp_path):
    files = {
        "marked": "\ufeffgauge,level,seen on\nWeir 3,1.25,2019-04-30\n",
        "bare": "Weir 3,1.25,2019-04-30,7\nMill,0.5,2019-05-01,8\nFord,2,2019-05-02,9",
        "single": "lake\nInari\nVättern\nBalaton\n",
        "semicolons": "From;To;Km\n" + "12;19;4\n" * 9,
        "tall": "p;q\n" + "8;9\n" * 150_000,
        "nothing": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    survey = survey_files(spark, str(tmp_path) + "/*.csv", prefix=False)
    found = {r["path"].rsplit("/", 1)[1].removesuffix(".csv"): r for r in survey.collect()}
    assert set(found) == set(files) - {"nothing"}  # nothing can be said about an empty file
    assert found["marked"]["headers"] == ["gauge", "level", "seen_on"] and found["marked"]["has_header"]
    assert not found["bare"]["has_header"] and found["bare"]["headers"] == [f"column_{i}" for i in range(1, 5)]
    assert (found["single"]["headers"], found["single"]["delimiter"]) == (["lake"], ",")
    assert (found["semicolons"]["headers"], found["semicolons"]["delimiter"]) == (["from", "to", "km"], ";")
    assert (found["tall"]["n_columns"], found["tall"]["delimiter"]) == (2, ";")
    with pytest.raises(ValueError):
        one_dialect(survey)


def test_only_empty_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        one_dialect(survey_files(spark, str(tmp_path / "empty.csv")))


def test_only_heads_are_read(spark, tmp_path):
    (tmp_path / "big.csv").write_text("x" * 99 + "\n" + "y" * 500_000)
    row = file_heads(spark, str(tmp_path / "big.csv"), 1000).first()
    assert len(row["head"]) == 1000 and row["is_cut"]
    (tmp_path / "one.csv").write_text("x" * 500_000)  # a first record is read whole
    row = file_heads(spark, str(tmp_path / "one.csv"), 1000).first()
    assert len(row["head"]) == 500_000 and not row["is_cut"]
