"""Widths and sizes beyond what the small tables reach."""

from __future__ import annotations

import datetime

from tabulens.operators import frequency, numeric, rollups
from tabulens.plans import profile
from tabulens.sinks.load import load
from tabulens.sources.delimited import read_auto
from tabulens.sources.files import survey_files


def test_header_of_any_length(spark, tmp_path):
    names = [f"measure of column {i}" for i in range(9_000)] + ['"a, quoted\nname"', "measure of column 7"]
    for kind, used in (("plain", names[:9_000]), ("quoted", names[8_990:])):
        (tmp_path / f"{kind}.csv").write_text(",".join(used) + "\n" + ",".join("1" for _ in used) + "\n")
        found = survey_files(spark, str(tmp_path / f"{kind}.csv"), prefix=False).first()
        assert found["n_columns"] == len(used) and found["has_header"]
        assert len(set(found["headers"])) == len(used)
    assert "measure_of_column_7" in found["headers"]


def test_sums_do_not_overflow(spark):
    big = 2**62
    rows = [(datetime.date(2024, 1, day), big, "k") for day in (1, 2, 3, 4)]
    table = spark.createDataFrame(rows, "day date, amount long, kind string")
    assert [r["sum_value"] for r in rollups.rollup_sum(table, "day", "month").collect()] == [float(4 * big)]
    assert {r["sum_value"] for r in rollups.all_rollups(table).where("rollup = 'day__year'").collect()} == {float(4 * big)}
    assert numeric.group_summary(table, ["kind"], ["amount"]).first()["total_amount"] == float(4 * big)


def test_tables_without_countable_columns(spark):
    table = spark.createDataFrame([(datetime.date(2024, 1, 1),), (None,)], "day date")
    assert [r["column_name"] for r in profile.profile_table(table).collect()]
    assert frequency.extreme_values(table).collect() == []


def test_ragged_rows_do_not_decide_types(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text("item,amount\n" + "".join(f"thing {i},{i}\n" for i in range(20)) + "4,lost,9\n")
    loaded = load(read_auto(spark, str(tmp_path / "ragged.csv")))
    assert dict(loaded.dtypes) == {"id": "bigint", "item": "string", "amount": "bigint"}
    assert loaded.count() == 21 and loaded.where("amount IS NULL").count() == 1
