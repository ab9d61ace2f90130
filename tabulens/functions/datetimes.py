"""Date expressions: multi-format parsing, truncation, bucket text and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-first or year-first dates with one separator throughout, an optional
# time of day with an optional fraction, and the T...Z form for dashed year-first dates.
_CLOCK = r"\d{1,2}:\d{2}:\d{2}([.,]\d{1,9})?"
_YEAR_FIRST = r"(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2})"
_DAY_FIRST = r"(\d{2}-\d{2}-\d{4}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})"
DATE_PATTERN = rf"^({_YEAR_FIRST}|{_DAY_FIRST})$"
MOMENT_PATTERN = rf"^(({_YEAR_FIRST}|{_DAY_FIRST}) {_CLOCK}|\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}Z)$"

# Truncation units, fine to coarse, with the text form of a bucket and its label.
UNITS = ("hour", "day", "month", "year")
BUCKET_FORMATS = {
    "hour": "yyyy-MM-dd HH:mm:ss",
    "day": "yyyy-MM-dd HH:mm:ss",
    "week": "yyyy-MM-dd",
    "month": "yyyy-MM-dd",
    "year": "yyyy-MM-dd",
}
LABEL_FORMATS = {
    "hour": "yyyy-MM-dd HH-mm-ss",
    "day": "yyyy-MM-dd",
    "week": "yyyy-MM-dd",
    "month": "yyyy-MM",
    "year": "yyyy",
}


def _stripped(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n"))


def check_unit(unit: str) -> str:
    if unit not in BUCKET_FORMATS:
        raise ValueError(f"unit must be one of {', '.join(BUCKET_FORMATS)}, not {unit!r}")
    return unit


def is_date_text(text: Column) -> Column:
    return _stripped(text).rlike(DATE_PATTERN)


def is_moment_text(text: Column) -> Column:
    return _stripped(text).rlike(MOMENT_PATTERN)


def parse_moment(text: Column) -> Column:
    """Text in any accepted layout to a zone-less timestamp, NULL for anything else.

    The layouts differ only in the order of fields of fixed width, so the ISO text is put
    together from substrings and a single cast parses it.
    """
    cell = _stripped(text)
    valid = cell.rlike(f"{DATE_PATTERN}|{MOMENT_PATTERN}")
    day_first = F.substring(cell, 3, 1).isin("-", "/", ".")
    fields = F.when(day_first, _joined(cell, (7, 4), (4, 2), (1, 2))).otherwise(
        _joined(cell, (1, 4), (6, 2), (9, 2))
    )
    clock = F.rtrim(F.replace(F.substring(cell, 11, 20), F.lit(","), F.lit(".")), F.lit("Z"))
    return F.when(valid, F.concat(fields, clock).try_cast("timestamp_ntz"))


def _joined(cell: Column, *places: tuple[int, int]) -> Column:
    return F.concat_ws("-", *[F.substring(cell, start, length) for start, length in places])


def moment_kind(text: Column) -> Column:
    """``Date``, ``DateTime`` or ``DateTime64`` (dashed year-first layouts carry fractions)."""
    cell = _stripped(text)
    kind = (
        F.when(cell.rlike(DATE_PATTERN), "Date")
        .when(cell.rlike(r"^\d{4}-"), "DateTime64")
        .otherwise("DateTime")
    )
    return F.when(parse_moment(text).isNotNull(), kind)


def canonical_moment(text: Column, full: bool = False) -> Column:
    """ISO text of the parsed moment: date only, to the second, or with its fraction (``full``: of six digits, zeros too)."""
    moment, kind = parse_moment(text), moment_kind(text)
    precise = moment.cast("string")
    if full:  # the cast leaves out the zeros at the end, and with them the point
        precise = F.rpad(F.regexp_replace(precise, "^.{19}$", "$0."), 26, "0")
    return (
        F.when(kind == "Date", moment.cast("date").cast("string"))
        .when(kind == "DateTime64", precise)
        .otherwise(F.substring(moment.cast("string"), 1, 19))
    )


def bucket_text(bucket: Column, unit: str) -> Column:
    """Text of a truncated moment as the rollups print it."""
    return F.date_format(bucket, BUCKET_FORMATS[check_unit(unit)])


def bucket_label(bucket: Column, unit: str) -> Column:
    """Axis label of a truncated moment."""
    return F.date_format(bucket, LABEL_FORMATS[check_unit(unit)])
