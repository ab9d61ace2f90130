"""What kind of delimited files are these? Delimiter, header row and column names per file.

Only the head and the first record of each file are read, however large the files are; the
decisions are column expressions over the heads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.columns import computed
from tabulens.functions.headers import (
    HEADER_SHARE,
    clean_header,
    is_likely_header,
    position_name,
    unique_names,
    with_positions,
)
from tabulens.sources.archives import file_heads

# Candidate delimiters in order of preference, the default, and how much of a
# file the decision rests on.
DELIMITERS = (",", ";", "\t", "|")
DEFAULT_DELIMITER = ","
SAMPLE_CHARACTERS = 1000
SAMPLE_LINES = 5

# Bytes read per file, and the rest of the first record if that is longer.
HEAD_BYTES = 1 << 16


def _sample_lines(head: Column, is_cut: Column) -> Column:
    """The complete lines among the first five; a cut or empty last line does not count."""
    sample = F.substring(head, 1, SAMPLE_CHARACTERS)
    lines = F.split(F.regexp_replace(sample, "\r\n", "\n"), "\n")
    last_is_partial = (F.length(head) > SAMPLE_CHARACTERS) | is_cut | (F.element_at(lines, -1) == "")
    whole = F.when(last_is_partial & (F.size(lines) > 1), F.slice(lines, F.lit(1), F.size(lines) - 1))
    return F.slice(F.coalesce(whole, lines), 1, SAMPLE_LINES)


def _counts_in(lines: Column, delimiter: str) -> Column:
    """How often the delimiter occurs in each line."""
    return F.transform(lines, lambda line: F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit(""))))


def best_delimiter(lines: Column) -> Column:
    """The delimiter with the highest count that is the same in all lines; the default if none."""
    choices = []
    for order, delimiter in enumerate(DELIMITERS):
        counts = _counts_in(lines, delimiter)
        score = F.when(F.array_min(counts) == F.array_max(counts), F.array_max(counts)).otherwise(0)
        choices.append(F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(delimiter).alias("d")))
    best = F.greatest(*choices)
    return F.when(best["score"] > 0, best["d"]).otherwise(DEFAULT_DELIMITER)


def analyze_header(df: DataFrame, fields: str) -> DataFrame:
    """Adds the share of header-like fields, the verdict, and the column names of a first record."""
    likes = F.transform(fields, is_likely_header)
    judged = computed(df, df.columns, _likes=likes)
    share = F.size(F.filter("_likes", lambda like: like)) / F.size(fields)
    cleaned = F.transform(fields, lambda f, i: clean_header(f, i, F.get("_likes", i)))
    numbered = F.transform(fields, lambda f, i: position_name(i))
    named = computed(
        judged, judged.columns, header_share=share, _names=F.when(share >= HEADER_SHARE, cleaned).otherwise(numbered)
    )
    return named.select(
        *df.columns,
        "header_share",
        (F.col("header_share") >= HEADER_SHARE).alias("has_header"),
        unique_names(F.col("_names")).alias("headers"),
    )


def survey_files(spark: SparkSession, paths: str | list[str], prefix: bool = True) -> DataFrame:
    """One row per non-empty file: delimiter, header verdict and the normalised column names."""
    heads = file_heads(spark, paths, HEAD_BYTES, DELIMITERS).filter(F.col("head") != "")
    bare = computed(heads, ["path", "is_cut", "fields"], head=F.regexp_replace("head", "^\\ufeff", ""))
    lined = computed(bare, ["path", "fields"], _lines=_sample_lines(F.col("head"), F.col("is_cut")))
    sniffed = computed(lined, ["path", "fields"], delimiter=best_delimiter(F.col("_lines")))
    place = F.array_position(F.array(*[F.lit(d) for d in DELIMITERS]), F.col("delimiter")).cast("int")
    split = sniffed.select("path", "delimiter", F.element_at("fields", place).alias("fields"))
    named = analyze_header(split, "fields")
    headers = with_positions(F.col("headers")) if prefix else F.col("headers")
    return named.select(
        "path",
        "delimiter",
        "has_header",
        "header_share",
        F.size("fields").alias("n_columns"),
        headers.alias("headers"),
    )


def one_dialect(survey: DataFrame) -> tuple[str, bool, list[str]]:
    """The dialect all surveyed files share; an error when they differ."""
    kinds = survey.select("delimiter", "has_header", "headers").distinct().limit(2).collect()
    if not kinds:
        raise ValueError("no files found")
    if len(kinds) > 1:
        raise ValueError("the files differ in delimiter or columns; read them separately")
    return kinds[0]["delimiter"], kinds[0]["has_header"], list(kinds[0]["headers"])

