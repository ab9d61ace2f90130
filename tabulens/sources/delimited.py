"""Delimited text to an all-string DataFrame, and its types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import column, computed
from tabulens.functions.datetimes import is_date_text, parse_moment
from tabulens.functions.numbers import is_float_text, is_long_text, to_double, to_long
from tabulens.session import cut_lineage
from tabulens.sources.archives import as_columns, list_files, packed_records
from tabulens.sources.files import one_dialect, survey_files
from tabulens.sources.quotes import quoted_records, range_states

CORRUPT = "_corrupt"
# Cells that stand for a missing value, and rows of a sampled inference.
MISSING_TEXTS = ("", r"\N")
# Archives that Spark's own reader does not unpack.
PACKED_PATTERN = r"\.(zip|lz4)$"

# Longest cell Spark can hold.
CELL_LENGTH = 2**31 - 1

# Bits of the cell classes that a column's mask collects.
_DATE, _MOMENT, _LONG, _DOUBLE, _TEXT = 1, 2, 4, 8, 16


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    names: Sequence[str],
    delimiter: str = ",",
    header: bool = True,
    multi_line: bool = False,
    packed: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """All cells as strings. Records of the wrong width are padded or cut and flagged.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    ``packed`` reads zip and LZ4 archives; gzip is read natively. One task reads one packed
    file; ``partitions`` spreads its rows for the work that follows.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    if packed:
        records = packed_records(spark, paths, delimiter, header)
        return as_columns(records if partitions is None else records.repartition(partitions), list(names), CORRUPT)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    rows = (
        spark.read.schema(schema)
        .option("sep", delimiter)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreLeadingWhiteSpace", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("maxCharsPerColumn", -1)
        .option("maxColumns", max(20_480, 2 * len(names)))
        .csv(paths)
    )
    cells = [F.nullif(column(n), F.lit("")).alias(n) for n in names]
    rows = rows if partitions is None else rows.repartition(partitions)
    return rows.select(*cells, column(CORRUPT))


def read_quoted(
    spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], delimiter: str, header: bool, states: DataFrame
) -> DataFrame:
    """As ``read_delimited``, with line breaks inside quotes, and still several tasks a file; ``states`` as ``range_states`` gives them."""
    records = quoted_records(spark, paths, delimiter, header, states)
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in [*names, CORRUPT])
    options = {
        "sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
        "ignoreLeadingWhiteSpace": "true", "maxCharsPerColumn": "-1", "maxColumns": str(max(20_480, 2 * len(names))),
    }
    rows = records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    return rows.select(*[F.nullif(column(n), F.lit("")).alias(n) for n in names], column(CORRUPT))


def read_auto(
    spark: SparkSession, paths: str | Sequence[str], prefix: bool = False, multi_line: bool = False
) -> DataFrame:
    """Files of one unknown dialect: sniff the heads, then read everything.

    Line breaks inside quotes are kept. One pass over the lines with quotes tells whether there are any;
    ``multi_line`` leaves it to Spark's reader instead, one task a file.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    survey = survey_files(spark, paths, prefix)
    delimiter, header, names = one_dialect(survey)
    packed = not list_files(spark, paths).filter(F.lower("path").rlike(PACKED_PATTERN)).isEmpty()
    if not packed and not multi_line:
        states = cut_lineage(range_states(spark, paths, delimiter))
        if not states.where("spans").isEmpty():
            return read_quoted(spark, paths, names, delimiter, header, states)
    return read_delimited(spark, paths, names, delimiter, header, multi_line, packed)


def _cell(value: Column) -> Column:
    """The cell without a byte order mark, NULL where it stands for a missing value."""
    bare = F.when(value.startswith("\ufeff"), F.substring(value, 2, CELL_LENGTH)).otherwise(value)
    return F.when(~bare.isin(*MISSING_TEXTS), bare)


def _class_bit(cell: Column, moment: Column) -> Column:
    """The class of one cell, given what it parses to as a date or moment."""
    number = F.when(is_long_text(cell), _LONG).otherwise(_DOUBLE)
    return (
        F.when(moment.isNotNull(), F.when(is_date_text(cell), _DATE).otherwise(_MOMENT))
        .when(is_float_text(cell), number)
        .when(cell.isNotNull(), _TEXT)
    )


def infer_types(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Column, type and nullability from the texts, in one aggregate over all rows.

    ``sample_rows`` takes that many rows with the smallest hashes of cells and place instead: spread over all files,
    and picked by a top list of every task.
    Dates widen to timestamps and whole to floating numbers; any other mix is text.
    """
    names = [n for n in df.columns if n != CORRUPT]
    rows = df.filter(column(CORRUPT).isNull()) if CORRUPT in df.columns else df
    rows = rows.select(*[column(n) for n in names])
    if sample_rows is not None:
        cells = F.struct(*[column(n) for n in names]).alias("cells")
        placed = rows.select(cells, F.xxhash64(F.monotonically_increasing_id(), *[column(n) for n in names]).alias("place"))
        rows = placed.orderBy("place").limit(sample_rows).select("cells.*")
    cells = computed(rows, [], **{f"c{i}": _cell(column(n)) for i, n in enumerate(names)})
    moments = {f"m{i}": parse_moment(F.col(f"c{i}")) for i in range(len(names))}
    parsed = computed(cells, cells.columns, **moments)
    masks = []
    for i, name in enumerate(names):
        cell = F.col(f"c{i}")
        bits = F.coalesce(F.bit_or(_class_bit(cell, F.col(f"m{i}"))), F.lit(0))
        masks.append(
            F.struct(
                F.lit(name).alias("column_name"),
                bits.alias("_mask"),
                F.coalesce(F.max(cell.isNull()), F.lit(True)).alias("nullable"),
            )
        )
    mask = F.col("_mask")
    kind = (
        F.when(mask == _DATE, "date")
        .when(mask.isin(_MOMENT, _DATE | _MOMENT), "timestamp_ntz")
        .when(mask == _LONG, "bigint")
        .when(mask.isin(_DOUBLE, _LONG | _DOUBLE), "double")
        .otherwise("string")
    )
    found = parsed.agg(F.array(*masks).alias("_rows")).select(F.inline("_rows"))
    return found.select("column_name", kind.alias("type"), "nullable")


def _typed(value: Column, kind: str, max_length: int | None) -> Column:
    cell = _cell(value)
    if kind == "date":
        return parse_moment(cell).cast("date")
    if kind == "timestamp_ntz":
        return parse_moment(cell)
    if kind == "bigint":
        return to_long(cell)
    if kind == "double":
        return to_double(cell)
    return cell if max_length is None else F.left(cell, F.lit(max_length))


def _types(types: DataFrame | dict[str, str]) -> dict[str, str]:
    """Types by column; a table of them has one row per column."""
    return types if isinstance(types, dict) else {r["column_name"]: r["type"] for r in types.collect()}


def apply_types(df: DataFrame, types: DataFrame | dict[str, str], max_length: int | None = None) -> DataFrame:
    """Typed columns; a cell that does not fit its type becomes NULL."""
    kinds = _types(types)
    return df.select(*[_typed(column(n), kinds[n], max_length).alias(n) for n in df.columns if n in kinds])


def cast_failures(df: DataFrame, types: DataFrame | dict[str, str]) -> DataFrame:
    """Per column, the present cells that do not fit the type."""
    kinds = _types(types)
    lost = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.count_if(_cell(column(n)).isNotNull() & _typed(column(n), k, None).isNull()).alias("failures"),
        )
        for n, k in kinds.items()
    ]
    return df.agg(F.array(*lost).alias("_rows")).select(F.inline("_rows"))
