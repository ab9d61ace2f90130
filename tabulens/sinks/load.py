"""Create-and-load: typed rows with a sequential key, written as Parquet or as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import column
from tabulens.session import fresh_path
from tabulens.sources.delimited import apply_types, infer_types

_PLACE = "_place"
# Partitions whose offsets may be broadcast (16 bytes each).
BROADCAST_PARTITIONS = 1_000_000


def with_sequential_id(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Ids 1, 2, 3, … in the order of some columns, without bringing the rows into one task.

    Without ``order`` the ids follow the order of reading: Spark reads large pieces of files first, so
    that of several files or splits is not the order in which they were written. The rows are written once with their place (partition and position), then every partition
    adds the number of rows before it. What is counted is what is read: both come from the
    written rows, so a re-run task cannot shift the ids.
    """
    spark = df.sparkSession
    staged_path = fresh_path(spark, "staged")
    if order:
        keys = [column(c) for c in order]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df.withColumn(_PLACE, F.monotonically_increasing_id()).write.parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    part, position = F.shiftright(_PLACE, 33), F.col(_PLACE).bitwiseAND((1 << 33) - 1)
    sizes = staged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition: a window over all of them is small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    if sizes.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    numbered = staged.join(offsets, part == F.col("_part"))
    columns = [column(c) for c in df.columns]
    return numbered.select((F.col("_before") + position + 1).alias("id"), *columns)


def load(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    types: DataFrame | dict[str, str] | None = None,
    add_id: bool = True,
    max_length: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Type an all-string DataFrame and (over)write it; gives the loaded rows.

    Rows flagged in ``_corrupt`` are loaded, but do not take part in the inference of types; the flag is
    not loaded. ``max_length`` cuts texts; by default they are kept whole.
    ``order`` names typed columns that the added ids follow.
    """
    typed = apply_types(df, infer_types(df) if types is None else types, max_length)
    if add_id and "id" not in typed.columns:
        typed = with_sequential_id(typed, order)
    if table is not None:
        typed.write.mode("overwrite").saveAsTable(table)
        return df.sparkSession.table(table)
    target = path or fresh_path(df.sparkSession, "loaded")
    typed.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)
