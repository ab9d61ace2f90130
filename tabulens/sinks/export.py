"""CSV export of rollups: one folder per rollup, columns in name order, oldest bucket first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import column


def export_rollups(rollups: DataFrame, path: str, compression: str | None = None) -> None:
    """Write a long table with the columns ``rollup`` and ``datetime`` as partitioned CSV.

    Rows are range-partitioned by rollup and time, so that long rollups spread over tasks and
    every file is ordered.
    """
    ordered = sorted(c for c in rollups.columns if c != "rollup")
    spread = rollups.select("rollup", *[column(c) for c in ordered]).repartitionByRange("rollup", "datetime")
    writer = spread.sortWithinPartitions("rollup", "datetime").write.mode("overwrite").partitionBy("rollup")
    writer.option("header", True).option("escape", '"').option("compression", compression or "none").csv(path)


def read_rollups(spark, path: str, schema: str) -> DataFrame:
    """Read an export back; ``schema`` describes the columns in name order."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rows.withColumn("rollup", F.col("rollup").cast("string"))
