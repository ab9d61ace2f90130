"""Tables known to the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select("tableName").orderBy("tableName")
