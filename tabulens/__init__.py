"""tabulens: automatic statistics for tables, delimited files and texts, on Spark."""
